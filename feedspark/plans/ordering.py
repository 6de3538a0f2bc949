"""Exact ordered numbering, running sums, lags and runs without one-task windows.

``row_number()`` or a running ``sum`` over a whole table (or over a key that
may hold a third of the rows) runs in a single task. Here the rows are cut
into ranges of (key, order) of about equal size:

1. the window runs per ``(keys, range)`` - as many tasks as the data needs;
2. a small table with a row per key and range says what each range hands on;
3. the first key of a range takes what earlier ranges hand on. As ranges go by
   (key, order), no other key of it began in an earlier range: what is handed on
   is at most a row per range, and is broadcast.

The result equals the plain window exactly. Only the columns that are named
take part: payloads stay where they are and are joined to the result, if at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def range_chunks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` cut by ``(keys, order)`` into ranges of about equal size, numbered in ``_chunk``.

    The number of ranges follows the data and the shuffle partitions, not the calendar: a key that
    holds a third of the rows lies in many ranges. The table is written, as ranges come from a sample
    and every reader must see the same ones. ``order`` must be total up to equal rows.
    """
    cut = df.repartitionByRange(*_cols(keys), *_cols(order)).withColumn("_chunk", F.spark_partition_id())
    path = scratch_path(df.sparkSession, "ranges")
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def handed_on(local: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``local`` with what earlier ranges hand on to a (key, range); NULLs where they hand on nothing.

    ``carried``: _chunk, the keys and more columns, only rows of keys that lie in several ranges: at most two per range.
    """
    c = carried.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_chunk").alias("_k_chunk"),
                       *(x for x in carried.columns if x not in (*keys, "_chunk")))
    same = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(F.broadcast(c), same, "left")


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, Column],
                 total_col: str | None = None) -> DataFrame:
    """Exclusive running sums per key along ``order``: one output column per entry of ``values``.

    A window runs per (keys, range); the ranges of a key add the totals of the earlier ones. ``total_col``
    optionally adds the sum of the first value over the whole key.
    """
    d = range_chunks(df.withColumns({f"_v_{k}": v for k, v in values.items()}), keys, order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumns({f"_s_{k}": F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)) for k in values})
    totals = d.groupBy(*keys, "_chunk").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    by = Window.partitionBy(*keys).orderBy("_chunk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *(F.sum(f"_t_{k}").over(before).alias(f"_o_{k}") for k in values),
                            F.row_number().over(by).alias("_ranges")).where("_ranges > 1").drop("_ranges")
    j = handed_on(local, offsets, keys)
    out = [(F.col(f"_s_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0))).alias(k) for k in values]
    if not total_col:
        return j.select(*df.columns, *out)
    first = next(iter(values))
    whole = totals.groupBy(*keys).agg(F.sum(f"_t_{first}").alias(total_col)).select(
        *(F.col(k).alias(f"_w_{k}") for k in keys), total_col)
    if not keys:
        return j.join(F.broadcast(whole)).select(*df.columns, *out, total_col)  # one row
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys))
    return j.join(whole, same).select(*df.columns, *out, total_col)


def numbered(df: DataFrame, keys: list[str], order: list, out: str = "rn", total_col: str | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)``; ``total_col`` optionally adds the row count of the key."""
    r = running_sums(df, keys, order, {"_before": F.lit(1).cast("bigint")}, total_col)
    columns = [*df.columns, *([total_col] if total_col else [])]
    return r.select(*columns, (F.col("_before") + 1).cast("bigint").alias(out))


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str = "running") -> DataFrame:
    """``sum(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``."""
    r = running_sums(df.withColumn("_own", value), keys, order, {"_before": F.col("_own")})
    return r.select(*df.columns, (F.col("_before") + F.col("_own")).alias(out))


def range_lag(df: DataFrame, keys: list[str], order: list, value: str, out: str = "prev") -> DataFrame:
    """``lag(value) OVER (PARTITION BY keys ORDER BY order)``: a plain lag inside a range, its first row takes the
    last value of the closest earlier range of the key."""
    d = range_chunks(df, keys, order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    local = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = d.groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(*_cols(order))).alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_chunk")
    carry = last.select(*keys, "_chunk", F.lag("_last").over(by).alias("_carry"), F.row_number().over(by).alias("_ranges")
                        ).where("_ranges > 1").drop("_ranges")
    return handed_on(local, carry, keys).select(
        *df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")).alias(out))


def run_positions(df: DataFrame, keys: list[str], order: list, value: str, out: str = "run_pos") -> DataFrame:
    """Position of each row (1-based) inside its run of equal consecutive ``value``s per key along ``order``; NULLs are equal.

    A range hands on the length of the run at its end. If it is one run as a whole, that run may have begun in earlier
    ranges: their lengths add up back to the range where the run began.
    """
    d = range_chunks(df, keys, order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    begins = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    rows = d.select("*", F.row_number().over(w).alias("_n"), begins.alias("_b"))
    run = F.max(F.when(F.col("_b"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.select("*", run.alias("_start")).withColumn("_p", F.col("_n") - F.col("_start") + 1)
    at_end = F.struct("_n")
    ends = local.groupBy(*keys, "_chunk").agg(
        F.min_by(value, at_end).alias("_head"), F.max_by(value, at_end).alias("_tail"), F.max_by("_p", at_end).alias("_len"),
        (F.max("_start") == 1).alias("_one"))
    by = Window.partitionBy(*keys).orderBy("_chunk")
    goes_on = F.col("_one") & F.col("_head").eqNullSafe(F.lag("_tail").over(by)) & (F.row_number().over(by) > 1)
    groups = ends.select("*", goes_on.alias("_on")).select(
        "*", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(by).alias("_g"))
    upto = Window.partitionBy(*keys, "_g").orderBy("_chunk")
    lengths = groups.select("*", F.sum("_len").over(upto).alias("_sofar"))
    carry = lengths.select(
        *keys, "_chunk", F.when(F.col("_head").eqNullSafe(F.lag("_tail").over(by)), F.lag("_sofar").over(by)).alias("_carry"),
        F.row_number().over(by).alias("_ranges")).where("_ranges > 1 AND _carry IS NOT NULL").drop("_ranges")
    position = F.col("_p") + F.when(F.col("_start") == 1, F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    return handed_on(local, carry, keys).select(*df.columns, position.cast("bigint").alias(out))


def chunked_lag(df: DataFrame, keys: list[str], chunk: Column, order: list, value: str,
                out: str = "prev") -> DataFrame:
    """``lag(value) OVER (PARTITION BY keys ORDER BY order)``, computed per chunk.

    Inside a chunk it is a plain ``lag``; the first row of a chunk takes the
    last value of the closest earlier chunk, looked up in a small table with
    one row per (keys, chunk).
    """
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    local = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = d.groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(*_cols(order))).alias("_last"))
    prev_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carry = last.select(*keys, "_chunk", F.lag("_last").over(prev_chunk).alias("_carry"))
    j = local.join(carry, [*keys, "_chunk"])
    return j.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_chunk", "_lag", "_carry", "_first")
