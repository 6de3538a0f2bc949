"""H9: every panel of the pipeline dashboard per evaluation step, in one table.

All metrics are one stream of samples, tagged with the metric's name. The stream is put in order once (``points``), every
point says at which steps it is an end of its metric's range, and one aggregation by step and series gives increases
and last values, a second one by step the columns of all panels: no join, and no pass per panel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LATENCY_BOUNDS
from ..operators.metrics import first_steps, instant_rate, last_steps, micros, points, quantile_in, seconds

MB, KB = 1 / 1024 / 1024, 1 / 1024


@dataclass(frozen=True)
class Panel:
    """A column of the dashboard. kind: rate, irate, last (each summed over the series of the metric), or a quantile
    of a histogram's bucket increases."""
    column: str
    kind: str
    metric: str
    factor: float = 1.0
    q: float = 0.0


#: The 22 panels in the dashboard's order; three of them show two lines.
PANELS = (
    Panel("producer_rate", "rate", "producer_msgs"), Panel("raw_backlog", "last", "raw_len"),
    Panel("enrich_in_rate", "rate", "enrich_in"), Panel("enrich_out_rate", "rate", "enrich_out"),
    Panel("fan_out_backlog", "last", "topic_len"),
    Panel("fan_out_rate", "rate", "fan_out"), Panel("reader_pops_rate", "rate", "reader_pops"),
    Panel("feeds_backlog", "last", "feed_backlog"), Panel("store_ops_rate", "rate", "store_ops"),
    Panel("store_memory_mb", "last", "store_memory", MB),
    Panel("store_p99_us", "quantile", "store_latency", 1e6, 0.99), Panel("store_p50_us", "quantile", "store_latency", 1e6, 0.5),
    Panel("gpu_replicas", "last", "enrich_gpu"), Panel("reader_target_rps", "last", "reader_target"),
    Panel("avg_feed_backlog", "last", "avg_feed_backlog"),
    Panel("raw_trim_rate", "irate", "raw_trims"), Panel("topic_trim_rate", "irate", "topic_trims"),
    Panel("clients", "last", "store_clients"),
    Panel("cache_hit_rate", "rate", "cache_hits"), Panel("cache_miss_rate", "rate", "cache_misses"),
    Panel("net_in_kb", "rate", "net_in", KB), Panel("net_out_kb", "rate", "net_out", KB),
    Panel("dataset_memory_mb", "last", "dataset_memory", MB), Panel("cpu_percent", "rate", "cpu_seconds", 100.0),
    Panel("fragmentation", "last", "fragmentation"),
)


def pipeline_overview(samples: DataFrame, ranges: dict[str, str], step: str = "1 day", panels: tuple[Panel, ...] = PANELS,
                      order: tuple[str, ...] | None = None, bounds=LATENCY_BOUNDS) -> DataFrame:
    """t and a column per panel; a step has a row if any panel has a value there.

    ``samples``: metric, label, le (the bucket's number, 0 for what is no histogram), ts, value, and the columns of
    ``order``. ``ranges``: the range of every kind of panel (rate, irate, last, quantile).
    """
    kinds = {p.metric: p.kind for p in panels}
    of_kind = {k: F.col("metric").isin([m for m, x in kinds.items() if x == k]) for k in set(kinds.values())}
    range_us = F.lit(None).cast("long")
    for kind, mine in of_kind.items():
        range_us = F.when(mine, F.lit(micros(ranges[kind]))).otherwise(range_us)
    step_us, keys = micros(step), ["metric", "label", "le"]

    p = points(samples.where(F.col("metric").isin(list(kinds))), keys, "ts", ("value",), order)
    never = F.lit(False)
    counted = of_kind.get("rate", never) | of_kind.get("quantile", never)
    none = F.array().cast("array<bigint>")
    sides = F.concat(
        F.transform(last_steps(F.col("range_us"), step_us), lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
        F.transform(F.when(counted, first_steps(F.col("range_us"), step_us)).otherwise(none), lambda t: F.struct(t.alias("t"), F.lit(-1).alias("side"))))
    at = (p.withColumn("range_us", range_us)
          .select(*keys, "value", "total_value", "n", "prev_us", "range_us", instant_rate().alias("instant"), sides.alias("_e"))
          .select(*keys, "value", "total_value", "n", "prev_us", "range_us", "instant", F.explode("_e").alias("_e"))
          .select("*", "_e.t", "_e.side"))
    ends = F.col("side") == 1
    per_series = at.groupBy("t", *keys).agg(
        F.sum(F.col("side") * F.col("total_value")).alias("up"), F.sum(F.col("side") * F.col("n")).alias("more"),
        F.max(F.when(ends, F.col("value"))).alias("last"),
        F.max(F.when(ends & (F.col("prev_us") > F.col("t") - F.col("range_us")), F.col("instant"))).alias("instant"))

    two = F.col("more") >= 1  # an increase needs two samples
    shown = {"rate": F.when(two, F.col("up")), "irate": F.col("instant"), "last": F.col("last")}
    sums: list[Column] = [F.sum(F.when(F.col("metric") == x.metric, shown[x.kind])).alias(x.column) for x in panels if x.kind != "quantile"]
    hists = sorted({x.metric for x in panels if x.kind == "quantile"})
    sums += [F.sum(F.when(two & (F.col("metric") == m) & (F.col("le") == k), F.col("up"))).alias(f"_{m}_{k}") for m in hists for k in range(len(bounds) + 1)]
    wide = per_series.groupBy("t").agg(*sums)

    def final(x: Panel) -> Column:
        if x.kind == "quantile":
            cum = F.array(*(F.coalesce(F.col(f"_{x.metric}_{k}"), F.lit(0)).cast("double") for k in range(len(bounds) + 1)))
            return quantile_in(cum, x.q, bounds) * x.factor
        per = float(seconds(ranges["rate"])) if x.kind == "rate" else 1.0
        return F.col(x.column) / per * x.factor

    out = wide.select(F.timestamp_micros("t").alias("t"), *(final(x).alias(x.column) for x in panels))
    return out.where(F.coalesce(*(F.col(x.column) for x in panels)).isNotNull())
