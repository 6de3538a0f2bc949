"""Pipeline counters and gauges as aggregates.

All are ``groupBy`` aggregates with map-side partial aggregation; the few
per-key post-steps (cumulative buckets) run on already-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSIFY_BATCH, DEFAULT_TOPIC, LATENCY_BOUNDS, RAW_LOG_CAP, TOPIC_LOG_CAP


def per_topic_counts(log: DataFrame, name: str = "n") -> DataFrame:
    """Documents routed per topic, plus the total as the NULL-topic row (rollup)."""
    return log.rollup("topic").agg(F.count(F.lit(1)).alias(name))


def fanout_counts(push_counts: DataFrame) -> DataFrame:
    """Messages consumed and pushes per topic (from ``visible_push_counts``)."""
    return push_counts.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"),
                                            F.sum("pushes").cast("bigint").alias("pushes"))


def topic_log_length(log: DataFrame, cap: int = TOPIC_LOG_CAP) -> DataFrame:
    """Length of each topic log after retention; the NULL-topic row is the fan-out backlog."""
    per = log.groupBy("topic").agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("bigint").alias("length"))
    total = per.agg(F.sum("length").cast("bigint").alias("length")).select(
        F.lit(None).cast("string").alias("topic"), "length")
    return per.unionByName(total)


def raw_log_length(log: DataFrame, cap: int = RAW_LOG_CAP) -> DataFrame:
    """E5: raw log length after the exact trim."""
    return log.agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("bigint").alias("length"))


def duplicates_skipped(marked: DataFrame) -> DataFrame:
    """Attempts, duplicates skipped and their share (from ``dedup_marks``)."""
    return marked.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("duplicate").alias("skipped"),
    ).select("attempts", "skipped",
             F.round(F.col("skipped") / F.col("attempts"), 9).alias("share"))


def feed_lengths(feed: DataFrame) -> DataFrame:
    """Feed length per user."""
    return feed.groupBy("uid").agg(F.count(F.lit(1)).alias("feed_len"))


def avg_feed_backlog(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Total backlog / latest_uid; 0 when there are no users.

    One aggregate over the union of both inputs, so no join is needed.
    """
    both = feed.select(F.lit(1).alias("_f"), F.lit(None).cast("bigint").alias("_u")).unionByName(
        users.select(F.lit(0).alias("_f"), F.col("uid").cast("bigint").alias("_u")))
    agg = both.agg(F.sum("_f").cast("bigint").alias("backlog"),
                   F.coalesce(F.max("_u"), F.lit(0)).cast("bigint").alias("latest_uid"))
    return agg.select("backlog", "latest_uid",
                      F.when(F.col("latest_uid") == 0, F.lit(0.0))
                      .otherwise(F.round(F.col("backlog") / F.col("latest_uid"), 9)).alias("avg_backlog"))


def producer_by_topic(rows: DataFrame) -> DataFrame:
    """Articles replayed per topic; an absent topic counts as 'unknown'."""
    return rows.groupBy(F.coalesce("topic", F.lit(DEFAULT_TOPIC)).alias("topic")).agg(
        F.count(F.lit(1)).alias("n"))


def fanout_amplification(push_counts: DataFrame) -> DataFrame:
    """Deliveries per input message (from ``visible_push_counts``)."""
    agg = push_counts.agg(F.count(F.lit(1)).alias("messages"), F.sum("pushes").cast("bigint").alias("deliveries"))
    return agg.select("messages", "deliveries",
                      F.round(F.col("deliveries") / F.col("messages"), 6).alias("amplification"))


def bucket_index(value: Column, bounds=LATENCY_BOUNDS) -> Column:
    """Index of the first bound >= value (len(bounds) = the +Inf bucket)."""
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(arr, lambda b: b < value))


def latency_histogram(samples: DataFrame, value_col: str = "seconds", key: str = "series",
                      bounds=LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts (bounds + +Inf) with sum and count per key."""
    b = samples.select(key, F.col(value_col).alias("_v"), bucket_index(F.col(value_col), bounds).alias("_b"))
    per = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    keys = per.groupBy(key).agg(F.sum("_n").alias("count"), F.sum("_s").alias("sum"))
    les = F.array(*[F.lit(float(x)) for x in bounds], F.lit(float("inf")))
    grid = keys.select(key, "count", "sum", F.posexplode(les).alias("_b", "le"))
    j = grid.join(per.select(key, "_b", "_n"), [key, "_b"], "left")
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(key, "le", F.sum(F.coalesce("_n", F.lit(0))).over(w).cast("bigint").alias("cum_count"),
                    F.col("count").cast("bigint").alias("count"), F.round("sum", 6).alias("sum"))


def gauge_sum(samples: DataFrame, series: str, label: str, value: str, order: list[str]) -> DataFrame:
    """Last value of each (series, label) replica, summed per series."""
    last = samples.groupBy(series, label).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    return last.groupBy(series).agg(F.round(F.sum("_last"), 6).alias("value"))


def fragmentation_ratio(rss: Column, used: Column) -> Column:
    """Rss / used, 0 when used is 0."""
    return F.when(used == 0, F.lit(0.0)).otherwise(rss / used)


def trim_ops(raw: DataFrame, topic_log: DataFrame, batch: int = CLASSIFY_BATCH) -> DataFrame:
    """Trim passes: one per full enrich batch on the raw log (NULL topic row),
    one per fanned-out message on each topic log."""
    raw_trims = raw.agg(F.floor(F.count(F.lit(1)) / batch).cast("bigint").alias("trims")).select(
        F.lit(None).cast("string").alias("topic"), "trims")
    topic_trims = topic_log.groupBy("topic").agg(F.count(F.lit(1)).alias("trims"))
    return topic_trims.unionByName(raw_trims)
