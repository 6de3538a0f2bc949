"""Derived views over the base tables (see FIXTURES.md part 2).

They turn the generic test tables into the shapes of the feed system:
articles with re-ingested copies, user subscriptions, delivery attempts,
counter samples. Every view is a lazy DataFrame over the base tables, so its
size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIXTURE_EPOCH_US, MICROS_PER_MINUTE, TOPICS
from .tables import Tables


def topics_array() -> Column:
    return F.array(*[F.lit(t) for t in TOPICS])


def topic_at(idx: Column) -> Column:
    """TOPICS[idx] for a 0-based index column."""
    return F.element_at(topics_array(), idx.cast("int") + 1)


def _epoch_plus(micros: Column) -> Column:
    return F.timestamp_micros(F.lit(FIXTURE_EPOCH_US) + micros)


def base_articles(t: Tables) -> DataFrame:
    """One article per document; fifteen articles share a millisecond."""
    doc = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        _epoch_plus(F.floor(doc / 15) * 555 * MICROS_PER_MINUTE).alias("ts0"),
        F.substring("text", 1, 60).alias("title"),
        "text",
        topic_at((doc * 7 + F.floor(doc / 10)) % 10).alias("topic"),
    )


def articles(t: Tables) -> DataFrame:
    """Articles plus re-ingested copies 6 h and 30 h later; some ids empty.

    One pass over the documents: each article explodes into its copies
    (copy 1 when doc_id % 20 = 0, copy 2 when doc_id % 30 = 0).
    """
    b = base_articles(t)
    doc = F.col("doc_id")
    copies = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)),
                      lambda c: (c == 0) | ((c == 1) & (doc % 20 == 0)) | ((c == 2) & (doc % 30 == 0)))
    u = b.select("*", F.explode(copies).alias("copy"))
    u = u.withColumn("entry_ts", F.col("ts0") + F.when(F.col("copy") == 1, F.expr("INTERVAL 6 HOURS"))
                     .when(F.col("copy") == 2, F.expr("INTERVAL 30 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS")))
    return u.select(
        F.concat(F.unix_millis("entry_ts").cast("string"), F.lit("-"),
                 (F.col("doc_id") % 15 * 3 + F.col("copy")).cast("string")).alias("entry_id"),
        "entry_ts", "copy", "doc_id",
        F.when(F.col("doc_id") % 97 == 0, F.lit(""))
        .otherwise(F.col("doc_id").cast("string")).alias("id"),
        "title", "text", "topic",
    )


def originals(t: Tables) -> DataFrame:
    """First ingest of every article (no re-ingested copies)."""
    return articles(t).where(F.col("copy") == 0)


def subscriptions(t: Tables) -> DataFrame:
    """(uid, created_ts, topic): 2 to 4 of the first nine topics per customer; nobody has the last."""
    c = t.customer.select("c_custkey")
    return c.select(
        F.col("c_custkey").alias("uid"),
        _epoch_plus(F.col("c_custkey") * 13 * MICROS_PER_MINUTE).alias("created_ts"),
        F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("j"),
    ).select(
        "uid", "created_ts",
        topic_at((F.col("uid") * 7 + F.col("j") * 2) % 9).alias("topic"),
    )


def users(t: Tables) -> DataFrame:
    """(uid, interests, created_ts): the user records, interests sorted."""
    c = t.customer.select("c_custkey")
    return c.select(
        F.col("c_custkey").alias("uid"),
        F.array_sort(F.transform(
            F.sequence(F.lit(0), (F.col("c_custkey") % 3 + 1).cast("int")),
            lambda j: topic_at((F.col("c_custkey") * 7 + j * 2) % 9),
        )).alias("interests"),
        _epoch_plus(F.col("c_custkey") * 13 * MICROS_PER_MINUTE).alias("created_ts"),
    )


def known_users(t: Tables) -> DataFrame:
    """User records without every eleventh user: those have feeds and clicks, but no record."""
    return users(t).where(F.col("uid") % 11 != 0)


def attempts(t: Tables) -> DataFrame:
    """Delivery attempts / clicks with natural repeats, from ``events``."""
    return t.events.select(
        F.col("user_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.get_json_object("props", "$.k").alias("doc_id"),
        F.col("event_type").alias("tag"),
    )


def counter_samples(t: Tables) -> DataFrame:
    """Per-series counters that restart at midnight (one sample per event)."""
    from pyspark.sql import Window

    e = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(
        F.col("event_type").alias("series"), "ts",
        F.row_number().over(w).cast("bigint").alias("value"),
    )


def latency_samples(t: Tables) -> DataFrame:
    """Latency observations in seconds: events.value / 1000 per series."""
    return t.events.select(
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.col("value") / 1000.0).alias("seconds"),
    )


def bucket_samples(t: Tables) -> DataFrame:
    """Scrapes of a latency histogram: per series the cumulative counts of all buckets (``counts``), restarting at
    midnight; one scrape per observation."""
    from pyspark.sql import Window

    from ..constants import LATENCY_BOUNDS

    s = latency_samples(t)
    w = Window.partitionBy("series", F.to_date("ts")).orderBy("ts", "event_id")
    counts = [F.sum((F.col("seconds") <= b).cast("bigint")).over(w) for b in (*LATENCY_BOUNDS, float("inf"))]
    return s.select("series", "ts", "event_id", F.array(*counts).alias("counts"))


#: Metrics of the dashboard fixture, one per event type and remainder of the user by five (two for the histogram).
SCRAPED = ("producer_msgs", "raw_len", "enrich_in", "enrich_out", "topic_len", "fan_out", "reader_pops", "feed_backlog",
           "store_ops", "store_memory", "store_latency", "store_latency", "enrich_gpu", "reader_target", "avg_feed_backlog",
           "raw_trims", "topic_trims", "store_clients", "cache_hits", "cache_misses", "net_in", "net_out", "dataset_memory",
           "cpu_seconds", "fragmentation")
#: Of these the event's value is a sample; the histogram counts it by buckets, all others count the events of a day.
SCRAPED_GAUGES = ("raw_len", "topic_len", "feed_backlog", "store_memory", "enrich_gpu", "reader_target", "avg_feed_backlog",
                  "store_clients", "dataset_memory", "fragmentation")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def scrapes(t: Tables) -> DataFrame:
    """One tagged stream of all the dashboard's metrics: metric, label, le, ts, event_id, value. An event is a sample of
    one metric; counters and bucket counts restart at midnight."""
    from pyspark.sql import Window

    from ..constants import LATENCY_BOUNDS

    kind = F.array_position(F.array(*(F.lit(x) for x in EVENT_TYPES)), F.col("event_type")) - 1
    metric = F.get(F.array(*(F.lit(x) for x in SCRAPED)), (kind * 5 + F.col("user_id") % 5).cast("int"))
    e = t.events.select(metric.alias("metric"), F.floor(F.col("user_id") / 5 % 3).cast("string").alias("label"),
                        F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    w = Window.partitionBy("metric", "label", F.to_date("ts")).orderBy("ts", "event_id")
    bounds = (*LATENCY_BOUNDS, float("inf"))
    counts = F.array(*(F.sum((F.col("value") / 1000.0 <= b).cast("bigint")).over(w).cast("double") for b in bounds))
    n = F.count("*").over(w).cast("double")
    samples = (F.when(F.col("metric") == "store_latency", counts)
               .when(F.col("metric").isin(*SCRAPED_GAUGES), F.array("value")).otherwise(F.array(n)))
    return e.select("metric", "label", "ts", "event_id", samples.alias("_s")).select(
        "metric", "label", "ts", "event_id", F.posexplode("_s").alias("le", "value"))


def raw_log(t: Tables) -> DataFrame:
    """Raw article log entries with field presence varied by copy.

    copy 0 carries ``body``; copy 1 carries only ``text``; copy 2 carries
    neither (absent fields are NULL).
    """
    a = articles(t)
    return a.select(
        "entry_id", "entry_ts", "copy", "doc_id", "id", "title",
        F.when(F.col("copy") == 0, F.col("text")).alias("body"),
        F.when(F.col("copy") == 1, F.col("text")).alias("text"),
        "topic",
    )


def messages(t: Tables) -> DataFrame:
    """Raw UI messages with every NULL / empty combination of the fields."""
    a = articles(t)
    copy, doc = F.col("copy"), F.col("doc_id")
    return a.select(
        "entry_id", "entry_ts", "doc_id",
        F.when(F.col("id") == "", F.lit(None).cast("string")).otherwise(F.col("id")).alias("id"),
        F.when(copy == 2, F.lit(None).cast("string")).otherwise(F.col("title")).alias("title"),
        F.when((copy == 2) & (doc % 60 == 0), F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("text"),
        F.when(copy == 0, F.lit("")).when(copy == 1, F.lit(None).cast("string"))
        .otherwise(F.substring("text", 1, 20)).alias("summary"),
        F.when(copy == 1, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body"),
        F.when(copy == 0, F.array(F.col("topic")))
        .when(copy == 1, F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.col("topic"), F.lit(""), F.col("topic"))).alias("tags"),
        F.when(doc % 7 == 0, F.lit(None).cast("string"))
        .when(doc % 11 == 0, F.lit("")).otherwise(F.col("topic")).alias("topic"),
    )
