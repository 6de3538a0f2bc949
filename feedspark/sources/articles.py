"""Article sources and sinks.

Writes go to folders the caller names (on a cluster: a shared path, e.g.
under ``spark.checkpoint.dir``); reads are plain Spark readers with explicit
schemas or a header read, so nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_TOPIC

# CSV dialect used on both sides so text with quotes and newlines round-trips.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Characters a text strip removes at both ends: ASCII whitespace, the
# separators 0x1c-0x1f, NEL and every Unicode space separator.
STRIP_CLASS = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


def write_articles_csv(df: DataFrame, path: str) -> None:
    """Write (id, title, text[, topic]) as CSV with a header."""
    w = df.write.mode("overwrite")
    for k, v in CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)


def scan_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: id, title, text, topic (all strings); a file without a ``topic``
    column gives 'unknown'; a missing path fails the job."""
    r = spark.read
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    df = r.csv(path)  # no inference: every column is a string
    # a CSV cell is always a string: an empty cell is '' (Spark would give NULL)
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    topic = cell("topic") if "topic" in df.columns else F.lit(DEFAULT_TOPIC)
    return df.select(cell("id").alias("id"), cell("title").alias("title"), cell("text").alias("text"),
                     topic.alias("topic"))


def articles_csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                            partitions: int | None = None) -> DataFrame:
    """Convert an article CSV once: multi-line CSV files cannot be split, Parquet
    can (and prunes columns). Returns the Parquet table."""
    df = scan_articles_csv(spark, csv_path)
    n = partitions or spark.sparkContext.defaultParallelism
    df.repartition(n).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def scan_rows_dynamic(df: DataFrame) -> DataFrame:
    """A2: every column of every row becomes a field of the entry (string map)."""
    names = F.array(*[F.lit(c) for c in df.columns])
    values = F.array(*[F.col(c).cast("string") for c in df.columns])
    return df.select(F.map_from_arrays(names, values).alias("fields"))


def scan_rows_dynamic_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2 over a CSV file: whatever columns the header names become the fields."""
    r = spark.read
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    df = r.csv(path)
    return scan_rows_dynamic(df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]))


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def clean_text(c: Column) -> Column:
    """NULL -> '', newline -> space, whitespace stripped at both ends."""
    return strip_text(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """``df.orderBy(order).limit(n)``, rows that are equal in ``order`` in any choice, without the rows of all tasks in one.

    The last key is found on the keys alone; rows up to it are then read where they lie. Only of rows that are equal to
    it, and of these only if not all of them belong to the ``n``, a limit takes some.
    """
    key = F.col(order)
    rows, last = df.select(order).orderBy(order).limit(n).agg(F.count("*"), F.max(key)).first()
    if rows < n:
        return df.orderBy(order)
    at = key.isNull() if last is None else key == F.lit(last)  # NULLs come first
    before = F.lit(False) if last is None else key.isNull() | (key < F.lit(last))
    n_before, n_at = df.select(order).agg(F.count_if(before), F.count_if(at)).first()
    if n_before + n_at == n:
        return df.where(before | at).orderBy(order)
    return df.where(before).unionByName(df.where(at).limit(n - n_before)).orderBy(order)


def clean_articles(df: DataFrame, n: int | None = None, order: str = "id_order") -> DataFrame:
    """A3: clean id/title/text; with ``n`` keep the first ``n`` rows in source order."""
    out = df.select(
        *([order] if order in df.columns else []),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        clean_text(F.col("title")).alias("title"),
        clean_text(F.col("text")).alias("text"),
    )
    if n is not None:
        out = first_rows(out, order, n)
    return out.drop(order) if order in out.columns else out


def sink_topic_log(df: DataFrame, path: str) -> None:
    """A5: append enriched documents to their topic's log (one folder per topic)."""
    df.write.mode("append").partitionBy("topic").parquet(path)


def read_topic_log(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Read the topic log; a topic filter prunes to that topic's folder."""
    df = spark.read.parquet(path)
    return df if topic is None else df.where(F.col("topic") == topic)


#: Buckets of the tables that are read by user. Tables of one number of buckets join without moving a row.
USER_BUCKETS = 16


def write_by_user(df: DataFrame, table: str, order: tuple[str, ...] = (), buckets: int = USER_BUCKETS) -> None:
    """``df`` as the table ``table``, bucketed by uid and sorted inside the buckets, with Parquet Bloom filters of uid: a
    read of one user opens one bucket, and in it the files that may hold the user."""
    w = df.repartition(buckets, "uid").write.mode("overwrite").format("parquet").bucketBy(buckets, "uid").sortBy("uid", *order)
    w.option("parquet.bloom.filter.enabled#uid", "true").saveAsTable(table)


def sink_user_feed(feed: DataFrame, table: str, buckets: int = USER_BUCKETS) -> None:
    """One feed table bucketed by uid, newest first inside a user; consumption is a separate cursor table, so no
    second copy is written."""
    write_by_user(feed, table, ("pos",), buckets)


def read_user(spark: SparkSession, table: str, uid: int) -> DataFrame:
    """The rows of one user, from the one bucket that holds them."""
    return spark.table(table).where(F.col("uid") == F.lit(uid).cast("bigint"))


def write_users(users: DataFrame, path: str) -> None:
    """User records as JSON lines: {"uid": .., "interests": [..]}."""
    users.select("uid", "interests").write.mode("overwrite").json(path)


def scan_users(spark: SparkSession, path: str) -> DataFrame:
    """Bulk read of the user records with an explicit schema."""
    return spark.read.schema("uid BIGINT, interests ARRAY<STRING>").json(path)


def write_metrics(samples: DataFrame, path: str, kind: str = "counter") -> None:
    """Append metric samples to the ``metrics`` table."""
    samples.select("series", F.create_map(F.lit("series"), F.col("series")).alias("labels"),
                   "ts", F.col("value").cast("double").alias("value"), F.lit(kind).alias("kind")) \
        .write.mode("append").partitionBy("kind").parquet(path)


def index_users(users: DataFrame, table: str, buckets: int = USER_BUCKETS) -> None:
    """User records as a table for look-ups and joins by uid (the JSON lines are for bulk reads)."""
    write_by_user(users, table, (), buckets)


def scan_metrics(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Metric samples (series, labels, ts, value, kind); ``kind`` prunes partitions."""
    df = spark.read.parquet(path)
    return df if kind is None else df.where(F.col("kind") == kind)
