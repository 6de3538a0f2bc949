"""Fan-out joins: every topic message to every subscriber of its topic.

There are only ~10 topic keys, so a shuffle join on ``topic`` would run in
at most 10 tasks. The plans instead keep ``subscriptions`` partitioned by
``uid`` (in as many tasks as the deliveries need) and either broadcast the key-only messages (after a size check) or,
beyond the bound, salt the messages and replicate subscriptions ``salts``
times (as many as the messages need) so the join spreads over ``topics x salts`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import doc_identity

# About 64 bytes per key-only message row: 2M rows stay well under the
# default 8 GB broadcast hard limit and far under executor memory.
BROADCAST_MAX_ROWS = 2_000_000


def message_keys(messages: DataFrame) -> DataFrame:
    """Key-only message rows: payload columns are joined back only at output."""
    return messages.select("entry_id", "entry_ts", doc_identity("id", "entry_id").alias("doc"), "topic")


#: Messages of one topic and salt that a task joins.
ROWS_PER_SALT = 100_000
#: Deliveries that a task of the broadcast join builds.
ROWS_PER_TASK = 4_000_000


def _sizes(keys: DataFrame, subs: DataFrame) -> tuple[int, int]:
    """Number of messages, and of (message, subscription) pairs of one topic."""
    per_topic = subs.groupBy("topic").agg(F.count(F.lit(1)).alias("_subs"))
    met = keys.groupBy("topic").agg(F.count(F.lit(1)).alias("_msgs")).join(per_topic, "topic", "left")
    n, pairs = met.agg(F.sum("_msgs"), F.sum(F.col("_msgs") * F.col("_subs"))).first()
    return n or 0, pairs or 0


def _join(keys: DataFrame, subs: DataFrame, visible: bool, strategy: str, salts: int | None,
          max_rows: int) -> DataFrame:
    subs = subs.select("uid", "topic", "created_ts")
    tasks = None
    if strategy == "auto" or salts is None and strategy == "salted":
        n, pairs = _sizes(keys, subs)
        # subscriptions are few bytes, so AQE would put them, and with them all that they are joined to, into a few tasks
        if pairs > ROWS_PER_TASK:
            tasks = max(pairs // ROWS_PER_TASK + 1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        strategy = strategy if strategy == "salted" else "broadcast" if n <= max_rows else "salted"
        salts = salts or n // ROWS_PER_SALT + 1
    if strategy == "broadcast":
        m = F.broadcast(keys.withColumnRenamed("topic", "m_topic"))
        s = subs.repartition(tasks, "uid") if tasks else subs.repartition("uid")  # join output keeps this partitioning
        cond = s.topic == m.m_topic
        if visible:
            cond = cond & (s.created_ts <= m.entry_ts)
        return s.join(m, cond).select("uid", "entry_id", "entry_ts", "doc", "topic")
    if strategy == "salted":
        m = keys.select("*", F.pmod(F.xxhash64("entry_id"), F.lit(salts)).alias("salt"))
        s = subs.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        j = s.join(m, ["topic", "salt"])
        if visible:
            j = j.where(F.col("created_ts") <= F.col("entry_ts"))
        return j.select("uid", "entry_id", "entry_ts", "doc", "topic")
    if strategy == "shuffle":
        j = subs.join(keys, "topic")
        if visible:
            j = j.where(F.col("created_ts") <= F.col("entry_ts"))
        return j.select("uid", "entry_id", "entry_ts", "doc", "topic")
    raise ValueError(f"unknown strategy {strategy!r}")


def fanout_join(messages: DataFrame, subs: DataFrame, strategy: str = "auto", salts: int | None = None,
                max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Each message x each subscriber of its topic -> uid, entry_id, entry_ts, doc, topic."""
    return _join(message_keys(messages), subs, False, strategy, salts, max_rows)


def fanout_visible(messages: DataFrame, subs: DataFrame, strategy: str = "auto", salts: int | None = None,
                   max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """As D1, but only subscribers created at or before the message time get it."""
    return _join(message_keys(messages), subs, True, strategy, salts, max_rows)


def fanout_visible_keys(keys: DataFrame, subs: DataFrame, strategy: str = "auto", salts: int | None = None,
                        max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """D2 over already key-only messages (entry_id, entry_ts, doc, topic)."""
    return _join(keys, subs, True, strategy, salts, max_rows)


def unsubscribed_topics(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Topics that have messages but no subscriber (read and dropped)."""
    t = messages.select("topic").distinct()
    return t.join(subs.select("topic").distinct(), "topic", "left_anti")
