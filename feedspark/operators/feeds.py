"""Read-path and ordered operators.

Orderings that would otherwise run as one window per hot key use the
range numbering of ``plans.ordering``; windows over a feed
are bounded by the feed cap and stay plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSIFY_BATCH, TOPIC_BACKLOG
from ..functions.messages import entry_seq, log_order, parse_entry_id
from ..plans.ordering import numbered, run_positions, running_sum
from ..sources.fixtures import topics_array


def backlog_latest(log: DataFrame, keys: list[str], n: int = TOPIC_BACKLOG,
                   order=("entry_ts", "entry_id")) -> DataFrame:
    """the newest ``n`` entries of each log, returned oldest -> newest (``pos`` 1 = oldest)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in log_order(order)])
    kept = log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # bounded: <= n rows per key
    return kept.withColumn("pos", (cnt - F.col("_rn") + 1).cast("int")).drop("_rn")


def cursors_at(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Cursor of each log after a backlog read at time ``at``: the last id at or before it."""
    before = log.where(F.col("entry_ts") <= F.lit(at).cast("timestamp"))
    ms = parse_entry_id("entry_id")
    return before.groupBy(*keys).agg(
        F.max_by("entry_id", F.struct(ms, entry_seq("entry_id"))).alias("cursor"))


def tail_after_cursor(log: DataFrame, cursors: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """entries strictly after each consumer's cursor, numbered in log order -> keys, entry_id, tail_pos.
    Payloads are joined by the entry's id. ``bounded``: no key has more entries than a feed's cap, so they are numbered
    where they lie by a window per key; a log of any length is numbered by ranges."""
    c = cursors.select(*keys, parse_entry_id("cursor").alias("_cms"), entry_seq("cursor").alias("_cseq"))
    ms, seq = parse_entry_id("entry_id"), entry_seq("entry_id")
    d = log.select(*keys, "entry_id", ms.alias("_ms"), seq.alias("_seq")).join(c.hint("shuffle_hash") if bounded else c, keys)
    after = d.where((F.col("_ms") > F.col("_cms")) | ((F.col("_ms") == F.col("_cms")) & (F.col("_seq") > F.col("_cseq"))))
    after = after.drop("_cms", "_cseq")
    if bounded:
        w = Window.partitionBy(*keys).orderBy("_ms", "_seq", "entry_id")
        r = after.withColumn("tail_pos", F.row_number().over(w).cast("bigint"))
    else:
        r = numbered(after, keys, ["_ms", "_seq", "entry_id"], out="tail_pos")
    return r.drop("_ms", "_seq")


def fifo_consume(feed: DataFrame, pops: DataFrame) -> DataFrame:
    """pop the oldest ``k`` of each feed (``pops``: uid, k) -> uid, popped, remaining.

    ``pos`` of the feed is 1 = newest, so the oldest has the highest ``pos``.
    """
    k = pops.groupBy("uid").agg(F.sum("k").alias("k"))
    f = feed.join(k, "uid", "left").select("uid", "pos", F.coalesce("k", F.lit(0)).alias("k"))
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))  # bounded by the feed cap
    marked = f.withColumn("_oldest_rank", n - F.col("pos") + 1)
    return marked.groupBy("uid").agg(
        F.count_if(F.col("_oldest_rank") <= F.col("k")).alias("popped"),
        F.count_if(F.col("_oldest_rank") > F.col("k")).alias("remaining"))


def running_backlog(steps: DataFrame, reader: str = "reader", order=("ts", "event_id")) -> DataFrame:
    """F8: gauge recurrence: -1 per pop, + remaining length each step; published floored at 0.

    steps: reader, ts, event_id, popped (0/1), len_after.
    """
    r = running_sum(steps, [reader], list(order), F.col("len_after") - F.col("popped"), out="backlog")
    return r.withColumn("published", F.greatest(F.lit(0), F.col("backlog")).cast("bigint"))


def micro_batches(log: DataFrame, size: int = CLASSIFY_BATCH, keys: list[str] | None = None,
                  order=("entry_ts", "entry_id")) -> DataFrame:
    """number entries into batches of ``size`` (0-based); ``is_full`` false for the held tail.
    -> keys, entry_id, the order columns, batch_no, is_full; payloads are joined by the entry's id."""
    keys = keys or []
    slim = log.select(*dict.fromkeys([*keys, "entry_id", *order]))
    r = numbered(slim, keys, log_order(order), out="_rn", total_col="_n")
    return r.select(
        *slim.columns,
        F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("batch_no"),
        (F.floor((F.col("_rn") - 1) / size) < F.floor(F.col("_n") / size)).alias("is_full"),
    )


def batch_full(batches: DataFrame) -> DataFrame:
    """Only complete batches are processed; the tail waits."""
    return batches.where("is_full")


def _clicks(clicks: DataFrame, uid: str, tag: str, order) -> DataFrame:
    """The columns of the clicks that the fold reads, with each click's place in its run of equal consecutive tags."""
    return run_positions(clicks.select(*dict.fromkeys([uid, tag, *order])), [uid], list(order), tag, out="_p")


def toggle_topic(clicks: DataFrame, uid: str = "uid", tag: str = "tag",
                 order=("ts", "event_id")) -> DataFrame:
    """active topic after each click; clicking the active topic again turns it off. -> uid, tag, order, active.

    A run of clicks on one topic turns it on and off in turn, and another topic's click always turns that one on; so the
    fold over all clicks is the place in the run, in one sort by ranges."""
    return _clicks(clicks, uid, tag, order).select("*", F.when(F.col("_p") % 2 == 1, F.col(tag)).alias("active")).drop("_p")


def reset_topic_on_switch(clicks: DataFrame, users: DataFrame, uid: str = "uid", tag: str = "tag",
                          order=("ts", "event_id")) -> DataFrame:
    """F10 per viewed user; a topic that is not one of the user's interests clears the filter.
    -> uid, tag, order, active.

    The interests of a user without a record are not known, so nothing is cleared for them."""
    p = _clicks(clicks, uid, tag, order).join(users.select(F.col("uid").alias(uid), "interests"), uid, "left")
    on = (F.col("_p") % 2 == 1) & F.coalesce(F.array_contains("interests", F.col(tag)), F.lit(True))
    return p.select("*", F.when(on, F.col(tag)).alias("active")).drop("_p", "interests")


def _with_refresh_batches(messages: DataFrame, refreshes: DataFrame, uid: str = "uid") -> DataFrame:
    """Messages with: batch = refreshes before them, total refreshes, first-message flag."""
    u = (messages.select(uid, "ts", "event_id", F.lit(0).alias("_r"))
         .unionByName(refreshes.select(uid, "ts", "event_id", F.lit(1).alias("_r"))))
    run = running_sum(u, [uid], ["ts", "event_id", "_r"], F.col("_r"), out="_seen_r")
    tot = refreshes.groupBy(uid).agg(F.count(F.lit(1)).alias("_nref"))
    first = messages.groupBy(uid).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    m = run.where(F.col("_r") == 0).join(tot, uid, "left").join(first, uid)
    return m.select(
        uid, "ts", "event_id", F.col("_seen_r").cast("bigint").alias("batch"),
        F.coalesce("_nref", F.lit(0)).cast("bigint").alias("refreshes"),
        (F.struct("ts", "event_id") == F.col("_first")).alias("is_first"))


def pending_since_refresh(messages: DataFrame, refreshes: DataFrame, uid: str = "uid") -> DataFrame:
    """per user, messages shown vs pending.

    The first message is shown on load; later ones wait until a refresh,
    so those after the last refresh are pending.
    """
    m = _with_refresh_batches(messages, refreshes, uid)
    shown = F.col("is_first") | (F.col("batch") < F.col("refreshes"))
    return m.groupBy(uid).agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("pending"))


def merge_feed_refresh(messages: DataFrame, refreshes: DataFrame, uid: str = "uid") -> DataFrame:
    """Display order after the refreshes: each refresh puts the pending batch
    ahead of what is shown (``pending ++ shown``) -> uid, event_id, display_pos."""
    m = _with_refresh_batches(messages, refreshes, uid)
    shown = m.where(F.col("is_first") | (F.col("batch") < F.col("refreshes")))
    grp = F.when(F.col("is_first"), F.lit(-1)).otherwise(F.col("batch"))
    s = shown.withColumn("_g", grp)
    r = numbered(s, [uid], [F.col("_g").desc(), "ts", "event_id"], out="display_pos")
    return r.select(uid, "event_id", "display_pos")


def feed_topic_filter(feed: DataFrame, users: DataFrame, active: Column) -> DataFrame:
    """Filter a feed by the active topic only when the user has that interest
    and the feed holds at least one message of it; otherwise no filter (so neither for a
    user without a record nor while no topic is active, NULL)."""
    j = feed.join(users.select("uid", "interests"), "uid", "left").withColumn("_active", active)
    # window over one user's feed: bounded by the feed cap
    has = F.max((F.col("topic") == F.col("_active")).cast("int")).over(Window.partitionBy("uid"))
    j = j.withColumn("_has", has)
    applies = F.coalesce(F.array_contains("interests", F.col("_active")) & (F.col("_has") == 1), F.lit(False))
    return j.where(~applies | (F.col("topic") == F.col("_active"))).drop("_active", "_has", "interests")


def union_topics(log: DataFrame) -> DataFrame:
    """All topic logs as one input in a fixed total order:
    (entry ms, entry seq, topic ordinal, entry id) -> entry_id, topic, topic_ord, read_pos."""
    ordn = (F.array_position(topics_array(), F.col("topic")) - 1).cast("int")
    d = log.select("entry_id", "topic", parse_entry_id("entry_id").alias("_ms"), entry_seq("entry_id").alias("_seq"),
                   ordn.alias("topic_ord"))
    r = numbered(d, [], ["_ms", "_seq", "topic_ord", "entry_id"], out="read_pos")
    return r.drop("_ms", "_seq")
