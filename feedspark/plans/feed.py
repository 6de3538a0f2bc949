"""The flagship plan: newest N articles in each user's feed.

Semantics: visible fan-out (D2) -> anchored TTL epochs (F4) -> first-seen
de-duplication (F3) -> newest N per user (F1). Only key columns travel; the
payload is joined back at output time.

Plan (exact for any input, see ``feed_candidates``): only the messages that
can reach some user's newest N are fanned out: per topic the window down to
the N-th newest message that cannot be a duplicate, plus the earlier copies
that decide the possible duplicates in it. Their deliveries get epochs, whose
anchors are walked per block of users along the topic timelines of all
messages, then first-seen de-duplication and the newest N per user. The
join input is about topics x (N + possible duplicates) messages whatever the
length of the logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEED_CAP, MICROS_PER_SECOND, SEEN_TTL_SECONDS
from ..functions.messages import entry_seq
from ..operators.dedup import first_seen_dedup, timeline_anchors
from ..operators.fan_out import fanout_visible_keys, message_keys
from ..operators.retention import feed_top_n, keep_last
from ..session import checkpoint_dir
from .ordering import chunked_lag


def visible_top_n(keys: DataFrame, subscriptions: DataFrame, n: int = FEED_CAP,
                  strategy: str = "auto") -> DataFrame:
    """Newest ``n`` visible deliveries per user, without de-duplication.

    Exact for any input: each topic is cut to its newest ``n`` messages before
    the join (a user's newest ``n`` lie in the union of the topics' newest
    ``n``, and visibility keeps a time suffix of each topic).
    """
    top = keep_last(keys, n, ["topic"], ("entry_ts", "entry_id")).drop("pos")
    att = fanout_visible_keys(top, subscriptions, strategy).withColumnRenamed("entry_ts", "ts")
    return feed_top_n(att.select("uid", "entry_id", "doc", "ts", "topic"), n, ("ts", "entry_id"))


def feed_candidates(keys: DataFrame, n: int = FEED_CAP, ttl_seconds: int = SEEN_TTL_SECONDS) -> DataFrame:
    """The messages that can matter for any user's newest ``n`` kept deliveries.

    A message is *possibly a duplicate* only if its document has an earlier
    copy less than ``ttl`` before it: a seen-set life is shorter than ``ttl``,
    so any other message is kept for every user who sees it. Per topic, a
    user's newest ``n`` kept lie at or after the ``n``-th newest message that is
    not possibly a duplicate (those are all kept, and visibility keeps a time
    suffix). Candidates = that window of every topic, plus the earlier copies
    (less than ``ttl`` before) of the possible duplicates in it, which decide
    whether those are duplicates. Exact for any input.
    """
    ttl_us = int(ttl_seconds) * MICROS_PER_SECOND
    us = F.unix_micros("entry_ts")
    prev = chunked_lag(keys.withColumn("_us", us).withColumn("_seq", entry_seq()), ["doc"], F.floor(F.col("_us") / ttl_us),
                       ["_us", "_seq", "entry_id"], "_us", out="_prev_us")
    m = prev.withColumn("_maybe_dup", F.col("_prev_us").isNotNull() & (F.col("_us") - F.col("_prev_us") < ttl_us))
    sure = keep_last(m.where(~F.col("_maybe_dup")), n, ["topic"], ("entry_ts", "entry_id"))
    cut = sure.groupBy("topic").agg(F.min(F.struct("_us", "_seq", "entry_id")).alias("_cut"),
                                    F.count(F.lit(1)).alias("_n_sure"))
    w = m.join(cut, "topic", "left").where(
        F.col("_cut").isNull() | (F.col("_n_sure") < n) | (F.struct("_us", "_seq", "entry_id") >= F.col("_cut")))
    dup_docs = w.where("_maybe_dup").groupBy("doc").agg(F.min("_us").alias("_first_dup_us"))
    earlier = m.join(dup_docs, "doc").where(F.col("_us") >= F.col("_first_dup_us") - ttl_us)
    cols = ["entry_id", "entry_ts", "doc", "topic"]
    both = w.select(*cols).unionByName(earlier.select(*cols)).distinct()
    # documents whose deliveries need epochs and de-duplication; all others are kept
    return both.join(dup_docs.select("doc", F.lit(True).alias("_dedup")), "doc", "left").select(
        *cols, F.coalesce("_dedup", F.lit(False)).alias("needs_dedup"))


def lives_needed_from(history: DataFrame, until_us: int, n: int = FEED_CAP, ttl_seconds: int = SEEN_TTL_SECONDS) -> int:
    """The time from which a later feed can need the lives of ``history``, the messages before ``until_us``; of older lives
    it needs each user's last.

    What comes later only moves the windows of ``feed_candidates`` on. So a message of the history that needs an
    epoch then is a candidate now, or a copy less than ``ttl`` before a message from ``until_us`` on; the life that it lies in
    began less than ``ttl`` before it.
    """
    checkpoint_dir(history.sparkSession)
    keys = message_keys(history).checkpoint()
    lo = feed_candidates(keys, n, ttl_seconds).agg(F.min(F.unix_micros("entry_ts"))).first()[0]
    ttl_us = int(ttl_seconds) * MICROS_PER_SECOND
    return min(x for x in (lo, until_us - ttl_us) if x is not None) - ttl_us


def user_feed(messages: DataFrame, subscriptions: DataFrame, n: int = FEED_CAP,
              ttl_seconds: int = SEEN_TTL_SECONDS, bounded: str | bool = "auto",
              strategy: str = "auto", lives: DataFrame | None = None, lives_until_us: int | None = None,
              candidates: DataFrame | None = None) -> DataFrame:
    """-> uid, pos, entry_id, doc, ts (pos 1 = newest).

    ``bounded="auto"`` (default, exact for any input): only ``feed_candidates``
    are fanned out (about topics x (n + possible duplicates) messages); the
    deliveries of documents with a possible duplicate get epochs and first-seen
    de-duplication, all others are kept as they are; then the newest ``n`` per
    user. Epoch anchors come from the topic timelines of *all* messages (``timeline_anchors``).
    ``bounded=True`` takes the no-dedup bounded plan if no document repeats (checked), else the default;
    ``bounded=False`` forces the plain exact chain D2 -> F4 -> F3 -> F1.
    ``lives`` (uid, anchor_us): stored lives of all messages before ``lives_until_us`` (``timeline_in_ranges``, or the
    run before, with the same subscriptions as far as they are older); only later message times are walked then. Of lives
    before ``lives_needed_from`` each user's last is enough.
    ``candidates``: ``feed_candidates`` of the messages, if the caller has stored them.
    """
    keys = message_keys(messages)
    if bounded is True and keys.groupBy("doc").count().where("count > 1").isEmpty():
        return visible_top_n(keys, subscriptions, n, strategy).drop("topic")
    if bounded is False:
        att = fanout_visible_keys(keys, subscriptions, strategy).withColumnRenamed("entry_ts", "ts")
        kept = first_seen_dedup(att, "doc", "uid", "ts", ("entry_id",), ttl_seconds)
        return feed_top_n(kept.select("uid", "entry_id", "doc", "ts"), n, ("ts", "entry_id"))
    # the key-only messages feed several branches below: write them once to the
    # shared checkpoint folder (spark.checkpoint.dir) and cut the lineage
    checkpoint_dir(messages.sparkSession)
    keys = keys.checkpoint()
    cand = feed_candidates(keys, n, ttl_seconds).checkpoint() if candidates is None else candidates
    cols = ["uid", "entry_id", "doc", "ts"]
    sure = fanout_visible_keys(cand.where(~F.col("needs_dedup")).drop("needs_dedup"), subscriptions, strategy)
    sure = sure.withColumnRenamed("entry_ts", "ts").select(*cols)
    dedup_msgs = cand.where(F.col("needs_dedup")).drop("needs_dedup")
    lo = dedup_msgs.agg(F.min("entry_ts")).first()[0]  # one row; None: nothing to de-duplicate
    if lo is None:
        return feed_top_n(sure, n, ("ts", "entry_id"))
    att = fanout_visible_keys(dedup_msgs, subscriptions, strategy).withColumnRenamed("entry_ts", "ts")
    from_us = int(lo.timestamp() * 1_000_000) - int(ttl_seconds) * MICROS_PER_SECOND  # older lives hold none
    times = keys.select("topic", "entry_ts")
    if lives is None:
        anchors = timeline_anchors(times, subscriptions, ttl_seconds, emit_from_us=from_us)
    else:
        later = times.where(F.unix_micros("entry_ts") >= lives_until_us)
        new = timeline_anchors(later, subscriptions, ttl_seconds, emit_from_us=from_us, carried=lives)
        anchors = lives.select("uid", "anchor_us").where(F.col("anchor_us") >= from_us).unionByName(new)
    kept = first_seen_dedup(att, "doc", "uid", "ts", ("entry_id",), ttl_seconds, anchors=anchors)
    return feed_top_n(sure.unionByName(kept.select(*cols)), n, ("ts", "entry_id"))


#: Size up to which the payload of the messages in reach is broadcast.
PAYLOAD_MAX_BYTES = 64 << 20


def feed_with_payload(feed: DataFrame, messages: DataFrame, columns: tuple[str, ...] = ("title", "text", "topic"),
                      reach: DataFrame | None = None, max_bytes: int = PAYLOAD_MAX_BYTES) -> DataFrame:
    """Late payload join: ``columns`` (title and body) only for the rows that survived.

    ``reach`` (entry_id): messages that hold all entries of the feed (``feed_candidates``). A user's entry is one of few
    messages, so their payload is stored and, if it is small, broadcast: the feed does not move, and nothing that is
    derived from a body is computed once per reader.
    """
    payload = messages.select("entry_id", *columns)
    if reach is None:
        return feed.join(payload, "entry_id")
    checkpoint_dir(messages.sparkSession)
    payload = payload.join(reach.select("entry_id").distinct(), "entry_id", "left_semi").checkpoint()
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in payload.columns), F.lit(32 * len(payload.columns)))
    size = payload.agg(F.sum(width.cast("long"))).first()[0] or 0
    return feed.join(F.broadcast(payload) if size <= max_bytes else payload, "entry_id")
