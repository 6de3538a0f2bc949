"""Ordered and read-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds as FD
from ..operators.retention import retain_last_global, retain_last_per_topic
from ..oracle import TOP, with_views
from ..sources import fixtures as fx
from . import register
from .aggregates import FEED1_SQL, _feed1

MS_SQL = "TRY_CAST(split_part({c}, '-', 1) AS BIGINT)"
SEQ_SQL = "coalesce(TRY_CAST(split_part({c}, '-', 2) AS BIGINT), 0)"


@register("retain_last_per_topic", with_views("""
SELECT topic, entry_id, pos FROM (SELECT topic, entry_id,
  row_number() OVER (PARTITION BY topic ORDER BY entry_ts DESC, seq DESC, entry_id DESC) AS pos FROM articles) q
WHERE pos <= 100""", "articles"))
def q_retain_last_per_topic(t):
    """exact keep-last-100 of every topic log."""
    return retain_last_per_topic(fx.articles(t), 100).select("topic", "entry_id", "pos")


@register("retain_last_global", with_views("""
SELECT entry_id, topic FROM articles ORDER BY entry_ts DESC, seq DESC, entry_id DESC LIMIT 5000""", "articles"))
def q_retain_last_global(t):
    """Newest 5,000 raw entries overall (read or not)."""
    return retain_last_global(fx.articles(t), 5000).select("entry_id", "topic")


@register("backlog_latest", with_views("""
SELECT topic, entry_id, CAST(least(cnt, 50) - rn + 1 AS INTEGER) AS pos FROM (
  SELECT topic, entry_id, row_number() OVER (PARTITION BY topic ORDER BY entry_ts DESC, seq DESC, entry_id DESC) AS rn,
    count(*) OVER (PARTITION BY topic) AS cnt FROM articles) q WHERE rn <= 50""", "articles"))
def q_backlog_latest(t):
    """last 50 entries of each topic log, oldest first."""
    return FD.backlog_latest(fx.articles(t), ["topic"], 50).select("topic", "entry_id", "pos")


@register("tail_after_cursor", with_views(f"""
SELECT topic, entry_id, row_number() OVER (PARTITION BY topic ORDER BY ms, seq) AS tail_pos FROM (
  SELECT a.topic, a.entry_id, {MS_SQL.format(c='a.entry_id')} AS ms, {SEQ_SQL.format(c='a.entry_id')} AS seq,
    c.cms, c.cseq FROM articles a JOIN (
    SELECT topic, ms AS cms, seq AS cseq FROM (
      SELECT topic, {MS_SQL.format(c='entry_id')} AS ms, {SEQ_SQL.format(c='entry_id')} AS seq,
        row_number() OVER (PARTITION BY topic ORDER BY {MS_SQL.format(c='entry_id')} DESC,
                           {SEQ_SQL.format(c='entry_id')} DESC) AS rn
      FROM articles WHERE entry_ts <= TIMESTAMP '2024-01-15 00:00:00') x WHERE rn = 1) c ON a.topic = c.topic) j
WHERE ms > cms OR (ms = cms AND seq > cseq)""", "articles"))
def q_tail_after_cursor(t):
    """entries after each topic consumer's cursor (the last id of a backlog read on Jan 15)."""
    a = fx.articles(t)
    cur = FD.cursors_at(a, ["topic"], "2024-01-15 00:00:00")
    return FD.tail_after_cursor(a, cur, ["topic"]).select("topic", "entry_id", "tail_pos")


@register("user_backlog_latest", with_views("""
SELECT uid, entry_id, CAST(least(cnt, 40) - pos + 1 AS INTEGER) AS pos FROM (
  SELECT *, count(*) OVER (PARTITION BY uid) AS cnt FROM feed1) q WHERE pos <= 40""",
                                            "articles", "subscriptions", extra=FEED1_SQL))
def q_user_backlog_latest(t):
    """F5 per user: the last 40 entries of each user's feed, oldest first."""
    feed = _feed1(t).withColumnRenamed("ts", "entry_ts").drop("pos")
    return FD.backlog_latest(feed, ["uid"], 40).select("uid", "entry_id", "pos")


@register("user_tail_after_cursor", with_views("""
SELECT f.uid, f.entry_id, row_number() OVER (PARTITION BY f.uid ORDER BY f.entry_ts, f.seq) AS tail_pos
FROM feed1 f JOIN feed1 k ON f.uid = k.uid AND k.pos = 1 + k.uid % 50 AND (f.entry_ts, f.seq) > (k.entry_ts, k.seq)""", "articles", "subscriptions", extra=FEED1_SQL))
def q_user_tail_after_cursor(t):
    """F6 per user: feed entries after each user's own cursor (users have 0 to 49 entries left to read)."""
    feed = _feed1(t)
    cur = feed.where(F.col("pos") == 1 + F.col("uid") % 50).select("uid", F.col("entry_id").alias("cursor"))
    return FD.tail_after_cursor(feed, cur, ["uid"], bounded=True).select("uid", "entry_id", "tail_pos")


@register("fifo_consume", with_views("""
SELECT f.uid, count(*) FILTER (WHERE f.n - f.pos + 1 <= coalesce(p.k, 0)) AS popped,
  count(*) FILTER (WHERE f.n - f.pos + 1 > coalesce(p.k, 0)) AS remaining
FROM (SELECT uid, pos, count(*) OVER (PARTITION BY uid) AS n FROM feed1) f
LEFT JOIN (SELECT uid, count(*) AS k FROM attempts WHERE tag = 'view' GROUP BY uid) p ON f.uid = p.uid
GROUP BY f.uid""", "articles", "subscriptions", "attempts", extra=FEED1_SQL))
def q_fifo_consume(t):
    """each 'view' event pops the oldest entry of that user's feed."""
    pops = fx.attempts(t).where(F.col("tag") == "view").select("uid", F.lit(1).alias("k"))
    return FD.fifo_consume(_feed1(t), pops)


def _reader_steps(t):
    e = t.events
    return e.select(
        "event_id", F.col("event_type").alias("reader"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") < 25, 1).otherwise(0).alias("popped"),
        (F.floor("value").cast("bigint") % 100).alias("len_after"))


@register("running_backlog", """
SELECT event_id, reader, backlog, CAST(greatest(0, backlog) AS BIGINT) AS published FROM (
  SELECT event_id, event_type AS reader, CAST(sum(CAST(floor(value) AS BIGINT) % 100
      - CASE WHEN value < 25 THEN 1 ELSE 0 END)
    OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backlog
  FROM events) q""")
def q_running_backlog(t):
    """F8: the published feed-backlog gauge of each reader process (event_type)."""
    r = FD.running_backlog(_reader_steps(t), "reader")
    return r.select("event_id", "reader", F.col("backlog").cast("bigint").alias("backlog"), "published")


BATCH_SQL = """SELECT entry_id, CAST((rn - 1) // 32 AS BIGINT) AS batch_no, (rn - 1) // 32 < n // 32 AS is_full FROM (
  SELECT entry_id, row_number() OVER (ORDER BY entry_ts, seq, entry_id) AS rn, count(*) OVER () AS n FROM articles) q"""


@register("micro_batches", with_views(BATCH_SQL, "articles"))
def q_micro_batches(t):
    """enrich batches of 32 in log order; the held tail is not full."""
    return FD.micro_batches(fx.articles(t), 32).select("entry_id", "batch_no", "is_full")


@register("batch_full", with_views(f"SELECT entry_id, batch_no FROM ({BATCH_SQL}) b WHERE is_full", "articles"))
def q_batch_full(t):
    """Only complete batches of 32 are processed."""
    return FD.batch_full(FD.micro_batches(fx.articles(t), 32)).select("entry_id", "batch_no")


ISLAND_SQL = """SELECT uid, event_id, CASE WHEN p % 2 = 1 {cond} THEN {tag} END AS active FROM (
  SELECT *, row_number() OVER (PARTITION BY uid, {tag}, n - m ORDER BY ts, event_id) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS n,
      row_number() OVER (PARTITION BY uid, {tag} ORDER BY ts, event_id) AS m FROM {src}) a) b"""


@register("toggle_topic", with_views(ISLAND_SQL.format(cond="", tag="tag", src="attempts"), "attempts"))
def q_toggle_topic(t):
    """click sequence -> active topic (same topic twice = off)."""
    return FD.toggle_topic(fx.attempts(t)).select("uid", "event_id", "active")


TOPIC_CLICKS_SQL = f"""clicks AS (SELECT a.uid, a.ts, a.event_id,
  ({TOP})[CAST(a.doc_id AS INT) % 10 + 1] AS topic, u.interests FROM attempts a LEFT JOIN known_users u ON a.uid = u.uid)"""


def _topic_clicks(t):
    a = fx.attempts(t)
    return a.select("uid", "ts", "event_id", fx.topic_at(F.col("doc_id").cast("int") % 10).alias("topic"))


@register("reset_topic_on_switch", with_views(
    ISLAND_SQL.format(cond="AND coalesce(list_contains(interests, topic), true)", tag="topic", src="clicks"),
    "attempts", "known_users", extra=TOPIC_CLICKS_SQL))
def q_reset_topic_on_switch(t):
    """topic chip clicks per viewed user; a topic outside the user's interests clears the filter."""
    r = FD.reset_topic_on_switch(_topic_clicks(t), fx.known_users(t), "uid", "topic")
    return r.select("uid", "event_id", "active")


REFRESH_SQL = """m AS (SELECT uid, ts, event_id FROM attempts WHERE tag <> 'click'),
 rf AS (SELECT uid, ts, event_id FROM attempts WHERE tag = 'click'),
 mb AS (SELECT m.uid, m.ts, m.event_id,
   (SELECT count(*) FROM rf WHERE rf.uid = m.uid AND (rf.ts < m.ts OR (rf.ts = m.ts AND rf.event_id < m.event_id))) AS batch,
   coalesce((SELECT count(*) FROM rf WHERE rf.uid = m.uid), 0) AS refreshes,
   row_number() OVER (PARTITION BY m.uid ORDER BY m.ts, m.event_id) = 1 AS is_first FROM m)"""


@register("pending_since_refresh", with_views("""
SELECT uid, count(*) FILTER (WHERE is_first OR batch < refreshes) AS shown,
  count(*) FILTER (WHERE NOT (is_first OR batch < refreshes)) AS pending FROM mb GROUP BY uid""",
                                              "attempts", extra=REFRESH_SQL))
def q_pending_since_refresh(t):
    """per user, messages shown vs still pending ('click' events are refreshes)."""
    a = fx.attempts(t)
    return FD.pending_since_refresh(a.where(F.col("tag") != "click"), a.where(F.col("tag") == "click"))


@register("merge_feed_refresh", with_views("""
SELECT uid, event_id, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN is_first THEN -1 ELSE batch END DESC,
  ts, event_id) AS display_pos FROM mb WHERE is_first OR batch < refreshes""", "attempts", extra=REFRESH_SQL))
def q_merge_feed_refresh(t):
    """Display order after refreshes (pending ++ shown)."""
    a = fx.attempts(t)
    return FD.merge_feed_refresh(a.where(F.col("tag") != "click"), a.where(F.col("tag") == "click"))


@register("feed_topic_filter", with_views(f"""
SELECT uid, entry_id, topic, pos FROM (
  SELECT f.*, u.interests,
    max(CASE WHEN f.topic = f.active THEN 1 ELSE 0 END) OVER (PARTITION BY f.uid) AS has
  FROM (SELECT *, CASE WHEN uid % 5 <> 0 THEN ({TOP})[CAST((uid * 7) % 9 AS INT) + 1] END AS active FROM feed1) f
  LEFT JOIN known_users u ON f.uid = u.uid) q
WHERE NOT coalesce(list_contains(interests, active) AND has = 1, false) OR topic = active""",
                                          "articles", "subscriptions", "known_users", extra=FEED1_SQL))
def q_feed_topic_filter(t):
    """Filter each feed by the user's active topic (TOPICS[7*uid mod 9]; every fifth user has none) when it applies."""
    active = F.when(F.col("uid") % 5 != 0, fx.topic_at((F.col("uid") * 7) % 9))
    return FD.feed_topic_filter(_feed1(t), fx.known_users(t), active).select("uid", "entry_id", "topic", "pos")


@register("union_topics", with_views(f"""
SELECT entry_id, topic, topic_ord, row_number() OVER (ORDER BY ms, seq, topic_ord, entry_id) AS read_pos FROM (
  SELECT entry_id, topic, CAST(list_position({TOP}, topic) - 1 AS INTEGER) AS topic_ord,
    {MS_SQL.format(c='entry_id')} AS ms, {SEQ_SQL.format(c='entry_id')} AS seq FROM articles) q""", "articles"))
def q_union_topics(t):
    """All topic logs read as one input in a fixed total order."""
    return FD.union_topics(fx.articles(t)).select("entry_id", "topic", "topic_ord", "read_pos")
