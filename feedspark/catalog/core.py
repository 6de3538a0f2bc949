"""Fan-out, de-duplication and feed queries (D1-D3, D8, F1, F3, F4, flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle import with_views
from ..operators.dedup import anchored_ttl_epochs, epochs_in_ranges, first_seen_dedup, time_edges, timeline_in_ranges
from ..operators.deliveries import Deliveries
from ..operators.fan_out import fanout_join, fanout_visible, message_keys, unsubscribed_topics
from ..plans.feed import feed_candidates, feed_with_payload, lives_needed_from, user_feed, visible_top_n
from ..sources import fixtures as fx
from . import register

# --- DuckDB pieces shared by several oracles --------------------------------
ATT_SQL = """att AS (SELECT s.uid, m.entry_ts ts, m.entry_id, m.seq, coalesce(nullif(m.id,''), m.entry_id) doc, m.topic
   FROM articles m JOIN subscriptions s ON m.topic=s.topic AND s.created_ts<=m.entry_ts)"""

EPOCHS_SQL = """r(uid, anchor) AS (SELECT uid, min(ts) FROM {src} GROUP BY uid UNION ALL
   SELECT r.uid, (SELECT min(e.ts) FROM {src} e WHERE e.uid=r.uid AND e.ts>=r.anchor+INTERVAL 24 HOURS) FROM r
   WHERE EXISTS(SELECT 1 FROM {src} e WHERE e.uid=r.uid AND e.ts>=r.anchor+INTERVAL 24 HOURS))"""

FEED_SQL = ATT_SQL + """,
 """ + EPOCHS_SQL.format(src="att") + """,
 x AS (SELECT a.*, r.anchor ep FROM att a ASOF JOIN r ON a.uid=r.uid AND a.ts>=r.anchor),
 k AS (SELECT *, row_number() OVER (PARTITION BY uid,ep,doc ORDER BY ts,seq,entry_id) rn FROM x),
 f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, seq DESC, entry_id DESC) pos FROM k WHERE rn=1)"""


def feed_oracle(select: str) -> str:
    """Oracle text with the flagship feed available as view ``f`` (pos <= 100 filter not applied)."""
    return with_views(select, "articles", "subscriptions", recursive=True, extra=FEED_SQL)


# --- flagship ----------------------------------------------------------------
@register("user_feed", feed_oracle("SELECT uid, doc, pos FROM f WHERE pos<=100"))
def q_user_feed(t):
    """Newest 100 articles of each user's feed: D2 -> F4 -> F3 -> F1 (exact path)."""
    f = user_feed(fx.articles(t), fx.subscriptions(t), n=100, bounded="auto")
    return f.select("uid", "doc", "pos")


@register("user_feed_bounded", with_views("""
SELECT uid, doc, pos FROM (
  SELECT s.uid, coalesce(nullif(m.id,''), m.entry_id) doc,
    row_number() OVER (PARTITION BY s.uid ORDER BY m.entry_ts DESC, m.seq DESC, m.entry_id DESC) pos
  FROM originals m JOIN subscriptions s ON m.topic=s.topic AND s.created_ts<=m.entry_ts) q
WHERE pos <= 100""", "originals", "subscriptions"))
def q_user_feed_bounded(t):
    """Flagship on first ingests only: as no document repeats (checked), the bounded plan (§4.3.1) is taken."""
    f = user_feed(fx.originals(t), fx.subscriptions(t), n=100, bounded=True)
    return f.select("uid", "doc", "pos")


@register("user_feed_continued", feed_oracle("SELECT uid, doc, pos FROM f WHERE pos<=100"))
def q_user_feed_continued(t):
    """The flagship as a daily job: the lives of three quarters of the time are walked range by range, and those that a
    later feed can need are stored; the feed goes on from them and walks the times of the last quarter only."""
    articles, subs = fx.articles(t), fx.subscriptions(t)
    times = message_keys(articles).select("topic", "entry_ts")
    us = F.unix_micros("entry_ts")
    edges = time_edges(times, us, 4)
    until = edges[-2]
    since = lives_needed_from(articles.where(us < until), until, 100)
    lives = timeline_in_ranges(times.where(us < until), subs, 3, emit_from_us=since)
    return user_feed(articles, subs, n=100, lives=lives, lives_until_us=until).select("uid", "doc", "pos")


@register("feed_with_payload", feed_oracle("""
SELECT f.uid, f.pos, f.entry_id, f.doc, a.title, a.topic, length(a.text) AS body_chars, md5(a.text) AS body_md5
FROM f JOIN articles a ON f.entry_id = a.entry_id WHERE f.pos <= 100"""))
def q_feed_with_payload(t):
    """The flagship feed with its content: title and topic, and the body's length and digest."""
    a = fx.articles(t)
    in_reach = feed_candidates(message_keys(a), 100).checkpoint()
    bodies = a.select("entry_id", "title", "topic", F.length("text").cast("bigint").alias("body_chars"), F.md5("text").alias("body_md5"))
    f = feed_with_payload(user_feed(a, fx.subscriptions(t), n=100, candidates=in_reach), bodies,
                          ("title", "topic", "body_chars", "body_md5"), in_reach)
    return f.select("uid", "pos", "entry_id", "doc", "title", "topic", "body_chars", "body_md5")


# --- joins ---------------------------------------------------------------------
@register("fanout_join", with_views("""
SELECT s.uid, m.entry_id, m.entry_ts, coalesce(nullif(m.id,''), m.entry_id) AS doc, m.topic
FROM articles m JOIN subscriptions s ON m.topic = s.topic""", "articles", "subscriptions"))
def q_fanout_join(t):
    """Every message x every subscriber of its topic."""
    return fanout_join(fx.articles(t), fx.subscriptions(t))


@register("fanout_visible", with_views("""
SELECT s.uid, m.entry_id, m.entry_ts, coalesce(nullif(m.id,''), m.entry_id) AS doc, m.topic
FROM articles m JOIN subscriptions s ON m.topic = s.topic AND s.created_ts <= m.entry_ts""",
                                       "articles", "subscriptions"))
def q_fanout_visible(t):
    """Only subscribers created at or before the message get it."""
    return fanout_visible(fx.articles(t), fx.subscriptions(t))


@register("dedupe_unseen", with_views("""
SELECT d.uid, d.entry_id, d.entry_ts, d.doc, d.topic FROM
 (SELECT s.uid, m.entry_id, m.entry_ts, coalesce(nullif(m.id,''), m.entry_id) AS doc, m.topic
  FROM articles m JOIN subscriptions s ON m.topic = s.topic AND s.created_ts <= m.entry_ts) d
WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.uid = d.uid AND a.doc_id = d.doc)""",
                                      "articles", "subscriptions", "attempts"))
def q_dedupe_unseen(t):
    """D3: visible deliveries minus documents already in the user's seen set (attempts)."""
    return _unseen(t).expand()


def _unseen(t):
    return Deliveries.of(fx.articles(t), fx.subscriptions(t)).unseen(fx.attempts(t).select("uid", "doc_id"))


UNSEEN_SQL = ATT_SQL + """,
 un AS (SELECT * FROM att d WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.uid = d.uid AND a.doc_id = d.doc))"""


@register("unseen_per_user", with_views("""
SELECT s.uid, count(un.uid) AS deliveries FROM (SELECT DISTINCT uid FROM subscriptions) s LEFT JOIN un ON un.uid = s.uid GROUP BY s.uid""",
                                        "articles", "subscriptions", "attempts", extra=UNSEEN_SQL))
def q_unseen_per_user(t):
    """D2 + D3 counted per user from the factors, without building a delivery."""
    return _unseen(t).per_user()


@register("unseen_per_message", with_views("""
SELECT m.entry_id, m.topic, count(un.uid) AS deliveries FROM articles m LEFT JOIN un ON un.entry_id = m.entry_id GROUP BY ALL""",
                                           "articles", "subscriptions", "attempts", extra=UNSEEN_SQL))
def q_unseen_per_message(t):
    """D2 + D3 counted per message from the factors, without building a delivery."""
    return _unseen(t).per_message()


@register("unseen_in_range", with_views("""
SELECT uid, entry_id, ts AS entry_ts, doc, topic FROM un
WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-05 00:00:00'""",
                                        "articles", "subscriptions", "attempts", extra=UNSEEN_SQL))
def q_unseen_in_range(t):
    """D2 + D3 expanded for two days of messages."""
    return _unseen(t).between("2024-01-03 00:00:00", "2024-01-05 00:00:00").expand()


@register("unsubscribed_topics", with_views("""
SELECT DISTINCT m.topic FROM articles m
WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.topic = m.topic)""", "articles", "subscriptions"))
def q_unsubscribed_topics(t):
    """Topics with messages but no subscriber."""
    return unsubscribed_topics(fx.articles(t), fx.subscriptions(t))


# --- ordered: epochs, dedup, top-N ------------------------------------------------
@register("anchored_ttl_epochs", with_views(
    "SELECT uid, anchor FROM r", "attempts", recursive=True, extra=EPOCHS_SQL.format(src="attempts")))
def q_anchored_ttl_epochs(t):
    """per-user 24 h seen-set lives anchored at the first attempt after expiry."""
    return anchored_ttl_epochs(fx.attempts(t))


@register("epochs_in_ranges", with_views(
    "SELECT uid, anchor FROM r", "attempts", recursive=True, extra=EPOCHS_SQL.format(src="attempts")))
def q_epochs_in_ranges(t):
    """F4 in four time ranges: each goes on from the last life of every user before it, as a daily job does."""
    return epochs_in_ranges(fx.attempts(t), 4)


@register("first_seen_dedup", with_views("""
SELECT uid, ts, event_id, doc_id, tag, epoch FROM (
  SELECT x.*, row_number() OVER (PARTITION BY uid, epoch, doc_id ORDER BY ts, event_id) rn
  FROM (SELECT a.*, r.anchor AS epoch FROM attempts a ASOF JOIN r ON a.uid = r.uid AND a.ts >= r.anchor) x) k
WHERE rn = 1""", "attempts", recursive=True, extra=EPOCHS_SQL.format(src="attempts")))
def q_first_seen_dedup(t):
    """first delivery of each document per user inside one seen-set life."""
    return first_seen_dedup(fx.attempts(t), "doc_id", "uid", "ts", ("event_id",))


@register("feed_top_n", with_views("""
SELECT uid, entry_id, doc, pos FROM (
  SELECT s.uid, m.entry_id, coalesce(nullif(m.id,''), m.entry_id) AS doc,
    row_number() OVER (PARTITION BY s.uid ORDER BY m.entry_ts DESC, m.seq DESC, m.entry_id DESC) AS pos
  FROM articles m JOIN subscriptions s ON m.topic = s.topic AND s.created_ts <= m.entry_ts) q
WHERE pos <= 100""", "articles", "subscriptions"))
def q_feed_top_n(t):
    """newest 100 visible deliveries per user (before de-duplication), with the per-topic bound."""
    return visible_top_n(message_keys(fx.articles(t)), fx.subscriptions(t), 100).select(
        "uid", "entry_id", "doc", "pos")

