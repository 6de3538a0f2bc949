"""User-side joins and counter aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters as C
from ..operators import users as U
from ..operators.dedup import dedup_marks
from ..operators.deliveries import visible_push_counts
from ..operators.fan_out import message_keys
from ..plans.feed import visible_top_n
from ..oracle import BOUNDS_SQL, TOP, with_views
from ..sources import fixtures as fx
from . import register

VISIBLE_SQL = """vis AS (SELECT s.uid, m.entry_id, m.seq, m.entry_ts, coalesce(nullif(m.id,''), m.entry_id) AS doc, m.topic
  FROM articles m JOIN subscriptions s ON m.topic = s.topic AND s.created_ts <= m.entry_ts)"""
FEED1_SQL = VISIBLE_SQL + """,
 feed1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY entry_ts DESC, seq DESC, entry_id DESC) AS pos
   FROM vis) q WHERE pos <= 100)"""
CANDIDATES_SQL = f"""cand AS (SELECT DISTINCT o_custkey * 2 AS uid,
  list_sort([({TOP})[CAST((o_custkey * 6) % 10 AS INT) + 1], ({TOP})[CAST((o_custkey * 6 + 5) % 10 AS INT) + 1]])
  AS interests FROM orders)"""


def _feed1(t):
    """Visible deliveries, newest 100 per user (the feed the read path works on);
    planned with the per-topic bound, which is exact when nothing is de-duplicated."""
    return visible_top_n(message_keys(fx.articles(t)), fx.subscriptions(t), 100)


def _candidates(t):
    """Users a second seeding run proposes: uid = 2 * o_custkey, two topics each."""
    o = t.orders.select((F.col("o_custkey") * 2).alias("uid"), "o_custkey").distinct()
    return o.select("uid", F.array_sort(F.array(
        fx.topic_at((F.col("o_custkey") * 6) % 10),
        fx.topic_at((F.col("o_custkey") * 6 + 5) % 10))).alias("interests"))


@register("user_interests_lookup", with_views("""
SELECT r.uid, array_to_string(coalesce(u.interests, []::VARCHAR[]), '|') AS interests, u.uid IS NOT NULL AS known
FROM (SELECT DISTINCT o_custkey * 2 AS uid FROM orders) r LEFT JOIN users u ON r.uid = u.uid""", "users"))
def q_user_interests_lookup(t):
    """Interests of requested uids; unknown users get an empty list."""
    req = t.orders.select((F.col("o_custkey") * 2).alias("uid"))
    r = U.user_interests_lookup(req, fx.users(t))
    return r.select("uid", F.array_join("interests", "|").alias("interests"), "known")


@register("upsert_users", with_views("""
SELECT uid, array_to_string(interests, '|') AS interests, false AS created FROM users
UNION ALL SELECT c.uid, array_to_string(c.interests, '|'), true FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.uid = c.uid)""", "users", extra=CANDIDATES_SQL))
def q_upsert_users(t):
    """Insert-if-absent of a second seeding run; existing users keep their interests."""
    r = U.upsert_users(_candidates(t), fx.users(t))
    return r.select("uid", F.array_join("interests", "|").alias("interests"), "created")


@register("build_subscription_index", with_views(
    "SELECT DISTINCT topic, uid, created_ts FROM subscriptions", "subscriptions"))
def q_build_subscription_index(t):
    """(topic, uid) index from the users' interest lists."""
    return U.build_subscription_index(fx.users(t))


@register("feed_user_context", with_views("""
SELECT f.uid, f.entry_id, f.pos, array_to_string(u.interests, '|') AS interests
FROM feed1 f LEFT JOIN known_users u ON f.uid = u.uid""", "articles", "subscriptions", "known_users", extra=FEED1_SQL))
def q_feed_user_context(t):
    """Feed rows with their user's interests."""
    j = U.feed_user_context(_feed1(t), fx.known_users(t))
    return j.select("uid", "entry_id", "pos", F.array_join("interests", "|").alias("interests"))


@register("topic_subscribers", with_views(f"""
SELECT t.topic, CAST(count(DISTINCT s.uid) AS BIGINT) AS subscribers
FROM (SELECT unnest({TOP}) AS topic) t LEFT JOIN subscriptions s ON s.topic = t.topic GROUP BY t.topic""",
                                          "subscriptions"))
def q_topic_subscribers(t):
    """Subscriber count per topic, zero included."""
    s = fx.subscriptions(t)
    return U.topic_subscribers(s, s)


@register("enriched_per_topic", with_views(
    "SELECT topic, count(*) AS n FROM articles GROUP BY ROLLUP (topic)", "articles"))
def q_enriched_per_topic(t):
    """Documents routed per topic and in total (NULL topic)."""
    return C.per_topic_counts(fx.articles(t))


@register("fanout_counts", with_views("""
SELECT m.topic, m.messages, CAST(coalesce(d.pushes, 0) AS BIGINT) AS pushes
FROM (SELECT topic, count(*) AS messages FROM articles GROUP BY topic) m
LEFT JOIN (SELECT topic, count(*) AS pushes FROM vis GROUP BY topic) d ON m.topic = d.topic""",
                                      "articles", "subscriptions", extra=VISIBLE_SQL))
def q_fanout_counts(t):
    """Messages consumed and pushes per topic."""
    return C.fanout_counts(visible_push_counts(fx.articles(t), fx.subscriptions(t)))


@register("topic_log_length", with_views("""
SELECT topic, CAST(least(count(*), 10000) AS BIGINT) AS length FROM articles GROUP BY topic
UNION ALL SELECT NULL, CAST(sum(l) AS BIGINT) FROM (SELECT least(count(*), 10000) AS l FROM articles GROUP BY topic) x""",
                                         "articles"))
def q_topic_log_length(t):
    """Topic log lengths after the 10,000 cap, and their sum (fan-out backlog)."""
    return C.topic_log_length(fx.articles(t))


@register("raw_log_length", with_views(
    "SELECT CAST(least(count(*), 5000) AS BIGINT) AS length FROM raw_log", "raw_log"))
def q_raw_log_length(t):
    """E5: raw log length after the exact 5,000 trim."""
    return C.raw_log_length(fx.raw_log(t))


DUP_SQL = """r(uid, anchor) AS (SELECT uid, min(ts) FROM attempts GROUP BY uid UNION ALL
   SELECT r.uid, (SELECT min(e.ts) FROM attempts e WHERE e.uid=r.uid AND e.ts>=r.anchor+INTERVAL 24 HOURS) FROM r
   WHERE EXISTS(SELECT 1 FROM attempts e WHERE e.uid=r.uid AND e.ts>=r.anchor+INTERVAL 24 HOURS))"""


@register("duplicates_skipped", with_views("""
SELECT count(*) AS attempts, count(*) FILTER (WHERE rn > 1) AS skipped,
  round(count(*) FILTER (WHERE rn > 1) / count(*), 9) AS share FROM (
  SELECT row_number() OVER (PARTITION BY x.uid, x.epoch, x.doc_id ORDER BY x.ts, x.event_id) rn
  FROM (SELECT a.*, r.anchor AS epoch FROM attempts a ASOF JOIN r ON a.uid = r.uid AND a.ts >= r.anchor) x) k""",
                                           "attempts", recursive=True, extra=DUP_SQL))
def q_duplicates_skipped(t):
    """Attempts skipped as duplicates inside their seen-set life, and the share."""
    return C.duplicates_skipped(dedup_marks(fx.attempts(t), "doc_id", "uid", "ts", ("event_id",)))


@register("feed_lengths", with_views(
    "SELECT uid, count(*) AS feed_len FROM feed1 GROUP BY uid", "articles", "subscriptions", extra=FEED1_SQL))
def q_feed_lengths(t):
    """Feed length per user."""
    return C.feed_lengths(_feed1(t))


@register("avg_feed_backlog", with_views("""
SELECT b.backlog, l.latest_uid, CASE WHEN l.latest_uid = 0 THEN 0.0 ELSE round(b.backlog / l.latest_uid, 9) END
  AS avg_backlog FROM (SELECT count(*) AS backlog FROM feed1) b,
  (SELECT CAST(coalesce(max(uid), 0) AS BIGINT) AS latest_uid FROM users) l""",
                                         "articles", "subscriptions", "users", extra=FEED1_SQL))
def q_avg_feed_backlog(t):
    """Total feed backlog / latest_uid."""
    return C.avg_feed_backlog(_feed1(t), fx.users(t))


@register("latest_uid", with_views(
    "SELECT CAST(coalesce(max(uid), 0) AS BIGINT) AS latest_uid FROM users", "users"))
def q_latest_uid(t):
    """Highest created uid."""
    return U.latest_uid(fx.users(t))


@register("producer_by_topic", with_views(
    "SELECT coalesce(topic, 'unknown') AS topic, count(*) AS n FROM messages GROUP BY 1", "messages"))
def q_producer_by_topic(t):
    """Replayed articles per topic; absent topic -> 'unknown'."""
    return C.producer_by_topic(fx.messages(t))


@register("fanout_amplification", with_views("""
SELECT m.messages, d.deliveries, round(d.deliveries / m.messages, 6) AS amplification
FROM (SELECT count(*) AS messages FROM articles) m, (SELECT count(*) AS deliveries FROM vis) d""",
                                             "articles", "subscriptions", extra=VISIBLE_SQL))
def q_fanout_amplification(t):
    """Deliveries per input message."""
    return C.fanout_amplification(visible_push_counts(fx.articles(t), fx.subscriptions(t)))


@register("users_seeded", with_views("""
SELECT count(*) FILTER (WHERE u.uid IS NULL) AS created, count(*) FILTER (WHERE u.uid IS NOT NULL) AS skipped
FROM cand c LEFT JOIN users u ON c.uid = u.uid""", "users", extra=CANDIDATES_SQL))
def q_users_seeded(t):
    """Created vs skipped users of a second seeding run."""
    return U.users_seeded(_candidates(t), fx.users(t))


@register("latency_histogram", with_views(f"""
SELECT s.series, b.le, CAST(count(*) FILTER (WHERE s.seconds <= b.le) AS BIGINT) AS cum_count,
  CAST(count(*) AS BIGINT) AS count, round(sum(s.seconds), 6) AS sum
FROM latency_samples s, (SELECT unnest(list_concat({BOUNDS_SQL}::DOUBLE[], ['inf'::DOUBLE])) AS le) b
GROUP BY s.series, b.le""", "latency_samples"))
def q_latency_histogram(t):
    """Cumulative latency buckets (14 bounds + +Inf), sum and count per series."""
    return C.latency_histogram(fx.latency_samples(t))


@register("gauge_sum", """
SELECT event_type AS series, round(sum(v), 6) AS value FROM (
  SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY event_type, user_id) g
GROUP BY event_type""")
def q_gauge_sum(t):
    """Sum over replicas (user_id) of each replica's last value, per series."""
    e = t.events.select(F.col("event_type").alias("series"), "user_id", "value", "ts", "event_id")
    return C.gauge_sum(e, "series", "user_id", "value", ["ts", "event_id"])


@register("fragmentation_ratio", """
SELECT event_id, CAST(floor(value) AS BIGINT) AS used, CAST(floor(value * 1.5) AS BIGINT) + 1 AS rss,
  CASE WHEN CAST(floor(value) AS BIGINT) = 0 THEN 0.0
  ELSE round((CAST(floor(value * 1.5) AS BIGINT) + 1) / CAST(floor(value) AS BIGINT), 9) END AS ratio FROM events""")
def q_fragmentation_ratio(t):
    """Rss / used with the used = 0 guard (memory gauges derived from events.value)."""
    e = t.events.select("event_id", F.floor("value").cast("bigint").alias("used"),
                        (F.floor(F.col("value") * 1.5).cast("bigint") + 1).alias("rss"))
    return e.select("event_id", "used", "rss",
                    F.round(C.fragmentation_ratio(F.col("rss"), F.col("used")), 9).alias("ratio"))


@register("trim_ops", with_views("""
SELECT topic, count(*) AS trims FROM articles GROUP BY topic
UNION ALL SELECT NULL, CAST(floor(count(*) / 32) AS BIGINT) FROM raw_log""", "articles", "raw_log"))
def q_trim_ops(t):
    """Trim passes on the raw log (per full batch) and topic logs (per message)."""
    return C.trim_ops(fx.raw_log(t), fx.articles(t))


@register("subscribers_lexical", with_views("""
SELECT topic, uid, row_number() OVER (PARTITION BY topic ORDER BY CAST(uid AS VARCHAR)) AS lex_pos
FROM subscriptions""", "subscriptions"))
def q_subscribers_lexical(t):
    """G1: subscribers of each topic in uid-as-string order."""
    return U.subscribers_lexical(fx.subscriptions(t))


@register("set_add", with_views("""
SELECT DISTINCT uid, doc_id FROM attempts b WHERE b.ts >= TIMESTAMP '2024-01-16 00:00:00'
AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.ts < TIMESTAMP '2024-01-16 00:00:00'
  AND a.uid = b.uid AND a.doc_id = b.doc_id)""", "attempts"))
def q_set_add(t):
    """Adds of the second half of the month that were not yet in the set."""
    a = fx.attempts(t)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return U.set_add(a.where(F.col("ts") < cut), a.where(F.col("ts") >= cut), ["uid", "doc_id"])
