"""Projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NO_TITLE
from ..functions import messages as M
from ..functions import payload as P
from ..oracle import TOP, with_views
from ..sources import fixtures as fx
from . import register

NORMALIZED_SQL = f"""nm AS (SELECT entry_id, coalesce(id, md5(entry_id)) AS id,
  coalesce(title, text, '{NO_TITLE}') AS title, coalesce(summary, body, text) AS summary, body,
  coalesce(tags, CASE WHEN topic IS NOT NULL AND topic <> '' THEN [topic] ELSE []::VARCHAR[] END) AS tags,
  topic FROM messages)"""


def _topic_log(t):
    """Topic-log entries: copy 0 has a JSON ``data`` field, copy 1 only bare
    fields, copy 2 a ``data`` value that is not JSON or no JSON object."""
    a = fx.articles(t)
    return a.select(
        "entry_id", "copy", "id", "title", "text", "topic",
        F.when(F.col("copy") == 0, P.encode_payload("id", "title", "text", "topic"))
        .when(F.col("copy") == 2, F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("not-json "), F.col("entry_id")))
              .when(F.col("doc_id") % 4 == 1, F.lit("123")).when(F.col("doc_id") % 4 == 2, F.lit('"hello"'))
              .otherwise(F.lit("[1,2]"))).alias("data"),
    )


@register("body_fallback", with_views(
    "SELECT entry_id, coalesce(body, text, '') AS body_value FROM raw_log", "raw_log"))
def q_body_fallback(t):
    """B1: body if present, else text, else ''."""
    return fx.raw_log(t).select("entry_id", P.body_fallback().alias("body_value"))


@register("classifier_input", with_views(
    "SELECT entry_id, title || ' ' || substring(coalesce(body, text, ''), 1, 512) AS classifier_text "
    "FROM raw_log", "raw_log"))
def q_classifier_input(t):
    """B2: title + space + first 512 characters of the body."""
    return fx.raw_log(t).select("entry_id", P.classifier_input("title", P.body_fallback()).alias("classifier_text"))


@register("encode_payload", with_views("""
SELECT entry_id, CAST(doc_id AS VARCHAR) AS id, title, '' AS summary, coalesce(body, text, '') AS body,
  topic AS tags, topic FROM raw_log""", "raw_log"))
def q_encode_payload(t):
    """Six-field JSON document (tags=[topic], summary always ''); checked on parsed fields."""
    r = fx.raw_log(t)
    js = P.encode_payload(F.col("doc_id").cast("string"), "title", P.body_fallback(), "topic")
    p = F.from_json(js, P.PAYLOAD_SCHEMA)
    return r.select("entry_id", p.alias("p")).select(
        "entry_id", "p.id", "p.title", "p.summary", "p.body",
        F.array_join("p.tags", "|").alias("tags"), "p.topic")


@register("decode_payload_fanout", with_views(
    "SELECT entry_id, coalesce(nullif(id, ''), entry_id) AS doc, title FROM articles", "articles"))
def q_decode_payload_fanout(t):
    """``data`` if truthy, else the entry's own fields; then the document id rule."""
    a = fx.articles(t)
    data = F.when(F.col("copy") != 1, P.encode_payload("id", "title", "text", "topic"))
    p = P.decode_payload_fanout(data, P.bare_fields_json("id", "title", "text"))
    d = a.select("entry_id", p.alias("p"))
    return d.select("entry_id", P.doc_identity("p.id", "entry_id").alias("doc"), "p.title")


@register("decode_payload_feed", with_views(
    "SELECT entry_id, id, title, CASE WHEN copy = 1 THEN NULL ELSE text END AS body FROM articles", "articles"))
def q_decode_payload_feed(t):
    """Feed entries; ``data`` parsed when truthy, else bare fields; bad JSON fails (FAILFAST)."""
    a = fx.articles(t)
    data = F.when(F.col("copy") == 1, F.lit("")).otherwise(P.encode_payload("id", "title", "text", "topic"))
    p = P.decode_payload_feed(data, P.bare_fields_json("id", "title", "text"))
    return a.select("entry_id", p.alias("p")).select("entry_id", "p.id", "p.title", "p.body")


@register("decode_payload_topic", with_views("""
SELECT entry_id, CASE copy WHEN 1 THEN 'bare' WHEN 2 THEN 'raw' ELSE 'json' END AS kind,
  CASE WHEN copy = 2 THEN NULL ELSE id END AS id, CASE WHEN copy = 2 THEN NULL ELSE title END AS title,
  CASE WHEN copy = 2 THEN CASE doc_id % 4 WHEN 0 THEN 'not-json ' || entry_id WHEN 1 THEN '123' WHEN 2 THEN '"hello"'
    ELSE '[1,2]' END END AS raw FROM articles""", "articles"))
def q_decode_payload_topic(t):
    """Missing ``data`` -> bare fields; unparseable -> the raw string is kept."""
    log = _topic_log(t)
    is_bare, parsed, raw = P.decode_payload_topic("data")
    return log.select(
        "entry_id",
        F.when(is_bare, "bare").when(raw.isNotNull(), "raw").otherwise("json").alias("kind"),
        F.when(is_bare, F.col("id")).otherwise(parsed["id"]).alias("id"),
        F.when(is_bare, F.col("title")).otherwise(parsed["title"]).alias("title"),
        raw.alias("raw"),
    )


@register("doc_identity", with_views(
    "SELECT entry_id, coalesce(nullif(id, ''), entry_id) AS doc FROM articles", "articles"))
def q_doc_identity(t):
    """Id if non-empty, else the log entry id."""
    return fx.articles(t).select("entry_id", P.doc_identity().alias("doc"))


@register("normalize_message", with_views(
    "SELECT entry_id, id, title, summary, body, array_to_string(tags, '|') AS tags, topic FROM nm",
    "messages", extra=NORMALIZED_SQL))
def q_normalize_message(t):
    """?? fallbacks for id/title/summary/tags (stable id instead of a random one)."""
    n = M.normalize_message(fx.messages(t))
    return n.select("entry_id", "id", "title", "summary", "body",
                    F.array_join("tags", "|").alias("tags"), "topic")


@register("message_chips", with_views("""
SELECT entry_id, array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(l, x) = i), '|')
  AS chips FROM (SELECT entry_id, list_concat(coalesce(tags, []::VARCHAR[]), [topic]) AS l FROM nm) c""",
    "messages", extra=NORMALIZED_SQL))
def q_message_chips(t):
    """Ordered distinct of tags + topic without falsy values."""
    n = M.normalize_message(fx.messages(t))
    return n.select("entry_id", F.array_join(M.message_chips(), "|").alias("chips"))


@register("message_preview", with_views("""
SELECT entry_id, CASE WHEN coalesce(summary, '') <> '' OR coalesce(body, '') <> '' THEN coalesce(summary, body) END
  AS preview FROM nm""", "messages", extra=NORMALIZED_SQL))
def q_message_preview(t):
    """Preview shown only if summary or body is non-empty; NULL-vs-'' exact."""
    n = M.normalize_message(fx.messages(t))
    return n.select("entry_id", M.message_preview().alias("preview"))


@register("parse_entry_id", with_views("""
SELECT entry_id, TRY_CAST(split_part(entry_id, '-', 1) AS BIGINT) AS entry_ms,
  epoch_ms(TRY_CAST(split_part(entry_id, '-', 1) AS BIGINT)) AS entry_time,
  TRY_CAST(split_part(id, '-', 1) AS BIGINT) AS id_ms FROM articles""", "articles"))
def q_parse_entry_id(t):
    """<ms>-<seq> -> time; bad input -> NULL."""
    ms = M.parse_entry_id("entry_id")
    return fx.articles(t).select("entry_id", ms.alias("entry_ms"),
                                 F.timestamp_millis(ms).alias("entry_time"),
                                 M.parse_entry_id("id").alias("id_ms"))


AGE_SQL = """CASE WHEN {ms} IS NULL THEN ''
  WHEN {d} < 90 THEN CAST(CAST(trunc({d}) AS BIGINT) AS VARCHAR) || ' s ago'
  WHEN {d} < 5400 THEN CAST(CAST(trunc({d} / 60) AS BIGINT) AS VARCHAR) || ' m ago'
  WHEN {d} < 172800 THEN CAST(CAST(trunc({d} / 3600) AS BIGINT) AS VARCHAR) || ' h ago'
  ELSE strftime(epoch_ms({ms}), '%d %b') END"""


def _age_sql(col: str) -> str:
    ms = f"TRY_CAST(split_part({col}, '-', 1) AS BIGINT)"
    d = f"((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - {ms} * 1000) / 1e6)"
    return AGE_SQL.format(ms=ms, d=d)


@register("relative_age", with_views(
    f"SELECT entry_id, {_age_sql('entry_id')} AS entry_age, {_age_sql('id')} AS id_age FROM articles",
    "articles"))
def q_relative_age(t):
    """Human relative time of a log id against a fixed ``now`` parameter."""
    return fx.articles(t).select("entry_id", M.relative_age("entry_id").alias("entry_age"),
                                 M.relative_age("id").alias("id_age"))


CHANNEL_SQL = f"""CASE event_type WHEN 'view' THEN 'topic:' || ({TOP})[CAST(json_extract_string(props, '$.k') AS INT) % 10 + 1]
  WHEN 'click' THEN 'feed:' || CAST(user_id AS VARCHAR) WHEN 'purchase' THEN 'feeds:' || CAST(user_id AS VARCHAR)
  ELSE event_type || ':' || CAST(user_id AS VARCHAR) END"""


def _channels(t):
    e = t.events
    k = F.get_json_object("props", "$.k").cast("int")
    ch = (F.when(F.col("event_type") == "view", F.concat(F.lit("topic:"), fx.topic_at(k % 10)))
          .when(F.col("event_type") == "click", F.concat(F.lit("feed:"), F.col("user_id").cast("string")))
          .when(F.col("event_type") == "purchase", F.concat(F.lit("feeds:"), F.col("user_id").cast("string")))
          .otherwise(F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))))
    return e.select("event_id", ch.alias("channel"))


@register("route_channel", f"""
SELECT event_id, channel, CASE WHEN starts_with(channel, 'topic:') THEN 'cursor'
  WHEN starts_with(channel, 'feed:') THEN 'consume' ELSE 'invalid' END AS mode,
  CASE WHEN starts_with(channel, 'topic:') THEN substring(channel, 7)
  WHEN starts_with(channel, 'feed:') THEN substring(channel, 6) END AS key
FROM (SELECT event_id, {CHANNEL_SQL} AS channel FROM events) c""")
def q_route_channel(t):
    """Channel prefix -> cursor read / consuming read / invalid (quarantined)."""
    c = _channels(t)
    mode, key = M.route_channel("channel")
    return c.select("event_id", "channel", mode.alias("mode"), key.alias("key"))


@register("route_topic", with_views(
    "SELECT entry_id, 'topic:' || topic AS stream FROM articles", "articles"))
def q_route_topic(t):
    """Log name of each enriched document."""
    return fx.articles(t).select("entry_id", P.route_topic().alias("stream"))


@register("target_rps", """
SELECT c_custkey AS latest_uid, least(200.0::DOUBLE, greatest(1.0::DOUBLE, c_custkey * 0.05::DOUBLE)) AS target_rps,
  round(1.0::DOUBLE / least(200.0::DOUBLE, greatest(1.0::DOUBLE, c_custkey * 0.05::DOUBLE)), 9) AS delay_s FROM customer""")
def q_target_rps(t):
    """Reader rate as users are seeded (latest_uid grows with each customer)."""
    r = M.target_rps(F.col("c_custkey"))
    return t.customer.select(F.col("c_custkey").alias("latest_uid"), r.alias("target_rps"),
                             F.round(1.0 / r, 9).alias("delay_s"))


@register("unit_scale", with_views("""
SELECT series, ts, round(value / 1024 / 1024, 9) AS mb, round(value / 1024, 9) AS kb_per_s,
  round(value * 1e6, 3) AS micros, round(value * 100, 6) AS percent FROM counter_samples""", "counter_samples"))
def q_unit_scale(t):
    """Bytes -> MB, bytes/s -> KB/s, s -> us, ratio -> %."""
    s = fx.counter_samples(t)
    u = M.unit_scale("value")
    return s.select("series", "ts", F.round(u["mb"], 9).alias("mb"), F.round(u["kb_per_s"], 9).alias("kb_per_s"),
                    F.round(u["micros"], 3).alias("micros"), F.round(u["percent"], 6).alias("percent"))


@register("interest_member", with_views(f"""
SELECT uid, topic, list_contains(interests, topic) AS is_member
FROM (SELECT uid, interests, unnest({TOP}) AS topic FROM users) u""", "users"))
def q_interest_member(t):
    """Is each topic among the user's interests."""
    u = fx.users(t)
    return u.select("uid", "interests", F.explode(fx.topics_array()).alias("topic")).select(
        "uid", "topic", F.array_contains("interests", F.col("topic")).alias("is_member"))


@register("drop_falsy", with_views(
    "SELECT entry_id, array_to_string(list_filter(tags, lambda x: x IS NOT NULL AND x <> ''), '|') AS tags FROM messages",
    "messages"))
def q_drop_falsy(t):
    """C4: remove empty values of an array."""
    return fx.messages(t).select("entry_id", F.array_join(M.drop_falsy("tags"), "|").alias("tags"))

