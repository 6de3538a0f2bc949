"""DuckDB text of the derived views, for the oracle SQL of each query.

DuckDB only has the base tables, so each oracle starts with the views it
needs in a ``WITH`` clause. ``with_views(body, *names)`` adds the named
views and the views they depend on, in dependency order.
"""

from __future__ import annotations

from .constants import LATENCY_BOUNDS, TOPICS
from .sources.fixtures import EVENT_TYPES, SCRAPED, SCRAPED_GAUGES

TOP = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"

BOUNDS_SQL = f"{LATENCY_BOUNDS}"
#: All bounds, the last one infinite, with their numbers.
BUCKETS_SQL = f"""(SELECT unnest(range({len(LATENCY_BOUNDS) + 1})) AS k, unnest(list_concat({BOUNDS_SQL}::DOUBLE[], ['inf'::DOUBLE])) AS le)"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base_articles": ((), f"""
SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id // 15 * 555 AS INT)) AS ts0,
  substring(text,1,60) AS title, text, ({TOP})[CAST((doc_id * 7 + doc_id // 10) % 10 AS INT) + 1] AS topic
FROM documents"""),
    "articles": (("base_articles",), """
SELECT CAST(epoch_ms(entry_ts) AS VARCHAR) || '-' || CAST(doc_id % 15 * 3 + copy AS VARCHAR) AS entry_id,
  CAST(doc_id % 15 * 3 + copy AS BIGINT) AS seq, entry_ts, copy, doc_id,
  CASE WHEN doc_id % 97 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id, title, text, topic
FROM (SELECT doc_id, ts0, title, text, topic, 0 AS copy, ts0 AS entry_ts FROM base_articles
 UNION ALL SELECT doc_id, ts0, title, text, topic, 1, ts0 + INTERVAL 6 HOUR FROM base_articles WHERE doc_id % 20 = 0
 UNION ALL SELECT doc_id, ts0, title, text, topic, 2, ts0 + INTERVAL 30 HOUR FROM base_articles WHERE doc_id % 30 = 0)"""),
    "originals": (("articles",), "SELECT * FROM articles WHERE copy = 0"),
    "subscriptions": ((), f"""
SELECT c_custkey AS uid, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey*13 AS INT)) AS created_ts,
  ({TOP})[CAST((c_custkey*7 + j*2) % 9 AS INT)+1] AS topic
FROM (SELECT c_custkey, unnest(range(0, 2 + c_custkey % 3)) AS j FROM customer)"""),
    "users": (("subscriptions",), """
SELECT uid, list_sort(list(topic)) AS interests, min(created_ts) AS created_ts
FROM subscriptions GROUP BY uid"""),
    "known_users": (("users",), "SELECT * FROM users WHERE uid % 11 <> 0"),
    "attempts": ((), """
SELECT user_id AS uid, ts, event_id, json_extract_string(props,'$.k') AS doc_id, event_type AS tag FROM events"""),
    "counter_samples": ((), """
SELECT event_type AS series, ts,
  count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS value FROM events"""),
    "latency_samples": ((), """
SELECT event_type AS series, ts, event_id, value / 1000.0 AS seconds FROM events"""),
    "bucket_samples": (("latency_samples",), f"""
SELECT series, ts, event_id, k, le, sum(CASE WHEN seconds <= le THEN 1 ELSE 0 END)
  OVER (PARTITION BY series, k, CAST(ts AS DATE) ORDER BY ts, event_id)::BIGINT AS value
FROM latency_samples, {BUCKETS_SQL} b"""),
    "scrapes": ((), f"""
SELECT metric, label, 0 AS le, ts, event_id, CASE WHEN metric IN {SCRAPED_GAUGES} THEN value
  ELSE count(*) OVER (PARTITION BY metric, label, CAST(ts AS DATE) ORDER BY ts, event_id) END AS value
FROM (SELECT *, ({list(SCRAPED)})[(list_position({list(EVENT_TYPES)}, event_type) - 1) * 5 + user_id % 5 + 1] AS metric,
  CAST(user_id // 5 % 3 AS VARCHAR) AS label FROM events) e WHERE metric <> 'store_latency'
UNION ALL
SELECT metric, label, k, ts, event_id, sum(CASE WHEN value / 1000.0 <= b.le THEN 1 ELSE 0 END)
  OVER (PARTITION BY label, k, CAST(ts AS DATE) ORDER BY ts, event_id)
FROM (SELECT *, ({list(SCRAPED)})[(list_position({list(EVENT_TYPES)}, event_type) - 1) * 5 + user_id % 5 + 1] AS metric,
  CAST(user_id // 5 % 3 AS VARCHAR) AS label FROM events) e, {BUCKETS_SQL} b WHERE metric = 'store_latency'"""),
    "raw_log": (("articles",), """
SELECT entry_id, entry_ts, copy, doc_id, id, title,
  CASE WHEN copy = 0 THEN text END AS body, CASE WHEN copy = 1 THEN text END AS text, topic
FROM articles"""),
    "messages": (("articles",), """
SELECT entry_id, entry_ts, doc_id,
  CASE WHEN id = '' THEN NULL ELSE id END AS id,
  CASE WHEN copy = 2 THEN NULL ELSE title END AS title,
  CASE WHEN copy = 2 AND doc_id % 60 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN copy = 0 THEN '' WHEN copy = 1 THEN NULL ELSE substring(text, 1, 20) END AS summary,
  CASE WHEN copy = 1 THEN NULL ELSE text END AS body,
  CASE WHEN copy = 0 THEN [topic] WHEN copy = 1 THEN NULL ELSE [topic, '', topic] END AS tags,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE topic END AS topic
FROM articles"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH <views>[, extra] <body>`` where body is the final SELECT."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names)]
    if extra.strip():
        ctes.append(extra.strip())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body.strip()
