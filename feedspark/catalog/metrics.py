"""Metric queries (F12, H1-H9). Samples are sparse (~1 per series per 22 min),
so ranges are 6 hours evaluated at a daily step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as MX
from ..oracle import BUCKETS_SQL, with_views
from ..plans.dashboard import PANELS, pipeline_overview
from ..sources import fixtures as fx
from . import register

SERIES = ["click", "error", "purchase", "signup", "view"]

STEPS_SQL = """st AS (SELECT DISTINCT date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS t FROM {src})"""

RATE_SQL = STEPS_SQL.format(src="counter_samples") + """,
 j AS (SELECT s.series, st.t, s.ts, s.value, lag(s.value) OVER (PARTITION BY s.series, st.t ORDER BY s.ts, s.value) AS pv
   FROM counter_samples s JOIN st ON s.ts > st.t - INTERVAL 6 HOUR AND s.ts <= st.t),
 rt AS (SELECT series, t, sum(CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END) / 21600.0e0
   AS rate FROM j GROUP BY series, t HAVING count(*) >= 2)"""


def _rates(t):
    return MX.rate(fx.counter_samples(t), "6 hours", "1 day")


@register("counter_delta", with_views("""
SELECT series, ts, greatest(value - coalesce(lag(value) OVER (PARTITION BY series ORDER BY ts, value), 0), 0) AS delta
FROM counter_samples""", "counter_samples"))
def q_counter_delta(t):
    """per-sample increase; first sample in full, negative differences ignored."""
    return MX.counter_delta(fx.counter_samples(t)).select("series", "ts", F.col("delta").cast("bigint").alias("delta"))


@register("rate_1m", with_views(
    "SELECT series, CAST(t AS DATE) AS t, round(rate, 9) AS rate FROM rt", "counter_samples", extra=RATE_SQL))
def q_rate(t):
    """H1: per-second rate of each counter over a 6 h range at a daily step."""
    return _rates(t).select("series", F.to_date("t").alias("t"), F.round("rate", 9).alias("rate"))


@register("rate_extrapolated", with_views("""
SELECT series, CAST(t AS DATE) AS t, round(up * (span + least(CASE WHEN a < 1.1 * span / (n - 1) THEN a ELSE span / (n - 1) / 2 END,
    CASE WHEN up > 0 AND v >= 0 THEN span * v / up END) + CASE WHEN z < 1.1 * span / (n - 1) THEN z ELSE span / (n - 1) / 2 END)
  / span / 21600.0e0, 9) AS rate
FROM (SELECT series, t, count(*) AS n, sum(CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END) AS up,
    (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS span, (epoch_us(min(ts)) - epoch_us(t - INTERVAL 6 HOUR))::DOUBLE AS a,
    (epoch_us(t) - epoch_us(max(ts)))::DOUBLE AS z, arg_min(value, (ts, value)) AS v FROM j GROUP BY series, t) g
WHERE n >= 2 AND span > 0""", "counter_samples", extra=RATE_SQL))
def q_rate_extrapolated(t):
    """H1 with the edges of the range extrapolated."""
    r = MX.extrapolated_rate(fx.counter_samples(t), "6 hours", "1 day")
    return r.select("series", F.to_date("t").alias("t"), F.round("rate", 9).alias("rate"))


@register("sum_rate_1m", with_views(
    "SELECT CAST(t AS DATE) AS t, round(sum(rate), 9) AS rate FROM rt GROUP BY t", "counter_samples", extra=RATE_SQL))
def q_sum_rate(t):
    """H2: rate per series summed over the series."""
    r = MX.sum_rate(fx.counter_samples(t), "6 hours", "1 day")
    return r.select(F.to_date("t").alias("t"), F.round("rate", 9).alias("rate"))


@register("irate_5m", with_views("""
SELECT series, CAST(t AS DATE) AS t, round(CASE WHEN v1 >= v0 THEN v1 - v0 ELSE v1 END
  / ((epoch_us(t1) - epoch_us(t0)) / 1e6), 9) AS irate FROM (
  SELECT series, t, arg_max(value, (ts, value)) AS v1, arg_min(value, (ts, value)) AS v0, max(ts) AS t1, min(ts) AS t0, count(*) AS n
  FROM (SELECT s.series, st.t, s.ts, s.value, row_number() OVER (PARTITION BY s.series, st.t ORDER BY s.ts DESC, s.value DESC) AS rn
        FROM counter_samples s JOIN st ON s.ts > st.t - INTERVAL 6 HOUR AND s.ts <= st.t) x
  WHERE rn <= 2 GROUP BY series, t) g WHERE n = 2""", "counter_samples", extra=STEPS_SQL.format(src="counter_samples")))
def q_irate(t):
    """H3: instant rate from the last two samples of each range."""
    r = MX.irate(fx.counter_samples(t), "6 hours", "1 day")
    return r.select("series", F.to_date("t").alias("t"), F.round("irate", 9).alias("irate"))


#: Evaluation steps of the quantiles and the dashboard, where a range holds several steps.
EVERY_SQL = """st AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 2 DAY,
   INTERVAL 6 HOUR)) AS t FROM events)"""

#: Quantiles of bucket increases ``up`` (by ``by``, k, le, cum).
QUANTILE_SQL = """um AS (SELECT * REPLACE (max(cum) OVER (PARTITION BY {by} ORDER BY k) AS cum) FROM up),
 ub AS (SELECT *, lag(le, 1, 0.0) OVER w AS lo, lag(cum, 1, 0.0) OVER w AS prev, max(cum) OVER (PARTITION BY {by}) AS total
   FROM um WINDOW w AS (PARTITION BY {by} ORDER BY k)),
 uq AS (SELECT {by}, q, arg_min(struct_pack(le := le, lo := lo, prev := prev, cum := cum, total := total), k) AS b
   FROM ub, (SELECT unnest([0.5::DOUBLE, 0.99::DOUBLE]) AS q) qs WHERE cum >= q * total AND total > 0 GROUP BY {by}, q),
 qv AS (SELECT {by}, q, CASE WHEN b.le = 'inf'::DOUBLE THEN b.lo WHEN b.cum > b.prev
   THEN b.lo + (b.le - b.lo) * (q * b.total - b.prev) / (b.cum - b.prev) ELSE b.lo END AS value FROM uq)"""

HIST_SQL = EVERY_SQL + """,
 bj AS (SELECT b.series, b.k, b.le, st.t, b.value, lag(b.value) OVER (PARTITION BY b.series, b.k, st.t ORDER BY b.ts, b.event_id) AS pv
   FROM bucket_samples b JOIN st ON b.ts > st.t - INTERVAL 12 HOUR AND b.ts <= st.t),
 up AS (SELECT series, k, le, t, sum(CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END)::DOUBLE AS cum
   FROM bj GROUP BY ALL HAVING count(*) >= 2),
 """ + QUANTILE_SQL.format(by="series, t")


@register("hist_quantile", with_views("SELECT series, t, q, round(value, 6) AS value FROM qv", "bucket_samples", extra=HIST_SQL))
def q_hist_quantile(t):
    """H4: p50 / p99 latency per series and step, from the bucket increases over a 12 h range every 6 h."""
    q = MX.range_quantiles(fx.bucket_samples(t), (0.5, 0.99), "12 hours", "6 hours", order=("event_id",))
    return q.select("series", "t", "q", F.round("value", 6).alias("value"))


GAUGE_SQL = STEPS_SQL.format(src="events") + """,
 gl AS (SELECT e.event_type AS series, e.user_id, st.t, arg_max(e.value, (e.ts, e.event_id)) AS value
   FROM events e JOIN st ON e.ts > st.t - INTERVAL 6 HOUR AND e.ts <= st.t GROUP BY e.event_type, e.user_id, st.t)"""


def _gauges(t):
    return t.events.select(F.col("event_type").alias("series"), "user_id",
                           F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


@register("gauge_last", with_views("""
SELECT e.event_type AS series, CAST(st.t AS DATE) AS t, round(arg_max(e.value, (e.ts, e.event_id)), 6) AS value
FROM events e JOIN st ON e.ts > st.t - INTERVAL 6 HOUR AND e.ts <= st.t GROUP BY e.event_type, st.t""",
                                   extra=STEPS_SQL.format(src="events")))
def q_gauge_last(t):
    """H5: last gauge value of each series in a 6 h lookback per day."""
    g = MX.gauge_last(_gauges(t), "6 hours", "1 day", ("series",), order=("event_id",))
    return g.select("series", F.to_date("t").alias("t"), F.round("value", 6).alias("value"))


@register("gauge_sum_labels", with_views("""
SELECT series, CAST(t AS DATE) AS t, round(sum(value), 6) AS value FROM gl GROUP BY series, t""", extra=GAUGE_SQL))
def q_gauge_sum_labels(t):
    """H6: last value per (series, user_id) in the lookback, summed over user_id."""
    g = MX.gauge_sum_labels(_gauges(t), "user_id", "6 hours", "1 day", order=("event_id",))
    return g.select("series", F.to_date("t").alias("t"), F.round("value", 6).alias("value"))


@register("hits_vs_misses", with_views("""
SELECT CAST(t AS DATE) AS t, """ + ", ".join(
    f"round(max(CASE WHEN series = '{s}' THEN rate END), 9) AS {s}" for s in SERIES) + """ FROM rt GROUP BY t""",
                                       "counter_samples", extra=RATE_SQL))
def q_hits_vs_misses(t):
    """H7: the rates of all series side by side (pivot)."""
    p = MX.rates_side_by_side(_rates(t), SERIES)
    return p.select(F.to_date("t").alias("t"), *[F.round(s, 9).alias(s) for s in SERIES])


@register("cpu_percent", with_views(
    "SELECT series, CAST(t AS DATE) AS t, round(rate * 100, 7) AS cpu_pct FROM rt", "counter_samples", extra=RATE_SQL))
def q_cpu_percent(t):
    """H8: rate x 100 (CPU seconds per second -> percent)."""
    return _rates(t).select("series", F.to_date("t").alias("t"), F.round(MX.scale(F.col("rate"), 100), 7).alias("cpu_pct"))


#: Ranges of the dashboard's panels by kind, over steps of 6 h.
RANGES = {"rate": "6 hours", "irate": "12 hours", "last": "6 hours", "quantile": "12 hours"}


def _panel_sql(x):
    if x.kind == "quantile":
        return f"max(CASE WHEN q = {x.q} THEN value END) * {x.factor} AS {x.column}"
    shown = {"rate": f"sum(up) FILTER (metric = '{x.metric}' AND n >= 2) / {MX.seconds(RANGES['rate'])}.0e0",
             "irate": f"sum(instant) FILTER (metric = '{x.metric}')", "last": f"sum(last) FILTER (metric = '{x.metric}')"}[x.kind]
    return f"{shown} * {x.factor!r}::DOUBLE AS {x.column}"


_PLAIN = [x for x in PANELS if x.kind != "quantile"]
_QUANTILES = [x for x in PANELS if x.kind == "quantile"]
OVERVIEW_SQL = EVERY_SQL + f""",
 mk AS (SELECT unnest({[x.metric for x in PANELS if x.q != 0.5]}) AS metric, unnest({[x.kind for x in PANELS if x.q != 0.5]}) AS kind,
   unnest({[MX.seconds(RANGES[x.kind]) // 3600 for x in PANELS if x.q != 0.5]}) AS hours),
 sj AS (SELECT s.*, st.t, lag(s.value) OVER w AS pv, lag(s.ts) OVER w AS pts,
   row_number() OVER (PARTITION BY s.metric, s.label, s.le, st.t ORDER BY s.ts DESC, s.event_id DESC) AS rn
   FROM scrapes s JOIN mk USING (metric) JOIN st ON s.ts > st.t - to_hours(hours) AND s.ts <= st.t
   WINDOW w AS (PARTITION BY s.metric, s.label, s.le, st.t ORDER BY s.ts, s.event_id)),
 si AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END AS inc FROM sj),
 sg AS (SELECT metric, label, le, t, count(*) AS n, sum(inc) AS up, max(CASE WHEN rn = 1 THEN value END) AS last,
   max(CASE WHEN rn = 1 AND ts > pts THEN inc / ((epoch_us(ts) - epoch_us(pts)) / 1e6) END) AS instant FROM si GROUP BY ALL),
 up AS (SELECT t, g.le AS k, b.le, sum(g.up)::DOUBLE AS cum FROM sg g JOIN {BUCKETS_SQL} b ON b.k = g.le
   WHERE metric = 'store_latency' AND n >= 2 GROUP BY ALL),
 {QUANTILE_SQL.format(by="t")},
 pw AS (SELECT t, {", ".join(_panel_sql(x) for x in _PLAIN)} FROM sg GROUP BY t),
 pq AS (SELECT t, {", ".join(_panel_sql(x) for x in _QUANTILES)} FROM qv GROUP BY t)"""


@register("pipeline_overview", with_views(
    "SELECT t, " + ", ".join(f"round({x.column}, 6) AS {x.column}" for x in PANELS) + " FROM pw FULL JOIN pq USING (t) WHERE coalesce("
    + ", ".join(x.column for x in PANELS) + ") IS NOT NULL", "scrapes", extra=OVERVIEW_SQL))
def q_pipeline_overview(t):
    """H9: all 22 panels of the dashboard (25 columns) every 6 h in one wide table."""
    o = pipeline_overview(fx.scrapes(t), RANGES, "6 hours", order=("event_id",))
    return o.select("t", *(F.round(x.column, 6).alias(x.column) for x in PANELS))
