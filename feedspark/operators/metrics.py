"""Time-series queries over metric samples.

Everything here starts from ``points``: the samples of a series in order, each with its neighbours' times, its number
and its *running total*, which is the counter plus what was lost at its resets so far. Of a range ``(t - range, t]`` only
two samples matter: the last one at or before ``t`` and the first one after ``t - range``. The increase is the difference
of their running totals, their count the difference of their numbers. A sample is the last one for the evaluation
steps up to the next sample's time, and the first one for the steps whose range begins between the sample before it and
itself; so each sample says itself at which steps it is an end of the range, a step of a series gets two rows, and a sample
inside a range is not touched, however many steps' ranges hold it.

Definition used for increases (no PromQL edge extrapolation): the sum over consecutive samples inside the range of
``new - old``, or ``new`` when ``new < old`` (a counter reset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LATENCY_BOUNDS
from ..plans.ordering import handed_on, range_chunks
from .counters import latency_histogram


def seconds(spec: str) -> int:
    n, unit = spec.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return int(n) * mult


def micros(spec: str) -> int:
    return seconds(spec) * 1_000_000


# --- ends of ranges ------------------------------------------------------------------
def points(samples: DataFrame, keys: list[str], ts: str = "ts", values: tuple[str, ...] = ("value",),
           order: tuple[str, ...] | None = None) -> DataFrame:
    """``keys``, us, the values, and for each sample of a series: prev_us, next_us, n (its number), and per value ``v``
    prev_v and total_v (running total with resets counted as in the range increase).

    Samples go by time, then by ``order`` (default: by the values, so at one instant the lower counts as the earlier).
    Samples without a time or a value are left out. By ranges of (keys, order): a long, dense series is not one task.
    """
    order = list(order or values)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    columns = list(dict.fromkeys([*keys, *values, *order]))
    known = samples.select(us.alias("us"), *columns).dropna(subset=["us", *values])
    d = range_chunks(known, keys, ["us", *order])
    w = Window.partitionBy(*keys, "_chunk").orderBy("us", *order)
    near = d.select("*", F.row_number().over(w).alias("_n"), F.lag("us").over(w).alias("_pu"), F.lead("us").over(w).alias("_nu"),
                    *(F.lag(v).over(w).alias(f"_p_{v}") for v in values))
    lost = {v: F.when(F.col(v) < F.col(f"_p_{v}"), F.col(f"_p_{v}")).otherwise(F.lit(0)) for v in values}
    local = near.select("*", *(F.sum(x).over(w).alias(f"_l_{v}") for v, x in lost.items()))

    place = F.struct("us", *order)
    ends = local.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_c"), F.min("us").alias("_first"), F.max("us").alias("_last"),
        *(f(v, place).alias(f"{name}_{v}") for v in values for name, f in (("_a", F.min_by), ("_z", F.max_by))),
        *(F.max_by(f"_l_{v}", F.struct("_n")).alias(f"_s_{v}") for v in values))
    by = Window.partitionBy(*keys).orderBy("_chunk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", "_c", F.lag("_last").over(by).alias("_cpu"), F.lead("_first").over(by).alias("_cnu"),
                          *(F.lag(f"_z_{v}").over(by).alias(f"_c_{v}") for v in values), *(f"_a_{v}" for v in values), *(f"_s_{v}" for v in values))
    # what is lost at a chunk's first sample counts for the chunk as a whole
    gap = {v: F.when(F.col(f"_a_{v}") < F.col(f"_c_{v}"), F.col(f"_c_{v}")).otherwise(F.lit(0)) for v in values}
    # a series that lies in one range takes nothing from others
    offsets = carried.select("*", *(x.alias(f"_g_{v}") for v, x in gap.items())).select(
        *keys, "_chunk", "_c", "_cpu", "_cnu", *(f"_c_{v}" for v in values), F.sum("_c").over(before).alias("_n0"),
        *((F.coalesce(F.sum(F.col(f"_s_{v}") + F.col(f"_g_{v}")).over(before), F.lit(0)) + F.col(f"_g_{v}")).alias(f"_o_{v}") for v in values)
    ).where("_cpu IS NOT NULL OR _cnu IS NOT NULL")
    j = handed_on(local, offsets, keys)
    nothing = F.lit(0)
    return j.select(*columns, "us", F.coalesce("_pu", "_cpu").alias("prev_us"),
                    F.when(F.col("_n") == F.col("_c"), F.col("_cnu")).otherwise(F.col("_nu")).alias("next_us"),
                    (F.coalesce("_n0", nothing) + F.col("_n")).alias("n"),
                    *(F.coalesce(f"_p_{v}", f"_c_{v}").alias(f"prev_{v}") for v in values),
                    *((F.col(v) + F.col(f"_l_{v}") + F.coalesce(f"_o_{v}", nothing)).alias(f"total_{v}") for v in values))


def _steps(first: Column, end: Column, step_us: int) -> Column:
    """The multiples of the step in [first, end), in microseconds."""
    start = first + F.pmod(-first, F.lit(step_us))
    return F.when(start < end, F.sequence(start, end - 1, F.lit(step_us))).otherwise(F.array().cast("array<bigint>"))


def last_steps(range_us: Column, step_us: int) -> Column:
    """Steps at which a point is the last sample of the range."""
    over = F.col("us") + range_us
    return _steps(F.col("us"), F.least(over, F.coalesce("next_us", over)), step_us)


def first_steps(range_us: Column, step_us: int) -> Column:
    """Steps at which a point is the first sample of the range."""
    return _steps(F.greatest("us", F.coalesce(F.col("prev_us") + range_us, F.col("us"))), F.col("us") + range_us, step_us)


def range_ends(points: DataFrame, range_us: Column, step_us: int, *columns: str) -> DataFrame:
    """``columns`` of the points, once for each step whose range ends (``side`` 1) or begins (-1) with the point: at most
    two rows per series and step."""
    sides = F.concat(F.transform(last_steps(range_us, step_us), lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
                     F.transform(first_steps(range_us, step_us), lambda t: F.struct(t.alias("t"), F.lit(-1).alias("side"))))
    marked = points.select(*columns, sides.alias("_e")).select(*columns, F.explode("_e").alias("_e"))
    return marked.select(*columns, F.timestamp_micros("_e.t").alias("t"), F.col("_e.side").alias("side"))


def increases(points: DataFrame, keys: list[str], range_: str, step: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """keys, t, increase_v of every value over each range (steps with at least two samples)."""
    ends = range_ends(points, F.lit(micros(range_)), micros(step), *keys, "n", *(f"total_{v}" for v in values))
    sums = ends.groupBy(*keys, "t").agg(F.sum(F.col("side") * F.col("n")).alias("_more"),
                                        *(F.sum(F.col("side") * F.col(f"total_{v}")).alias(f"increase_{v}") for v in values))
    return sums.where("_more >= 1").drop("_more")


# --- F12, H1-H3 ----------------------------------------------------------------------
def counter_delta(samples: DataFrame, key: str = "series", ts: str = "ts", value: str = "value",
                  on_reset: str = "drop") -> DataFrame:
    """increase since the previous sample of the series; the first sample counts
    in full. On a reset (negative difference) ``on_reset='drop'`` ignores the
    sample (0, the baseline moves, as the exporter does); ``'count'`` counts the
    new value (the range-increase rule of H1)."""
    if on_reset not in ("drop", "count"):
        raise ValueError(f"on_reset must be 'drop' or 'count', not {on_reset!r}")
    diff = F.col(value) - F.coalesce(F.col(f"prev_{value}"), F.lit(0))
    delta = F.when(diff >= 0, diff).otherwise(F.lit(0) if on_reset == "drop" else F.col(value))
    return points(samples, [key], ts, (value,)).select(key, F.timestamp_micros("us").alias(ts), value, delta.alias("delta"))


def rate(samples: DataFrame, range_: str = "6 hours", step: str = "1 day", key: str = "series",
         ts: str = "ts", value: str = "value") -> DataFrame:
    """H1: per-second rate of a counter over each range (steps with >= 2 samples)."""
    up = increases(points(samples, [key], ts, (value,)), [key], range_, step, (value,))
    return up.select(key, "t", (F.col(f"increase_{value}") / float(seconds(range_))).alias("rate"))


def extrapolated_rate(samples: DataFrame, range_: str = "6 hours", step: str = "1 day", key: str = "series",
                      ts: str = "ts", value: str = "value") -> DataFrame:
    """H1 as a time-series database gives it: the increase between the first and the last sample of a range is stretched
    towards the range's edges.

    It is stretched up to an edge that lies within 1.1 mean distances of the samples, else by half a mean distance, and
    towards the start not further than to where the counter would have been 0. Steps whose samples are of one
    instant have no rate.
    """
    ends = range_ends(points(samples, [key], ts, (value,)), F.lit(micros(range_)), micros(step), key, "us", "n", value, f"total_{value}")
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    g = ends.groupBy(key, "t").agg(
        F.sum(F.col("side") * F.col("n")).alias("_more"), F.sum(F.col("side") * F.col(f"total_{value}")).alias("_up"),
        at(-1, "us").alias("_a"), at(1, "us").alias("_z"), at(-1, value).alias("_v")).where("_more >= 1 AND _z > _a")
    t, long = F.unix_micros("t"), F.col("_z") - F.col("_a")
    mean = long / F.col("_more")
    edge = lambda gap: F.when(gap < 1.1 * mean, gap).otherwise(mean / 2)
    to_zero = F.when((F.col("_up") > 0) & (F.col("_v") >= 0), long * F.col("_v") / F.col("_up"))
    start = F.least(edge(F.col("_a") - (t - micros(range_))), to_zero)  # least() passes over NULL
    stretched = (long + start + edge(t - F.col("_z"))) / long
    return g.select(key, "t", (F.col("_up") * stretched / float(seconds(range_))).alias("rate"))


def sum_rate(samples: DataFrame, range_: str = "6 hours", step: str = "1 day", key: str = "series",
             by: list[str] | None = None) -> DataFrame:
    """H2: rate per series, then summed over the series (optionally grouped by ``by``)."""
    r = rate(samples, range_, step, key)
    return r.groupBy(*(by or []), "t").agg(F.sum("rate").alias("rate"))


def instant_rate(value: str = "value") -> Column:
    """Rate from a point and the one before it; NULL if both are of one instant."""
    v, p, dt = F.col(value), F.col(f"prev_{value}"), F.col("us") - F.col("prev_us")
    return F.when(dt > 0, F.when(v >= p, v - p).otherwise(v) / (dt / 1e6))


def irate(samples: DataFrame, range_: str = "6 hours", step: str = "1 day", key: str = "series",
          ts: str = "ts", value: str = "value") -> DataFrame:
    """H3: instant rate from the last two samples inside the range. No aggregation: the point that ends the range knows
    the one before it."""
    p = points(samples, [key], ts, (value,))
    at = p.where("prev_us IS NOT NULL").select(
        key, instant_rate(value).alias("irate"), "prev_us", last_steps(F.lit(micros(range_)), micros(step)).alias("_t"))
    return at.select(key, "irate", "prev_us", F.explode("_t").alias("_t")).where(
        F.col("prev_us") > F.col("_t") - micros(range_)).select(key, F.timestamp_micros("_t").alias("t"), "irate")


# --- H4 --------------------------------------------------------------------------------
def quantile_in(cum: Column, q: float, bounds=LATENCY_BOUNDS) -> Column:
    """Quantile from cumulative bucket counts (an array, the last one for +Inf): first bucket that reaches q * total, then
    linear interpolation inside it (lower bound 0 for the first one); the last finite bound for a rank in +Inf.

    Counts that fall from a bucket to the next are raised to it: a reset that a bucket's own counter does not show,
    because it has counted as much again, leaves such increases."""
    given = cum
    cum = F.transform(given, lambda _, i: F.array_max(F.slice(given, 1, i + 1)))
    edges = F.array(*(F.lit(float(b)) for b in (0.0, *bounds)))
    total = F.element_at(cum, -1)
    rank = F.lit(float(q)) * total
    k = F.size(F.filter(cum, lambda c: c < rank))
    low, prev, here = F.get(edges, k), F.coalesce(F.get(cum, k - 1), F.lit(0)), F.get(cum, k)
    inside = F.when(here > prev, low + (F.get(edges, k + 1) - low) * (rank - prev) / (here - prev)).otherwise(low)
    return F.when(total > 0, F.when(k >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside))


def range_quantiles(samples: DataFrame, qs=(0.5, 0.99), range_: str = "2 minutes", step: str = "1 minute", key: str = "series",
                    ts: str = "ts", counts: str = "counts", order: tuple[str, ...] = (), bounds=LATENCY_BOUNDS) -> DataFrame:
    """H4: key, t, q, value: quantiles of the bucket increases of a histogram over each range.

    ``counts`` are the cumulative counts of every bucket as scraped (one counter per bound, the last one for +Inf);
    each is differenced with its own resets. Steps without an observation in their range have no quantile.
    """
    names = tuple(f"c{k}" for k in range(len(bounds) + 1))
    flat = samples.select(key, ts, *order, *(F.get(counts, F.lit(k)).alias(c) for k, c in enumerate(names)))
    up = increases(points(flat, [key], ts, names, order or None), [key], range_, step, names)
    cum = F.array(*(F.col(f"increase_{c}").cast("double") for c in names))
    values = up.select(key, "t", cum.alias("_cum")).select(
        key, "t", F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), quantile_in(F.col("_cum"), q, bounds).alias("value")) for q in qs))).alias("_q"))
    return values.select(key, "t", "_q.q", "_q.value").where("value IS NOT NULL")


def hist_quantile(buckets: DataFrame, qs: list[float], keys: list[str], le: str = "le",
                  cum: str = "cum_count") -> DataFrame:
    """Quantiles from one set of cumulative buckets per key, given as rows: first bucket with cum >= q * total, then
    linear interpolation inside it (lower bound 0 for the first bucket); a rank in
    the +Inf bucket returns the last finite bound."""
    w = Window.partitionBy(*keys).orderBy(le)  # one row per bucket: bounded
    b = buckets.select(
        *keys, le, cum,
        F.coalesce(F.lag(le).over(w), F.lit(0.0)).alias("_lo"),
        F.coalesce(F.lag(cum).over(w), F.lit(0)).alias("_prev"),
        F.max(cum).over(Window.partitionBy(*keys)).alias("_total"),
    )
    x = b.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    hit = x.where(F.col(cum) >= F.col("q") * F.col("_total"))
    first = hit.groupBy(*keys, "q").agg(F.min_by(F.struct(le, "_lo", "_prev", cum, "_total"), le).alias("b"))
    rank = F.col("q") * F.col("b._total")
    val = (F.when(F.col("b").getField(le) == float("inf"), F.col("b._lo"))
           .otherwise(F.col("b._lo") + (F.col("b").getField(le) - F.col("b._lo"))
                      * (rank - F.col("b._prev")) / (F.col(f"b.{cum}") - F.col("b._prev"))))
    return first.select(*keys, "q", val.alias("value"))


def latency_quantiles(samples: DataFrame, qs=(0.5, 0.99), key: str = "series", value_col: str = "seconds",
                      bounds=LATENCY_BOUNDS) -> DataFrame:
    """Quantiles of all observations per key through E13's buckets."""
    return hist_quantile(latency_histogram(samples, value_col, key, bounds), list(qs), [key])


# --- H5-H8 -----------------------------------------------------------------------------
def gauge_last(samples: DataFrame, lookback: str = "6 hours", step: str = "1 day", keys=("series",),
               ts: str = "ts", value: str = "value", order: tuple[str, ...] | None = None) -> DataFrame:
    """H5: last value of each gauge series inside the lookback of each step."""
    p = points(samples, list(keys), ts, (value,), order)
    at = p.select(*keys, value, last_steps(F.lit(micros(lookback)), micros(step)).alias("_t"))
    return at.select(*keys, value, F.explode("_t").alias("_t")).select(*keys, F.timestamp_micros("_t").alias("t"), F.col(value).alias("value"))


def gauge_sum_labels(samples: DataFrame, label: str, lookback: str = "6 hours", step: str = "1 day",
                     series: str = "series", ts: str = "ts", value: str = "value",
                     order: tuple[str, ...] | None = None) -> DataFrame:
    """H6: last value per (series, label) in the lookback, summed over the labels."""
    g = gauge_last(samples, lookback, step, (series, label), ts, value, order)
    return g.groupBy(series, "t").agg(F.sum("value").alias("value"))


def rates_side_by_side(rates: DataFrame, series_values: list[str], key: str = "series") -> DataFrame:
    """H7: pivot of rates, one column per series."""
    return rates.groupBy("t").pivot(key, series_values).agg(F.first("rate"))


def scale(c: Column, factor: float) -> Column:
    """H8: unit scaling of a rate (CPU seconds/s -> %)."""
    return c * factor
