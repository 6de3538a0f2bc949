"""Range queries over samples against a plain reading of the rules, for ranges longer and shorter than the step."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedspark.catalog import load_all
from feedspark.constants import LATENCY_BOUNDS
from feedspark.operators import metrics as MX
from feedspark.plans.dashboard import PANELS, Panel, pipeline_overview

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def sampled(seed, n=120, series=3):
    """(series, ts, value): counters with resets, several samples at one instant, gaps of very different length."""
    draw, out = random.Random(seed), []
    for s in range(series):
        at, value = 0, 0
        for _ in range(n if s else 2 * n):
            at += draw.choice([0, 1, 5, 5, 30, 60, 60, 400, 4000])
            value = 0 if draw.random() < 0.1 else value + draw.randint(0, 9)
            out.append((f"s{s}", T0 + dt.timedelta(seconds=at), value))
    return out


def inside(rows, range_s, step_s):
    """(series, t) -> its samples in (t - range, t], in order; t over all multiples of the step."""
    out, by = {}, defaultdict(list)
    for s, ts, v in rows:
        by[s].append((ts, v))
    for s, line in by.items():
        line.sort()
        t = T0 - dt.timedelta(days=1)
        while t <= line[-1][0] + dt.timedelta(seconds=range_s + step_s):
            held = [x for x in line if t - dt.timedelta(seconds=range_s) < x[0] <= t]
            if held:
                out[s, t] = held
            t += dt.timedelta(seconds=step_s)
    return out


def increase(values):
    return sum(b - a if b >= a else b for a, b in zip(values, values[1:], strict=False))


RANGES = [("1 minute", "5 seconds"), ("5 minutes", "1 minute"), ("30 seconds", "2 minutes"), ("1 hour", "1 hour")]


@pytest.mark.parametrize(("range_", "step"), RANGES)
def test_rates_and_last_values(spark, range_, step):
    rows = sampled(7)
    df = spark.createDataFrame(rows, "series string, ts timestamp, value long").repartition(5)
    held, r = inside(rows, MX.seconds(range_), MX.seconds(step)), MX.seconds(range_)
    want = {k: increase([v for _, v in x]) / r for k, x in held.items() if len(x) > 1}
    got = {(x.series, x.t): x.rate for x in MX.rate(df, range_, step).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

    want = {k: (None if x[-1][0] == x[-2][0] else increase([x[-2][1], x[-1][1]]) / (x[-1][0] - x[-2][0]).total_seconds())
            for k, x in held.items() if len(x) > 1}
    got = {(x.series, x.t): x.irate for x in MX.irate(df, range_, step).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)

    got = {(x.series, x.t): x.value for x in MX.gauge_last(df, range_, step).collect()}
    assert got == {k: x[-1][1] for k, x in held.items()}


def test_deltas_by_ranges(spark):
    rows = sampled(3, n=400, series=1)  # one dense series, cut into many ranges
    df = spark.createDataFrame(rows, "series string, ts timestamp, value long").repartition(7)
    line = sorted((ts, v) for _, ts, v in rows)
    for mode, reset in (("drop", lambda v: 0), ("count", lambda v: v)):
        want = sorted((ts, v, v - p if v >= p else reset(v)) for (ts, v), p in zip(line, [0, *(v for _, v in line)], strict=False))
        assert sorted((x.ts, x.value, x.delta) for x in MX.counter_delta(df, on_reset=mode).collect()) == want


def test_samples_inside_a_range_are_not_copied(spark):
    """Two rows per step of a series, however many samples and steps the range holds."""
    rows = [("a", T0 + dt.timedelta(seconds=k), k) for k in range(3000)]
    p = MX.points(spark.createDataFrame(rows, "series string, ts timestamp, value long"), ["series"])
    ends = MX.range_ends(p, F.lit(MX.micros("10 minutes")), MX.micros("1 minute"), "series", "n")
    assert sorted(r["count"] for r in ends.groupBy("t").count().collect()) == [2] * 60  # 50 minutes of samples, 10 of range


def bucket_rows(seed, n=150):
    """(series, ts, k, counts): cumulative bucket counts that restart now and then."""
    draw, out = random.Random(seed), []
    for s in ("a", "b"):
        at, counts = 0, [0] * (len(LATENCY_BOUNDS) + 1)
        for k in range(n):
            at += draw.choice([1, 5, 20, 90])
            if draw.random() < 0.05:
                counts = [0] * len(counts)
            seen = draw.choice([0.00002, 0.0007, 0.003, 0.03, 0.3, 3.0])
            counts = [c + (seen <= b) for c, b in zip(counts, [*LATENCY_BOUNDS, float("inf")], strict=True)]
            out.append((s, T0 + dt.timedelta(seconds=at), k, counts))
    return out


def quantile(cum, q):
    cum = [max(cum[:k + 1]) for k in range(len(cum))]
    if cum[-1] == 0:
        return None
    k = next(i for i, c in enumerate(cum) if c >= q * cum[-1])
    if k == len(LATENCY_BOUNDS):
        return LATENCY_BOUNDS[-1]
    low, prev = (LATENCY_BOUNDS[k - 1], cum[k - 1]) if k else (0.0, 0)
    return low + (LATENCY_BOUNDS[k] - low) * (q * cum[-1] - prev) / (cum[k] - prev)


@pytest.mark.parametrize(("range_", "step"), [("2 minutes", "15 seconds"), ("1 minute", "5 minutes")])
def test_quantiles_of_bucket_rates(spark, range_, step):
    rows = bucket_rows(5)
    df = spark.createDataFrame(rows, "series string, ts timestamp, k int, counts array<long>").repartition(3)
    held = inside([(s, ts, (k, counts)) for s, ts, k, counts in rows], MX.seconds(range_), MX.seconds(step))
    want = {}
    for key, x in held.items():
        up = [increase([v[1][b] for _, v in x]) for b in range(len(LATENCY_BOUNDS) + 1)]
        for q in (0.5, 0.99):
            if len(x) > 1 and (value := quantile(up, q)) is not None:
                want[*key, q] = value
    got = {(x.series, x.t, x.q): x.value for x in MX.range_quantiles(df, (0.5, 0.99), range_, step, order=("k",)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_change_of_latency_is_seen_at_its_step(spark):
    counts, rows = [0] * (len(LATENCY_BOUNDS) + 1), []
    for k in range(400):
        counts = [c + ((0.0002 if k < 200 else 0.2) <= b) for c, b in zip(counts, [*LATENCY_BOUNDS, float("inf")], strict=True)]
        rows.append(("a", T0 + dt.timedelta(seconds=k), counts))
    q = MX.range_quantiles(spark.createDataFrame(rows, "series string, ts timestamp, counts array<long>"), (0.5,), "1 minute", "1 minute")
    values = [r.value for r in q.orderBy("t").collect()]
    assert max(values[:3]) < 0.001 and min(values[4:]) > 0.1  # over all time the median would lie in between


def test_dashboard_has_every_panel_at_some_step(spark):
    out = load_all()["pipeline_overview"].build(spark, "/root/testdata/sf0.01")
    filled = out.agg(*(F.count(x.column).alias(x.column) for x in PANELS)).first()
    assert len(PANELS) == 25 and min(filled) > 20, filled


def test_panels_of_few_metrics_and_missing_samples(spark):
    rows = [("up", "x", 0, T0 + dt.timedelta(seconds=10 * k), float(k)) for k in range(12)] + [
        ("up", "y", 0, T0 + dt.timedelta(seconds=10 * k), float(2 * k)) for k in range(6)] + [
        ("level", "", 0, T0 + dt.timedelta(seconds=35), 7.0), ("other", "", 0, T0, 1.0), ("level", None, 0, T0 + dt.timedelta(seconds=36), 1.0),
        ("level", "", 0, None, 5.0), ("level", "", 0, T0 + dt.timedelta(seconds=37), None)]
    df = spark.createDataFrame(rows, "metric string, label string, le int, ts timestamp, value double")
    panels = (Panel("speed", "rate", "up"), Panel("now", "last", "level", 10.0), Panel("gone", "irate", "nothing"))
    got = {(r.t - T0).seconds: (r.speed, r.now, r.gone) for r in pipeline_overview(
        df, {"rate": "1 minute", "last": "30 seconds", "irate": "1 minute"}, "1 minute", panels).collect()}
    assert got == {60: (6 / 60 - 1 / 60 + 8 / 60, 80.0, None), 120: (4 / 60, None, None)}


def stretched(x, t, range_s):
    """The extrapolated increase of the samples ``x`` (time, value) of a range that ends at ``t``."""
    span = (x[-1][0] - x[0][0]).total_seconds()
    if span == 0:
        return None
    up, mean = increase([v for _, v in x]), span / (len(x) - 1)
    to_start, to_end = range_s - (t - x[0][0]).total_seconds(), (t - x[-1][0]).total_seconds()
    to_start, to_end = (g if g < 1.1 * mean else mean / 2 for g in (to_start, to_end))
    if up > 0:
        to_start = min(to_start, span * x[0][1] / up)
    return up * (span + to_start + to_end) / span


@pytest.mark.parametrize(("range_", "step"), RANGES)
def test_extrapolated_rates(spark, range_, step):
    rows, r = sampled(11), MX.seconds(range_)
    df = spark.createDataFrame(rows, "series string, ts timestamp, value long").repartition(4)
    want = {k: y / r for k, x in inside(rows, r, MX.seconds(step)).items() if len(x) > 1 and (y := stretched(x, k[1], r)) is not None}
    got = {(x.series, x.t): x.rate for x in MX.extrapolated_rate(df, range_, step).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_buckets_that_hide_a_reset(spark):
    """(1, 1, 1) after (0, 2, 2): the first bucket grew by 1, the others show no reset of their own but the last ones do."""
    n = len(LATENCY_BOUNDS) + 1
    rows = [("a", T0 + dt.timedelta(seconds=s), [first] + [rest] * (n - 1)) for s, first, rest in ((10, 0, 1), (20, 1, 1), (30, 1, 2))]
    df = spark.createDataFrame(rows, "series string, ts timestamp, counts array<long>")
    got = {(r.t - T0).seconds: r.value for r in MX.range_quantiles(df, (1.0,), "15 seconds", "10 seconds").collect()}
    assert got[20] == LATENCY_BOUNDS[0]  # increases (1, 0, 0, ...): one observation in the first bucket
