"""Hand-made edge cases for each semantic note (N1-N12) and brute-force checks."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedspark.functions import messages as M
from feedspark.functions import payload as P
from feedspark.operators import counters as C
from feedspark.operators import feeds as FD
from feedspark.operators import metrics as MX
from feedspark.operators import users as U
from feedspark.operators.dedup import anchored_ttl_epochs, first_seen_dedup
from feedspark.operators.retention import feed_top_n, retain_last_global, retain_last_per_topic
from feedspark.plans.feed import user_feed
from feedspark.plans.ordering import numbered, range_lag, running_sum

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "uid long, ts timestamp, entry_id string, doc string")


# --- N2: anchored 24 h lives -----------------------------------------------------------
def test_ttl_boundaries(spark):
    rows = [
        (1, T0, "e1", "A"),
        (1, T0 + 6 * H, "e2", "A"),                               # same life: duplicate
        (1, T0 + 23 * H + dt.timedelta(minutes=59), "e3", "B"),
        (1, T0 + 24 * H, "e4", "A"),                              # exactly 24 h: new life
        (1, T0 + 30 * H, "e5", "A"),                              # duplicate in life 2
        (1, T0 + 48 * H, "e6", "A"),                              # life 3
        (2, T0 + 5 * H, "e7", "A"),                               # other user: own clock
    ]
    df = _attempts(spark, rows)
    kept = {r.entry_id for r in first_seen_dedup(df, "doc").collect()}
    assert kept == {"e1", "e3", "e4", "e6", "e7"}
    anchors = sorted((r.uid, r.anchor) for r in anchored_ttl_epochs(df).collect())
    assert anchors == [(1, T0), (1, T0 + 24 * H), (1, T0 + 48 * H), (2, T0 + 5 * H)]


def _brute_anchors(rows, ttl):
    out = set()
    by = {}
    for uid, ts, *_ in rows:
        by.setdefault(uid, []).append(ts)
    for uid, tss in by.items():
        anchor = None
        for ts in sorted(tss):
            if anchor is None or ts >= anchor + ttl:
                anchor = ts
                out.add((uid, ts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchor_walk_equals_loop_across_arrow_batches(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        uid = rnd.choice([1, 2, 3, 4, 5, 6, 7])
        rows.append((uid, T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 9)), f"e{i}", f"d{rnd.randint(0, 9)}"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many batch boundaries
    try:
        got = {(r.uid, r.anchor) for r in anchored_ttl_epochs(_attempts(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == _brute_anchors(rows, 24 * H)


def test_dedup_equals_loop(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 4), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5)), f"e{i:04d}",
             f"d{rnd.randint(0, 5)}") for i in range(300)]
    expect = set()
    for uid in {r[0] for r in rows}:
        anchor, seen = None, set()
        for r in sorted((r for r in rows if r[0] == uid), key=lambda r: (r[1], r[2])):
            if anchor is None or r[1] >= anchor + 24 * H:
                anchor, seen = r[1], set()
            if r[3] not in seen:
                seen.add(r[3])
                expect.add(r[2])
    got = {r.entry_id for r in first_seen_dedup(_attempts(spark, rows), "doc").collect()}
    assert got == expect


# --- N1: identity ---------------------------------------------------------------------
def test_empty_or_null_id_falls_back_to_entry_id(spark):
    df = spark.createDataFrame([("7", "1-0"), ("", "2-0"), (None, "3-0")], "id string, entry_id string")
    assert [r.d for r in df.select(P.doc_identity().alias("d")).collect()] == ["7", "2-0", "3-0"]


# --- bounded plan = exact plan when documents do not repeat ----------------------------
def test_bounded_fanout_equals_naive(spark):
    rnd = random.Random(3)
    topics = ["politics", "business", "sports"]
    msgs = [(f"{i}-0", T0 + dt.timedelta(minutes=7 * i), str(i), topics[rnd.randint(0, 2)]) for i in range(300)]
    subs = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 2000)), t) for u in range(40) for t in topics
            if rnd.random() < 0.6]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    a = {tuple(r) for r in user_feed(m, s, n=20, bounded=True).collect()}
    b = {tuple(r) for r in user_feed(m, s, n=20, bounded=False).collect()}
    assert a == b and len(a) > 0


# --- chunked numbering = plain window -------------------------------------------------
def test_numbering_and_running_sum_equal_windows(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 6)), i, rnd.randint(-5, 9))
            for i in range(500)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id long, v int")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = {(r.id, r.rn, r.s) for r in df.select(
        "id", F.row_number().over(w).alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    a = numbered(df, ["k"], ["ts", "id"], out="rn")
    b = running_sum(a, ["k"], ["ts", "id"], F.col("v"), out="s")
    assert {(r.id, r.rn, r.s) for r in b.collect()} == plain


# --- B12 relative age ----------------------------------------------------------------
def test_relative_age_thresholds(spark):
    now = "2024-01-20 00:00:00"
    now_ms = int(dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc).timestamp() * 1000)
    cases = {
        f"{now_ms - 89_900}-0": "89 s ago",
        f"{now_ms - 90_000}-0": "1 m ago",
        f"{now_ms - 5_399_000}-0": "89 m ago",
        f"{now_ms - 5_400_000}-0": "1 h ago",
        f"{now_ms - 172_799_000}-0": "47 h ago",
        f"{now_ms - 172_800_000}-0": "18 Jan",
        f"{now_ms + 1_500}-0": "-1 s ago",
        "abc-1": "",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "entry_id string")
    got = {r.entry_id: r.age for r in df.select("entry_id", M.relative_age("entry_id", now).alias("age")).collect()}
    assert got == cases


# --- N8 / B8-B10 message view ----------------------------------------------------------
def test_preview_null_vs_empty(spark):
    df = spark.createDataFrame([("", "x"), (None, "x"), ("", ""), (None, None), ("s", None)],
                               "summary string, body string")
    got = [r.p for r in df.select(M.message_preview().alias("p")).collect()]
    assert got == ["", "x", None, None, "s"]


def test_chips_ordered_distinct_without_falsy(spark):
    df = spark.createDataFrame([(["a", "", "a", "b"], "c"), (None, "a"), (["b", None], "")],
                               "tags array<string>, topic string")
    got = [r.c for r in df.select(F.array_join(M.message_chips(), "|").alias("c")).collect()]
    assert got == ["a|b|c", "a", "b"]


def test_normalize_fallbacks(spark):
    df = spark.createDataFrame([("1-0", None, None, None, None, None, None, None)],
                               "entry_id string, id string, title string, text string, summary string, "
                               "body string, tags array<string>, topic string")
    r = M.normalize_message(df).first()
    assert r.title == "[no-title]" and r.tags == [] and r.id is not None and r.summary is None


# --- N9 conditional topic filter --------------------------------------------------------
def test_feed_topic_filter_only_when_it_applies(spark):
    feed = spark.createDataFrame([(1, "e1", "x", 1), (1, "e2", "z", 2)], "uid long, entry_id string, topic string, pos int")
    users = spark.createDataFrame([(1, ["x", "y"])], "uid long, interests array<string>")
    def run(active):
        return sorted(r.entry_id for r in FD.feed_topic_filter(feed, users, F.lit(active)).collect())
    assert run("x") == ["e1"]          # interest and present: filter
    assert run("y") == ["e1", "e2"]    # interest, not in the feed: no filter
    assert run("z") == ["e1", "e2"]    # in the feed, not an interest: no filter


# --- F12 vs H1 on a counter reset -------------------------------------------------------
def test_counter_reset_delta_vs_increase(spark):
    s = spark.createDataFrame([("c", T0 + 19 * H, 5), ("c", T0 + 20 * H, 8), ("c", T0 + 21 * H, 2)],
                              "series string, ts timestamp, value long")
    assert [r.delta for r in MX.counter_delta(s).orderBy("ts").collect()] == [5, 3, 0]
    assert [r.delta for r in MX.counter_delta(s, on_reset="count").orderBy("ts").collect()] == [5, 3, 2]
    r = MX.rate(s, "6 hours", "1 day").first()
    assert r.rate == pytest.approx((3 + 2) / 21600)


def test_hist_quantile_interpolation_and_inf(spark):
    b = spark.createDataFrame([("s", 0.1, 10), ("s", 0.2, 20), ("s", float("inf"), 21)],
                              "series string, le double, cum_count long")
    got = {r.q: r.value for r in MX.hist_quantile(b, [0.5, 0.99], ["series"]).collect()}
    assert got[0.5] == pytest.approx(0.1 + 0.1 * (10.5 - 10) / 10)
    assert got[0.99] == pytest.approx(0.2)  # rank in +Inf -> last finite bound


# --- F9 / C3 held tail ---------------------------------------------------------------------
@pytest.mark.parametrize("n,full", [(31, 0), (32, 32), (33, 32)])
def test_batch_tail(spark, n, full):
    log = spark.createDataFrame([(f"{i}-0", T0 + dt.timedelta(seconds=i)) for i in range(n)],
                                "entry_id string, entry_ts timestamp")
    assert FD.batch_full(FD.micro_batches(log, 32)).count() == full


# --- F10 toggle = sequential fold --------------------------------------------------------
def test_toggle_equals_fold(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(1, 3), T0 + dt.timedelta(minutes=i), i, rnd.choice("abc")) for i in range(200)]
    expect = {}
    for uid in {r[0] for r in rows}:
        cur = None
        for r in sorted((r for r in rows if r[0] == uid), key=lambda r: r[2]):
            cur = None if cur == r[3] else r[3]
            expect[r[2]] = cur
    df = spark.createDataFrame(rows, "uid long, ts timestamp, event_id long, tag string")
    got = {r.event_id: r.active for r in FD.toggle_topic(df).collect()}
    assert got == expect


# --- F7, D4, D5, E12 -----------------------------------------------------------------------
def test_fifo_and_lookup_and_upsert(spark):
    feed = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "uid long, pos int")
    pops = spark.createDataFrame([(1, 2), (9, 5)], "uid long, k long")
    got = {(r.uid, r.popped, r.remaining) for r in FD.fifo_consume(feed, pops).collect()}
    assert got == {(1, 2, 1), (2, 0, 1)}
    users = spark.createDataFrame([(0, ["news"])], "uid long, interests array<string>")
    req = spark.createDataFrame([(0,), (99,)], "uid long")
    look = {r.uid: (r.interests, r.known) for r in U.user_interests_lookup(req, users).collect()}
    assert look == {0: (["news"], True), 99: ([], False)}
    new = spark.createDataFrame([(0, ["x"]), (1, ["y"])], "uid long, interests array<string>")
    once = U.upsert_users(new, users)
    twice = U.upsert_users(new, once)
    assert {(r.uid, tuple(r.interests)) for r in twice.collect()} == {(0, ("news",)), (1, ("y",))}
    assert U.users_seeded(new, once).first().asDict() == {"created": 0, "skipped": 2}


# --- B5 / B6 payload decoding -------------------------------------------------------------
def test_topic_payload_raw_fallback(spark):
    df = spark.createDataFrame([('{"id":"1","title":"t"}',), ("not json",), (None,)], "data string")
    is_bare, parsed, raw = P.decode_payload_topic("data")
    got = [(r.b, r.t, r.raw) for r in df.select(is_bare.alias("b"), parsed["title"].alias("t"), raw.alias("raw")).collect()]
    assert got == [(False, "t", None), (False, None, "not json"), (True, None, None)]


def test_feed_payload_failfast(spark):
    df = spark.createDataFrame([("not json",)], "data string")
    with pytest.raises(Exception):
        df.select(P.decode_payload_feed("data").alias("p")).collect()


def test_parse_entry_id(spark):
    df = spark.createDataFrame([("123-4",), ("abc",), ("",), ("77",)], "e string")
    assert [r.ms for r in df.select(M.parse_entry_id("e").alias("ms")).collect()] == [123, None, None, 77]


# --- B15 -------------------------------------------------------------------------------------
def test_reader_rate_rules(spark):
    assert M.resolve_fixed_rps(4.0, None) == 4.0
    assert M.resolve_fixed_rps(4.0, "5") == 5.0
    assert M.resolve_fixed_rps(4.0, "x") is None
    df = spark.createDataFrame([(0,), (100,), (10_000,)], "latest_uid long")
    got = [r.r for r in df.select(M.target_rps("latest_uid").alias("r")).collect()]
    assert got == [1.0, 5.0, 200.0]
    assert 1.0 / df.select(M.target_rps("latest_uid", 5.0).alias("r")).first().r == pytest.approx(0.2)


# --- retention (reference tests: 6000 -> 5000, 200 -> 100) -----------------------------------------
def test_retention_caps(spark):
    log = spark.range(6000).select(F.concat(F.col("id").cast("string"), F.lit("-0")).alias("entry_id"),
                                   F.timestamp_seconds("id").alias("entry_ts"),
                                   (F.col("id") % 2).cast("string").alias("topic"))
    assert retain_last_global(log, 5000).count() == 5000
    per = retain_last_per_topic(log.where(F.col("id") < 200).withColumn("topic", F.lit("t")), 100)
    assert per.count() == 100
    assert per.agg(F.min("entry_ts")).first()[0] == dt.datetime(1970, 1, 1, 0, 1, 40)


def test_feed_cap_99_100_101(spark):
    for n, expect in [(99, 99), (100, 100), (101, 100)]:
        d = spark.range(n).select(F.lit(1).alias("uid"), F.timestamp_seconds("id").alias("ts"),
                                  F.col("id").cast("string").alias("entry_id"))
        assert feed_top_n(d, 100).count() == expect


def test_topic_without_subscriber_counts_zero(spark):
    subs = spark.createDataFrame([(1, "politics")], "uid long, topic string")
    got = {r.topic: r.subscribers for r in U.topic_subscribers(subs, subs).collect()}
    assert got["politics"] == 1 and got["finance"] == 0 and len(got) == 10


def test_latency_buckets_cumulative(spark):
    s = spark.createDataFrame([("a", 0.00004), ("a", 0.003), ("a", 2.0)], "series string, seconds double")
    h = {r.le: r.cum_count for r in C.latency_histogram(s).collect()}
    assert h[0.00005] == 1 and h[0.005] == 2 and h[1.0] == 2 and h[float("inf")] == 3


# --- lives in time ranges = lives of one walk -------------------------------------------------
@pytest.mark.parametrize("ranges", [1, 3, 12])
def test_epochs_in_ranges_equal_one_walk(spark, ranges):
    """One user with most rows, silent users, equal times, ranges shorter than a life; the edges cut lives."""
    from feedspark.operators.dedup import epochs_in_ranges

    draw = random.Random(ranges)
    rows = [(1, T0 + dt.timedelta(seconds=draw.randrange(9 * 86400))) for _ in range(900)]
    rows += [(draw.randrange(2, 30), T0 + H * draw.randrange(9 * 24)) for _ in range(250)]
    att = spark.createDataFrame(rows + rows[:20], "uid long, ts timestamp")
    whole = sorted(tuple(r) for r in anchored_ttl_epochs(att).collect())
    assert sorted(tuple(r) for r in epochs_in_ranges(att, ranges).collect()) == whole
    assert epochs_in_ranges(att.limit(0), ranges).count() == 0


def test_attempts_before_a_carried_life_open_none(spark):
    from feedspark.operators.dedup import epoch_anchors

    us = lambda h: int((T0 + H * h).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    att = spark.createDataFrame([(1, T0 + H * h) for h in (2, 30, 33, 34, 60)] + [(2, T0 + H * 5)], "uid long, ts timestamp")
    known = spark.createDataFrame([(1, us(-40)), (1, us(10)), (3, us(1))], "uid long, anchor_us long")
    got = {tuple(r) for r in epoch_anchors(att, carried=known).collect()}
    assert got == {(1, us(34)), (1, us(60)), (2, us(5))}  # 2 is older, 30 and 33 lie in the carried life


@pytest.mark.parametrize("ranges", [2, 6])
def test_timeline_and_feed_in_ranges_equal_one_walk(spark, ranges):
    from feedspark.operators.dedup import time_edges, timeline_anchors, timeline_in_ranges
    from feedspark.plans.feed import user_feed

    draw = random.Random(30 + ranges)
    topics = ["sports", "health", "politics"]
    m = spark.createDataFrame([(f"{k}-0", T0 + H * draw.randrange(400), str(draw.randrange(60)), draw.choice(topics)) for k in range(300)],
                              "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame([(u, T0 + H * draw.randrange(380), tp) for u in range(40) for tp in draw.sample([*topics, "science"], 2)],
                              "uid long, created_ts timestamp, topic string")
    times, us = m.select("topic", "entry_ts"), F.unix_micros("entry_ts")
    whole = {tuple(r) for r in timeline_anchors(times, s, block_users=7).collect()}
    assert {tuple(r) for r in timeline_in_ranges(times, s, ranges, block_users=7).collect()} == whole and len(whole) > 100
    until = time_edges(times, us, ranges)[-2]
    lives = timeline_in_ranges(times.where(us < until), s, ranges)
    feed = lambda **k: sorted(tuple(r) for r in user_feed(m, s, n=20, **k).collect())
    assert feed(lives=lives, lives_until_us=until) == feed(bounded=False)


# --- timeline anchors = anchors walked over the attempts --------------------------------------
def test_timeline_anchors_equal_attempt_walk(spark):
    from feedspark.operators.dedup import epoch_anchors, timeline_anchors
    from feedspark.operators.fan_out import fanout_visible_keys

    rnd = random.Random(21)
    topics = ["politics", "business", "sports", "health"]
    msgs = [(f"{i}-0", T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 8)), str(i % 50),
             rnd.choice(topics[:3])) for i in range(400)]   # 'health' has no messages
    subs = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 6)), t) for u in range(30) for t in topics
            if rnd.random() < 0.5]                           # created time differs per topic
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, doc string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    att = fanout_visible_keys(m, s).withColumnRenamed("entry_ts", "ts")
    walked = {tuple(r) for r in epoch_anchors(att).collect()}
    timeline = {tuple(r) for r in timeline_anchors(m.select("topic", "entry_ts"), s).collect()}
    assert timeline == walked and len(walked) > 0


def test_hybrid_feed_equals_plain_chain_with_repeats(spark):
    rnd = random.Random(4)
    topics = ["politics", "business", "sports"]
    msgs = []
    for i in range(250):
        ts = T0 + dt.timedelta(minutes=9 * i)
        tp = topics[rnd.randint(0, 2)]
        msgs.append((f"{i}-0", ts, str(i), tp))
        if i % 4 == 0:   # re-ingested copies: same doc 6 h and 30 h later
            msgs.append((f"{i}-1", ts + 6 * H, str(i), tp))
            msgs.append((f"{i}-2", ts + 30 * H, str(i), tp))
    subs = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 1500)), t) for u in range(40) for t in topics
            if rnd.random() < 0.6]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    a = {tuple(r) for r in user_feed(m, s, n=15).select("uid", "entry_id", "pos").collect()}
    b = {tuple(r) for r in user_feed(m, s, n=15, bounded=False).select("uid", "entry_id", "pos").collect()}
    assert a == b and len(a) > 0


@pytest.mark.parametrize("strategy", ["salted", "shuffle"])
def test_fanout_strategies_agree(spark, strategy):
    from feedspark.operators.fan_out import fanout_join, fanout_visible

    rnd = random.Random(9)
    topics = ["politics", "business", "sports"]
    msgs = [(f"{i}-0", T0 + dt.timedelta(minutes=5 * i), str(i), rnd.choice(topics)) for i in range(120)]
    subs = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 600)), t) for u in range(25) for t in topics
            if rnd.random() < 0.5]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    for op in (fanout_join, fanout_visible):
        base = {tuple(r) for r in op(m, s, strategy="broadcast").collect()}
        other = {tuple(r) for r in op(m, s, strategy=strategy, salts=7).collect()}
        assert base == other and len(base) > 0


def test_chunked_lag_equals_lag(spark):
    from feedspark.plans.ordering import chunked_lag

    rnd = random.Random(13)
    rows = [(rnd.randint(0, 2), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), i, rnd.randint(0, 99))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id long, v int")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = {(r.id, r.p) for r in df.select("id", F.lag("v").over(w).alias("p")).collect()}
    got = {(r.id, r.p) for r in chunked_lag(df, ["k"], F.to_date("ts"), ["ts", "id"], "v", out="p").collect()}
    assert got == {(r.id, r.p) for r in range_lag(df, ["k"], ["ts", "id"], "v", out="p").collect()}
    assert got == plain


@pytest.mark.parametrize("seed", [31, 32])
def test_candidate_window_feed_equals_plain_chain(spark, seed):
    """Many copies at random gaps (minutes to days), copies across topics, small N."""
    rnd = random.Random(seed)
    topics = ["politics", "business", "sports", "health"]
    msgs, i = [], 0
    for d in range(120):
        base = T0 + dt.timedelta(minutes=23 * d)
        for c in range(rnd.choice([1, 1, 1, 2, 3, 5])):
            gap = dt.timedelta(minutes=rnd.choice([0, 7, 90, 60 * 23, 60 * 24, 60 * 25, 60 * 50]) * c)
            msgs.append((f"{i}-{c}", base + gap, str(d), rnd.choice(topics)))
            i += 1
    subs = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 3000)), t) for u in range(30) for t in topics
            if rnd.random() < 0.5]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    for n in (3, 10):
        a = {tuple(r) for r in user_feed(m, s, n=n).select("uid", "entry_id", "pos").collect()}
        b = {tuple(r) for r in user_feed(m, s, n=n, bounded=False).select("uid", "entry_id", "pos").collect()}
        assert a == b and len(a) > 0


def test_push_counts_equal_join_counts(spark):
    from feedspark.operators.deliveries import visible_push_counts
    from feedspark.operators.fan_out import fanout_visible

    rnd = random.Random(17)
    topics = ["politics", "business", "sports"]
    msgs = [(f"{i}-0", T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 4)), str(i), rnd.choice(topics))
            for i in range(150)]
    subs = [(u, T0 + dt.timedelta(minutes=rnd.choice([0, 60 * 24, 60 * 30, rnd.randint(0, 60 * 24 * 4)])), t)
            for u in range(40) for t in topics if rnd.random() < 0.5]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    joined = {r.entry_id: r["count"] for r in fanout_visible(m, s).groupBy("entry_id").count().collect()}
    counted = {r.entry_id: r.pushes for r in visible_push_counts(m, s).collect()}
    assert {k: v for k, v in counted.items() if v} == joined
    assert set(counted) == {r[0] for r in msgs}


def test_relative_age_now_column(spark):
    df = spark.createDataFrame([("1705708800000-0", dt.datetime(2024, 1, 20, 0, 2))], "entry_id string, now timestamp")
    assert df.select(M.relative_age("entry_id", F.col("now")).alias("a")).first().a == "2 m ago"


def test_rows_dynamic_from_csv(spark):
    from feedspark.session import scratch_path
    from feedspark.sources.articles import scan_rows_dynamic_csv, write_articles_csv

    path = scratch_path(spark, "dyn-csv")
    write_articles_csv(spark.createDataFrame([("1", "a", "", "x")], "id string, title string, text string, extra string"), path)
    r = scan_rows_dynamic_csv(spark, path).first().fields
    assert r == {"id": "1", "title": "a", "text": "", "extra": "x"}


def test_csv_to_parquet_round_trip(spark):
    from feedspark.session import scratch_path
    from feedspark.sources.articles import articles_csv_to_parquet, write_articles_csv

    rows = [("1", "t", 'a "quoted"\\nline '), ("2", " x", "")]
    src, out = scratch_path(spark, "csv"), scratch_path(spark, "pq")
    write_articles_csv(spark.createDataFrame(rows, "id string, title string, text string"), src)
    got = {tuple(r) for r in articles_csv_to_parquet(spark, src, out, 2).collect()}
    assert got == {(i, t, x, "unknown") for i, t, x in rows}


def test_topic_payload_that_is_no_object_stays_raw(spark):
    values = ["123", '"hello"', "[1,2]", "null", '{"id":"7","extra":"kept","n":5}', "{}"]
    df = spark.createDataFrame([(v,) for v in values], "data string")
    _, parsed, raw = P.decode_payload_topic("data")
    got = {r.data: (r.raw, r.id, r.f) for r in df.select(
        "data", raw.alias("raw"), parsed["id"].alias("id"), P.payload_fields().alias("f")).collect()}
    assert got == {v: (v, None, None) for v in values[:4]} | {
        values[4]: (None, "7", {"id": "7", "extra": "kept", "n": "5"}), "{}": (None, None, {})}


# --- log order, users without a record, NULL active topic ---------------------------------
def test_log_order_is_numeric(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(t0, f"1-{k}", "politics") for k in range(12)], "entry_ts timestamp, entry_id string, topic string")
    newest = ["1-11", "1-10"]
    assert [r.entry_id for r in retain_last_per_topic(log, 2).orderBy("pos").collect()] == newest
    assert [r.entry_id for r in retain_last_global(log, 2).collect()] == newest
    assert [r.entry_id for r in FD.backlog_latest(log, ["topic"], 2).orderBy("pos").collect()] == newest[::-1]
    batches = {r.entry_id: r.batch_no for r in FD.micro_batches(log, 10).collect()}
    assert batches["1-9"] == 0 and batches["1-10"] == batches["1-11"] == 1


def test_feeds_of_users_without_a_record(spark):
    feed = spark.createDataFrame([(1, "1-0", "sports"), (1, "2-0", "health"), (2, "1-0", "sports")], "uid long, entry_id string, topic string")
    users = spark.createDataFrame([(1, ["sports"])], "uid long, interests array<string>")
    count = lambda active: FD.feed_topic_filter(feed, users, active).count()
    assert count(F.lit("sports")) == 2 and count(F.lit(None).cast("string")) == 3
    assert {(r.uid, r.interests is None) for r in U.feed_user_context(feed, users).collect()} == {(1, False), (2, True)}
    clicks = spark.createDataFrame([(u, dt.datetime(2024, 1, 1, h), h, tag) for u in (1, 2) for h, tag in enumerate(["sports", "health", "health"])],
                                   "uid long, ts timestamp, event_id long, tag string")
    reset = {(r.uid, r.event_id): r.active for r in FD.reset_topic_on_switch(clicks, users).collect()}
    assert reset == {(1, 0): "sports", (1, 1): None, (1, 2): None, (2, 0): "sports", (2, 1): "health", (2, 2): None}
    # what the toggles give, NULL included, filters the feeds
    on = FD.toggle_topic(clicks).where("event_id = 2").select("uid", F.col("active").alias("chosen"))
    assert FD.feed_topic_filter(feed.join(on, "uid"), users, F.col("chosen")).count() == 3


def test_every_label_of_the_prototypes_competes(spark):
    from feedspark.operators import classify as CL

    protos = spark.createDataFrame([(k, [float(k == i) for i in range(12)]) for k in range(12)], "label long, proto array<double>")
    items = spark.createDataFrame([(k, [1000.0 * (k == i) for i in range(12)]) for k in range(12)], "key long, embedding array<double>")
    got = {r.key: (r.predicted, r.score) for r in CL.classify_by_prototype(items, protos, "key").collect()}
    assert {k: p for k, (p, _) in got.items()} == {k: k for k in range(12)} and all(0 < s <= 1 for _, s in got.values())


def test_block_walk_equals_attempt_walk_over_many_blocks_and_batches(spark):
    from feedspark.operators.dedup import epoch_anchors, timeline_anchors
    from feedspark.operators.fan_out import fanout_visible

    draw = random.Random(11)
    m = spark.createDataFrame([(f"{k}-0", T0 + H * draw.randrange(900), str(k), draw.choice(["sports", "health", "politics"])) for k in range(700)],
                              "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame([(u, T0 + H * draw.randrange(800), tp) for u in range(60) for tp in draw.sample(["sports", "health", "politics", "science"], 2)],
                              "uid long, created_ts timestamp, topic string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {tuple(r) for r in timeline_anchors(m, s, block_users=7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    att = fanout_visible(m, s).withColumnRenamed("entry_ts", "ts")
    assert got == {tuple(r) for r in epoch_anchors(att).collect()} and len(got) > 100


def test_one_hot_key_in_one_day_is_numbered_by_many_tasks(spark):
    from feedspark.plans.ordering import range_chunks

    df = spark.range(0, 20_000, 1, 8).select((F.col("id") % 10 == 0).cast("int").alias("k"), (F.col("id") % 80_000).alias("ts"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or this little data is one range
    try:
        _check_hot_key(df, range_chunks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _check_hot_key(df, range_chunks):
    cut = range_chunks(df, ["k"], ["ts", "id"])
    assert cut.where("k = 0").select("_chunk").distinct().count() > 1
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = {tuple(r) for r in df.select("id", F.row_number().over(w), F.sum("id").over(w), F.lag("id").over(w)).collect()}
    got = range_lag(running_sum(numbered(df, ["k"], ["ts", "id"]), ["k"], ["ts", "id"], F.col("id"), out="s"), ["k"], ["ts", "id"], "id", out="p")
    assert {tuple(r) for r in got.select("id", "rn", "s", "p").collect()} == plain


def _fold(clicks):
    """Active topic after each click, one after the other."""
    active, out = {}, {}
    for uid, ts, event_id, tag in sorted(clicks, key=lambda c: (c[0] is not None, c[0] or 0, c[1], c[2])):
        active[uid] = None if active.get(uid, "-") == tag else tag
        out[event_id] = active[uid]
    return out


@pytest.mark.parametrize("tags", ["a", "ab", "aaaaaaab", "abc"])
def test_toggles_equal_the_fold_on_a_key_with_most_rows(spark, tags):
    import random

    draw = random.Random(len(tags))
    clicks = [(7 if draw.random() < 0.9 else draw.randint(1, 5), draw.randint(0, 400), k, draw.choice(tags)) for k in range(3000)]
    df = spark.createDataFrame(clicks, "uid long, ts long, event_id long, tag string").repartition(6)
    got = {r.event_id: r.active for r in FD.toggle_topic(df).collect()}
    assert got == _fold(clicks)


def test_run_positions_across_many_ranges(spark):
    """Runs that fill whole ranges, end in the middle of one, and NULLs, which are equal to each other."""
    from itertools import groupby

    from feedspark.plans.ordering import run_positions

    values = ["a"] * 900 + ["b"] + ["a"] * 3 + [None] * 700 + ["a", None] * 20 + ["c"] * 400
    rows = [(1, k, v) for k, v in enumerate(values)] + [(None, k, "z") for k in range(40)]
    want = {(1, k): None for k in range(len(values))}
    at = 0
    for _, run in groupby(values):
        for place, _ in enumerate(run, 1):
            want[1, at] = place
            at += 1
    want |= {(None, k): k + 1 for k in range(40)}
    got = run_positions(spark.createDataFrame(rows, "key long, at long, v string").repartition(5), ["key"], ["at"], "v")
    assert {(r.key, r["at"]): r.run_pos for r in got.collect()} == want
