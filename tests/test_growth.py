"""Work that grows no faster than the tables: merged walks, stored lives, payloads, tails and first rows."""

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedspark.catalog import load_all
from feedspark.operators import dedup as D
from feedspark.operators import feeds as FD
from feedspark.operators.fan_out import message_keys
from feedspark.plans.feed import feed_candidates, feed_with_payload, lives_needed_from, user_feed
from feedspark.session import checkpoint_dir
from feedspark.sources import articles as A

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


# --- walks of users that go on alike -----------------------------------------------------------
def _block(users, times):
    subs = [(0, 0, u, t, since) for u, topics, since in users for t in topics]
    rows = sorted(subs + [(0, 1, None, t, us) for t, us in times], key=lambda r: (r[1], r[4]))
    df = pd.DataFrame(rows, columns=["block", "kind", "uid", "topic", "us"])
    df["uid"] = df["uid"].astype("Float64").astype("float64")
    return [df[k:k + 300] for k in range(0, len(df), 300)]


def _walk(frames, *args):
    return [(int(u), int(a)) for p in D._block_walker(*args)(iter(frames)) for u, a in zip(p["uid"], p["anchor_us"], strict=True)]


def _lives(users, times, ttl):
    out = set()
    for u, topics, since in users:
        due = since
        for us in sorted(us for t, us in times if t in topics):
            if us >= due:
                out.add((u, us))
                due = us + ttl
    return out


def _crowd(n):
    draw = random.Random(n)
    users = [(u, draw.choice(["a", "ab", "bc", "c"]), draw.randrange(500)) for u in range(n)]
    return users, [(draw.choice("abc"), draw.randrange(10_000)) for _ in range(1500)]


def test_a_walk_for_all_users_that_go_on_alike(monkeypatch):
    """The look-ups follow topic sets x lives; they were users x lives."""
    users, times = _crowd(400)
    frames, looked_up, search = _block(users, times), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": (looked_up.append(np.size(v)), search(a, v, side))[1])
    got = _walk(frames, 24, -(1 << 62))
    want = _lives(users, times, 24)
    assert len(got) == len(want) and set(got) == want and len(want) > 80_000
    assert sum(looked_up) < len(want) / 2


@pytest.mark.parametrize("floor", [0, 5_000, 9_990, 20_000])
def test_the_newest_of_the_lives_that_are_left_out(floor):
    users, times = _crowd(60)
    got, whole = _walk(_block(users, times), 24, floor, True), _lives(users, times, 24)
    newest = {}
    for u, a in whole:
        newest[u] = max(a, newest.get(u, a))
    assert len(got) == len(set(got)) and set(got) == {x for x in whole if x[1] >= floor} | set(newest.items())


# --- stored lives --------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_feed_goes_on_from_the_lives_that_it_needs(spark, seed):
    draw = random.Random(seed)
    topics = ["politics", "business", "sports", "rare"]
    msgs = [(f"{k}-0", T0 + H * draw.randrange(1200), str(draw.randrange(250) if draw.random() < 0.4 else 1000 + k),
             "rare" if draw.random() < 0.02 else draw.choice(topics[:3])) for k in range(700)]
    subs = [(u, T0 + H * draw.randrange(800), t) for u in range(25) for t in topics if draw.random() < 0.6]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, created_ts timestamp, topic string")
    times, us = m.select("topic", "entry_ts"), F.unix_micros("entry_ts")
    until = D.time_edges(times, us, 4)[-2]
    since = lives_needed_from(m.where(us < until), until, 20)
    lives = D.timeline_in_ranges(times.where(us < until), s, 3, emit_from_us=since).checkpoint()
    whole = D.timeline_anchors(times.where(us < until), s)
    assert lives.count() == lives.distinct().count() and lives.exceptAll(whole).isEmpty()
    assert lives.where(F.col("anchor_us") < since).count() <= 3 * 25
    feed = lambda **k: sorted(tuple(r) for r in user_feed(m, s, n=20, **k).collect())
    assert feed(lives=lives, lives_until_us=until) == feed(bounded=False)


def test_few_lives_are_stored_of_a_long_history(spark):
    """Copies of the last hours need lives of the last days; all lives of all users were stored."""
    msgs = [(f"{k}-0", T0 + 6 * H * k, str(k if k < 1990 else 1990 + k % 4), "sports") for k in range(2000)]
    m = spark.createDataFrame(msgs, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.range(50).select(F.col("id").alias("uid"), F.lit(T0).alias("created_ts"), F.lit("sports").alias("topic"))
    us = F.unix_micros("entry_ts")
    until = D.time_edges(m, us, 4)[-2]
    since = lives_needed_from(m.where(us < until), until, 20)
    lives = D.timeline_in_ranges(m.where(us < until).select("topic", "entry_ts"), s, 3, emit_from_us=since)
    assert lives.count() < 50 * 20 < D.timeline_anchors(m.where(us < until).select("topic", "entry_ts"), s).count()


# --- payload ---------------------------------------------------------------------------------------
def test_payload_of_the_messages_in_reach(spark):
    rows = [(f"{k}-0", T0 + H * k, str(k), "sports", f"t{k}", "x" * k) for k in range(300)] + [("299-0", T0, "299", "sports", "again", None)]
    m = spark.createDataFrame(rows, "entry_id string, entry_ts timestamp, id string, topic string, title string, text string")
    s = spark.range(9).select(F.col("id").alias("uid"), F.lit(T0).alias("created_ts"), F.lit("sports").alias("topic"))
    reach = feed_candidates(message_keys(m), 10).checkpoint()
    feed = user_feed(m, s, n=10, candidates=reach).checkpoint()
    want = sorted(map(repr, feed_with_payload(feed, m).collect()))
    near = feed_with_payload(feed, m, reach=reach)
    assert sorted(map(repr, near.collect())) == want and len(want) > 90
    assert sorted(map(repr, feed_with_payload(feed, m, reach=reach, max_bytes=0).collect())) == want
    assert "ResolvedHint (strategy=broadcast)" in near._jdf.queryExecution().analyzed().toString()


def test_bodies_are_digested_once_an_article(spark):
    """The query's plan reads stored digests; it made one for every row of every feed."""
    plan = load_all()["feed_with_payload"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "text#" not in plan


# --- tails --------------------------------------------------------------------------------------------
def test_tails_of_bounded_logs(spark):
    draw = random.Random(3)
    log = [(draw.choice([1, 2, 3, None]), f"{draw.randrange(50)}-{draw.randrange(12)}") for _ in range(200)] + [(2, "bad"), (2, None)]
    d = spark.createDataFrame(log, "uid long, entry_id string")
    c = spark.createDataFrame([(1, "20-3"), (2, "0-0"), (None, "1-1")], "uid long, cursor string")
    plain = sorted(map(tuple, FD.tail_after_cursor(d, c, ["uid"]).collect()))
    assert sorted(map(tuple, FD.tail_after_cursor(d, c, ["uid"], bounded=True).collect())) == plain and len(plain) > 60


def test_user_tails_write_no_ranges(spark):
    scratch = Path(checkpoint_dir(spark).removeprefix("file:")) / "feedspark-scratch"
    before = set(scratch.glob("ranges-*"))
    load_all()["user_tail_after_cursor"].build(spark, SF).count()
    assert set(scratch.glob("ranges-*")) == before


# --- first rows ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 3, 40, 49, 50, 51, 500])
def test_first_rows_with_equal_and_null_keys(spark, n):
    keys = [None] * 3 + [5] * 10 + list(range(6, 43))
    random.Random(n).shuffle(keys)
    df = spark.createDataFrame([(k, f"x{i}") for i, k in enumerate(keys)], "k int, text string").repartition(5)
    got = A.first_rows(df, "k", n).collect()
    assert [r.k for r in got] == sorted(keys, key=lambda k: (k is not None, k))[:n]
    assert len({r.text for r in got}) == len(got)


def test_first_n_moves_no_bodies_to_one_task(spark):
    plan = load_all()["first_n"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan
    rows = spark.range(100).select(F.col("id").alias("id_order"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("b").alias("text"))
    out = A.clean_articles(rows, n=10)
    assert "GlobalLimit" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 10
