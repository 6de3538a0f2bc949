"""Streaming = batch, also across a restart from the checkpoint."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedspark.operators.dedup import first_seen_dedup
from feedspark.operators.retention import feed_top_n
from feedspark.plans.feed import user_feed
from feedspark.session import scratch_path
from feedspark.sources import fixtures as fx
from feedspark.sources.tables import Tables
from feedspark.streaming import jobs as J
from feedspark.streaming import seen_sets as S

SF = "/root/testdata/sf0.001"


ATTEMPTS = "uid long, ts timestamp, seq long, entry_id string, doc string"


def _attempts(t):
    return fx.attempts(t).select("uid", "ts", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("entry_id"),
                                 F.col("doc_id").alias("doc"))


@pytest.mark.parametrize("splits", [1, 3, 5])
def test_dedup_state_is_the_batch_result_over_any_splits_and_restarts(spark, splits):
    t = Tables(spark, SF)
    a = _attempts(t).withColumn("uid", F.col("uid") % 4)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    # every range is a run of its own: the state comes back from the checkpoint
    J.in_time_order(a, "ts", src, splits, lambda: J.stream_dedup_feed(J.file_stream(spark, src, a.schema), sink, ckpt, cap=100, state_partitions=3))
    changes = spark.read.parquet(sink)
    got = {(r.uid, r.entry_id, r.epoch) for r in S.kept_deliveries(changes).collect()}
    batch = first_seen_dedup(a, "doc", "uid", "ts", ("seq",))
    assert got == {(r.uid, r.entry_id, r.epoch) for r in batch.collect()}
    top = feed_top_n(batch.select("uid", "entry_id", "doc", "ts", "seq"), 100, ("ts", "seq"))
    assert {(r.uid, r.entry_id, r.pos) for r in S.feeds(changes).collect()} == {(r.uid, r.entry_id, r.pos) for r in top.collect()}
    assert max(r["count"] for r in S.feeds(changes).groupBy("uid").count().collect()) == 100  # the cap is reached
    # what left the feeds is written once, and nothing that stayed is written again
    assert changes.groupBy("kind", "uid", "entry_id").count().where("count > 1").isEmpty()


def _day(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_lives_late_arrivals_and_the_cap(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("lsrc", "lsink", "lck"))

    def arrive(*rows):
        spark.createDataFrame([(7, _day(h), k, f"e{k}", doc) for h, k, doc in rows], ATTEMPTS).write.mode("append").parquet(src)
        stream = J.file_stream(spark, src, ATTEMPTS)
        J.stream_dedup_feed(stream, sink, ckpt, cap=3, lateness="48 hours", state_partitions=2)
        changes = spark.read.parquet(sink)
        return ({(r.entry_id, r.epoch) for r in S.kept_deliveries(changes).collect()},
                [r.entry_id for r in S.feeds(changes).orderBy("pos").collect()])

    kept, _ = arrive((0, 1, "A"), (1, 2, "B"))
    assert kept == {("e1", _day(0)), ("e2", _day(0))}
    # A again in the life: a duplicate; C comes late, before the anchor: kept in the life; at exactly 24 h a new life
    kept, feed = arrive((2, 3, "A"), (-1, 4, "C"), (24, 5, "A"), (24, 6, "A"))
    assert kept == {("e1", _day(0)), ("e2", _day(0)), ("e4", _day(0)), ("e5", _day(24))}
    assert feed == ["e5", "e2", "e1"]
    # older than all of the full feed: kept, but it falls out at once
    kept, feed = arrive((-2, 9, "D"))
    assert ("e9", _day(24)) in kept and feed == ["e5", "e2", "e1"]


def test_state_of_silent_users_goes(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("ssrc", "ssink", "sck"))

    def arrive(*rows):
        spark.createDataFrame([(u, _day(h), k, f"e{k}", doc) for u, h, k, doc in rows], ATTEMPTS).write.mode("append").parquet(src)
        J.stream_dedup_feed(J.file_stream(spark, src, ATTEMPTS), sink, ckpt, lateness="1 hour", state_partitions=2)
        return {r.uid: r.n for r in S.state_rows(spark, ckpt, "seen").groupBy(F.col("key.uid").alias("uid")).agg(
            F.count("*").alias("n")).collect()}

    assert arrive((1, 0, 1, "A"), (1, 1, 2, "B"), (2, 10, 3, "A")) == {1: 2, 2: 1}
    # user 1 says nothing more: the life that began at hour 0 is over once the stream has passed hour 24 (and the lateness)
    assert arrive((3, 24.5, 4, "A")) == {1: 2, 2: 1, 3: 1}
    assert arrive((3, 26, 5, "B")) == {2: 1, 3: 2}
    lives = S.state_rows(spark, ckpt, "life").where("value.anchor_us is not null")
    assert {r.uid for r in lives.select("key.uid").collect()} == {2, 3}
    # what comes back after its life is kept again; the feed has outlived the seen set
    assert arrive((1, 30, 6, "A")) == {1: 1, 2: 1, 3: 2}
    assert [r.entry_id for r in S.feeds(spark.read.parquet(sink)).where("uid = 1").orderBy("pos").collect()] == ["e6", "e2", "e1"]


def test_neighbouring_users_share_a_state_group_and_keep_lives_of_their_own(spark):
    """A group of the state costs as much as a thousand rows, so a batch of many users must not have one for each."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("bsrc", "bsink", "bck"))
    far = [2**62 + 64 * k for k in range(3)]  # ids that a double cannot tell apart
    rows = [(u, _day(7 * k + u % 5), 100 * k + u % 64, f"e{k}-{u}", "ABC"[k * k % 3]) for u in (*range(64), *far) for k in range(9)]
    a = spark.createDataFrame(rows, ATTEMPTS)
    J.in_time_order(a, "ts", src, 3, lambda: J.stream_dedup_feed(J.file_stream(spark, src, a.schema), sink, ckpt, cap=4, state_partitions=2))
    assert spark.read.format("statestore").load(ckpt).count() == 64 // 16 + 3
    changes = spark.read.parquet(sink)
    batch = first_seen_dedup(a, "doc", "uid", "ts", ("seq",))
    assert {(r.uid, r.entry_id, r.epoch) for r in S.kept_deliveries(changes).collect()} == {(r.uid, r.entry_id, r.epoch) for r in batch.collect()}
    top = feed_top_n(batch.select("uid", "entry_id", "doc", "ts", "seq"), 4, ("ts", "seq"))
    assert {(r.uid, r.entry_id, r.pos) for r in S.feeds(changes).collect()} == {(r.uid, r.entry_id, r.pos) for r in top.collect()}
    assert S.state_rows(spark, ckpt, "feed").groupBy("key.uid").count().where("count != 4").isEmpty()


class _State:
    """A group's state as the step sees it."""

    def __init__(self, watermark_ms=0):
        self.value, self.watermark_ms, self.timeout, self.hasTimedOut = None, watermark_ms, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark_ms

    def update(self, value):
        self.value = tuple(list(x) for x in value)

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def _steps(batches, ttl_us, cap):
    """Changes and state after every batch, in one order."""
    step, state, out = S.seen_sets(ttl_us, cap), _State(), []
    for k, frames in enumerate(batches):
        state.watermark_ms = k * 20
        got = [(*row[:6], row[6] if row[0] == "kept" else None) for f in step((1,), iter(frames), state) for packed in f.itertuples(index=False)
               for row in zip(*packed, strict=True)]
        v = state.value
        out.append((sorted(got, key=repr), *(sorted(zip(*v[a:b]), key=repr) for a, b in ((0, 2), (2, 4), (4, 9))), state.timeout))
    return out


def test_rows_as_columns_are_worked_off_as_one_by_one(monkeypatch):
    draw = random.Random(11)
    names = ["uid", "ts_us", "seq", "entry_id", "doc"]
    for _ in range(60):
        batches, now = [], 0
        for _ in range(4):
            rows = []
            for _ in range(draw.choice([1, 40, 200])):
                now += draw.choice([0, 0, 1, 400])
                late = draw.choice([0, 0, 0, 3000])
                rows.append((draw.randrange(4), now - late, draw.randrange(2), f"e{draw.randrange(30)}", f"d{draw.randrange(6)}"))
            cut = draw.randrange(len(rows) + 1)
            batches.append([pd.DataFrame(part, columns=names) for part in (rows[:cut], rows[cut:])])
        ttl, cap = draw.choice([(1500, 3), (10_000, 5), (5000, 1000)])
        found = []
        for least in (10 ** 9, 1):
            monkeypatch.setattr(S, "COLUMN_ROWS", least)
            found.append(_steps(batches, ttl, cap))
        assert found[0] == found[1]


def test_rows_with_a_null_are_worked_off_one_by_one(monkeypatch):
    frame = pd.DataFrame([(None, 5 * k, 1, f"e{k}", "d") for k in range(100)], columns=["uid", "ts_us", "seq", "entry_id", "doc"])
    assert S._columns([frame]) is None and S._columns([frame.assign(uid=1)]) is not None
    assert S._columns([frame.assign(uid=1, doc=[None] * 50 + ["d"] * 50)]) is None
    (changes, lives, seen, feed, _), = _steps([[frame.assign(uid=1, doc=[None] * 50 + ["d"] * 50)]], 10 ** 6, 5)
    assert [c[:6] for c in changes] == [("kept", 1, 0, 1, "e0", None), ("kept", 1, 250, 1, "e50", "d")] and lives == [(1, 0)]


def test_many_rows_of_a_block_cost_little_each(monkeypatch):
    frame = pd.DataFrame([(k % 16, 1000 * k, k, f"e{k}", f"d{k}") for k in range(5000)], columns=["uid", "ts_us", "seq", "entry_id", "doc"])
    monkeypatch.setattr(S, "_values", lambda column: pytest.fail("row by row"))
    (changes, *_), = _steps([[frame]], 10 ** 9, 100)
    assert len(changes) == 5000 + 5000 - 1600
    frames = list(S.seen_sets(10 ** 9, 100)((1,), iter([frame]), _State()))
    assert sum(map(len, frames)) < 8400 / 20  # rows for the engine, which pads each with a row of state


def test_connected_streams_survive_failures_and_equal_the_batch_feed(spark, monkeypatch):
    t = Tables(spark, SF)
    raw = fx.articles(t).select("entry_id", "entry_ts", "id", "title", "topic")
    src, subs, folder = (scratch_path(spark, n) for n in ("praw", "psubs", "pipe"))
    fx.subscriptions(t).write.parquet(subs)
    pipe = J.FeedPipeline(spark, folder, src, raw.schema, subs, lambda batch: batch, state_partitions=3)
    plain, rounds = J.idempotent_batch_writer, []

    def failing(sink, transform, partition_by=()):
        write = plain(sink, transform, partition_by)

        def run(batch, batch_id):
            write(batch, batch_id)
            raise RuntimeError("lost after the write, before the commit")

        return run

    def arrive():
        if len(rounds) == 1:  # each stage dies once between its write and its commit; the one behind it goes on
            monkeypatch.setattr(J, "idempotent_batch_writer", failing)
            for stage in (pipe.enrich, pipe.fan_out):
                with pytest.raises(Exception, match="lost after the write|foreachBatch"):
                    stage()
            pipe.dedup()
            monkeypatch.setattr(J, "idempotent_batch_writer", plain)
        rounds.append(1)
        pipe.run()

    J.in_time_order(raw, "entry_ts", src, 3, arrive)
    got = {(r.uid, r.entry_id, r.doc, r.pos) for r in pipe.feed().collect()}
    want = user_feed(fx.articles(t), fx.subscriptions(t), n=100)
    assert got == {(r.uid, r.entry_id, r.doc, r.pos) for r in want.select("uid", "entry_id", "doc", "pos").collect()}


def test_a_batch_that_did_not_finish_is_not_seen(spark):
    sink = scratch_path(spark, "half")
    spark.range(3).write.parquet(f"{sink}/_staging/0")  # left by a writer that died
    write = J.idempotent_batch_writer(sink, lambda b: b)
    write(spark.range(5), 0)
    assert spark.read.parquet(sink).count() == 5
    write(spark.range(7), 0)  # a replay of a committed batch
    assert spark.read.parquet(sink).count() == 5


def test_fanout_sees_subscribers_added_between_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    src, subs, sink, ckpt = (scratch_path(spark, n) for n in ("tl", "subs", "att", "ck"))
    msgs = spark.createDataFrame([("1-0", t0, "1", "politics")], "entry_id string, entry_ts timestamp, id string, topic string")
    msgs.write.parquet(src)
    spark.createDataFrame([(1, t0, "politics")], "uid long, created_ts timestamp, topic string").write.parquet(subs)
    schema = msgs.schema
    J.stream_fanout(spark, src, schema, subs, sink, ckpt)
    spark.createDataFrame([(2, t0, "politics")], "uid long, created_ts timestamp, topic string") \
        .write.mode("append").parquet(subs)
    spark.createDataFrame([("2-0", t0 + dt.timedelta(hours=1), "2", "politics")], schema).write.mode("append").parquet(src)
    J.stream_fanout(spark, src, schema, subs, sink, ckpt)
    got = {(r.uid, r.entry_id) for r in spark.read.parquet(sink).collect()}
    assert got == {(1, "1-0"), (1, "2-0"), (2, "2-0")}


def test_source_keeps_rows_without_a_time_in_any_zone(spark, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        df = spark.range(20).select("id", F.when(F.col("id") > 0, F.timestamp_micros(F.col("id") * 3_600_000_000).cast("timestamp_ntz")).alias("ts"))
        src, seen = scratch_path(spark, "zones"), []
        J.in_time_order(df, "ts", src, 4, lambda: seen.append(spark.read.schema(df.schema).parquet(src).count()))
        assert seen[-1] == 20 and seen == sorted(set(seen))
        assert sorted(r.id for r in spark.read.parquet(src).collect()) == list(range(20))
    finally:
        monkeypatch.undo()
        time.tzset()


def test_backlog_counts_every_batch(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("bsrc", "bsink", "bck"))
    rows = spark.range(12)
    rows.repartition(12).write.parquet(src)
    J.stream_articles(spark, src, rows.schema, sink, ckpt, files_per_trigger=1)
    got = J.stream_backlog(spark.read.parquet(sink), spark.read.parquet(src)).orderBy("batch_id").collect()
    assert sum(r.input_rows for r in got) == 12 and got[-1].backlog == 0 and len(got) > 3
    long = J.stream_backlog(spark.range(150).withColumnRenamed("id", "batch_id"), spark.range(150))
    assert [r.backlog for r in long.orderBy("batch_id").collect()] == list(range(149, -1, -1))


def test_topic_counts_take_late_files(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("late", "latesink", "lateck"))
    for day in (20, 25, 3):
        df = spark.createDataFrame([(dt.datetime(2024, 1, day, 5), "politics")] * 5, "entry_ts timestamp, topic string")
        df.write.mode("append").parquet(src)
        J.stream_topic_counts(spark, src, df.schema, sink, ckpt)
    assert sorted((r.window_start.day, r.n) for r in J.latest_counts(spark, sink).collect()) == [(3, 5), (20, 5), (25, 5)]


def _log(spark, path, rows):
    spark.createDataFrame(rows, "entry_id string, entry_ts timestamp, topic string, body string").write.partitionBy("topic").parquet(path)


def _held(spark, path):
    out = {}
    for r in spark.read.parquet(path).collect():
        out.setdefault(r["topic"], []).append(r.entry_id)
    return {k: sorted(v, key=lambda x: int(x.split("-")[0])) for k, v in out.items()}


def test_retention_keeps_unread_entries(spark):
    log = scratch_path(spark, "rlog")
    _log(spark, log, [(f"{k}-0", _day(k), tp, "b") for tp in ("sports", "health", "science") for k in range(10)])
    cursors = spark.createDataFrame([("sports", _day(5)), ("science", _day(20))], "topic string, cursor_ts timestamp")
    assert sorted(J.retention_job(spark, log, 2, cursors=cursors)) == ["science", "sports"]
    got = _held(spark, log)  # 6..9 unread; nobody read health; science is read to its end
    assert got == {"sports": ["6-0", "7-0", "8-0", "9-0"], "health": [f"{k}-0" for k in range(10)], "science": ["8-0", "9-0"]}
    with pytest.raises(ValueError):
        J.retention_job(spark, log, 2)


def test_retention_rewrites_only_topics_that_lose_and_keeps_equal_rows(spark):
    from pathlib import Path

    log = scratch_path(spark, "eqlog")
    _log(spark, log, [("1-0", _day(1), "sports", "b")] * 3 + [("2-0", _day(2), "sports", "b")] * 2
         + [(f"{k}-0", _day(k), "health", "b") for k in range(4)])
    files = lambda tp: {p.name for p in Path(log.removeprefix("file:")).glob(f"topic={tp}/*.parquet")}
    before = files("sports")
    assert J.retention_job(spark, log, 3, keep_unread=False) == ["health"]
    assert files("sports") == before
    # of the newest three sports rows one is a 1-0; its equals stay with it
    assert _held(spark, log) == {"sports": ["1-0"] * 3 + ["2-0"] * 2, "health": ["1-0", "2-0", "3-0"]}
    assert J.retention_job(spark, log, 3, keep_unread=False) == []  # nothing left to do


def test_feed_state_has_every_user(spark, tmp_path):
    """stream_feed_state keeps a feed for each user of the events, however many there are."""
    import duckdb

    from feedspark.catalog import load_all

    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k), k % 70, "view", 1.0, f'{{"k": {k % 11}}}') for k in range(350)]
    path = str(tmp_path / "events.parquet")
    (spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
     .coalesce(1).write.parquet(path))
    entry = load_all()["stream_feed_state"]
    got = sorted(map(tuple, entry.build(spark, str(tmp_path)).select("uid", "event_id", "doc_id", "pos").collect()))
    assert {r[0] for r in got} == set(range(70))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(f"SELECT uid, event_id, doc_id, pos FROM ({entry.oracle}) q").fetchall())
