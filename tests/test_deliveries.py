"""Factorized deliveries, the Bloom filter in front of exact joins, and tables bucketed by user."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from feedspark.catalog import load_all
from feedspark.operators import seen_filter as SF_
from feedspark.operators.deliveries import Deliveries
from feedspark.operators.fan_out import fanout_visible
from feedspark.operators.users import feed_user_context, set_add
from feedspark.sources import articles as A

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def _world(seed):
    draw = random.Random(seed)
    at = lambda: T0 + dt.timedelta(hours=draw.randint(0, 30))
    messages = [(f"{k}-0", at(), draw.choice(["d1", "d2", "", str(k)]), draw.choice("ab" + "c" * 6)) for k in range(60)]
    subs = [(draw.randint(1, 9), draw.choice("abcx"), at()) for _ in range(40)]
    subs += subs[:3]  # a subscription that is there twice delivers twice
    seen = [(draw.randint(1, 9), draw.choice(["d1", "d2", "3", "9", "none"])) for _ in range(25)] + [(1, None)]
    return messages, subs, seen


def _brute(messages, subs, seen):
    pairs = set(seen)
    return sorted((u, e, t, i or e, tp) for e, t, i, tp in messages for u, st, c in subs if st == tp and c <= t and (u, i or e) not in pairs)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factors_equal_the_expanded_deliveries(spark, seed):
    messages, subs, seen = _world(seed)
    m = spark.createDataFrame(messages, "entry_id string, entry_ts timestamp, id string, topic string").repartition(4)
    s = spark.createDataFrame(subs, "uid long, topic string, created_ts timestamp").repartition(3)
    d = Deliveries.of(m, s).unseen(spark.createDataFrame(seen, "uid long, doc_id string"))
    want = _brute(messages, subs, seen)
    assert sorted(map(tuple, d.expand().collect())) == want
    assert {r.entry_id: r.deliveries for r in d.per_message().collect()} == {e: sum(w[1] == e for w in want) for e, *_ in messages}
    assert {r.uid: r.deliveries for r in d.per_user().collect()} == {u: sum(w[0] == u for w in want) for u, *_ in subs}
    since, until = T0 + dt.timedelta(hours=10), T0 + dt.timedelta(hours=20)
    part = d.between(since, until).for_users(spark.createDataFrame([(2,), (5,), (5,)], "uid long"))
    narrowed = [w for w in want if since <= w[2] < until and w[0] in (2, 5)]
    assert sorted(map(tuple, part.expand().collect())) == narrowed
    assert sum(r.deliveries for r in part.per_user().collect()) == len(narrowed)


def test_two_seen_sets_leave_out_their_union(spark):
    messages, subs, seen = _world(4)
    m = spark.createDataFrame(messages, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, topic string, created_ts timestamp")
    sets = [spark.createDataFrame(x, "uid long, doc_id string") for x in (seen[:15], seen[10:])]
    d = Deliveries.of(m, s).unseen(sets[0]).unseen(sets[1])
    want = _brute(messages, subs, seen)
    assert sorted(map(tuple, d.expand().collect())) == want
    assert sum(r.deliveries for r in d.per_message().collect()) == len(want)


def test_counts_build_no_deliveries(spark):
    """At most messages, subscriptions and seen pairs take part; the fan-out's product does not."""
    messages = [(f"{k}-0", T0 + dt.timedelta(seconds=k), str(k), "a") for k in range(400)]
    m = spark.createDataFrame(messages, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.range(300).select(F.col("id").alias("uid"), F.lit("a").alias("topic"), F.lit(T0).alias("created_ts"))
    d = Deliveries.of(m, s).unseen(spark.createDataFrame([(1, "5")], "uid long, doc_id string"))
    counts = {r.uid: r.deliveries for r in d.per_user().collect()}
    assert counts == {u: 400 - (u == 1) for u in range(300)}
    assert d.skipped.count() == 1


def test_salts_follow_the_messages(spark, monkeypatch):
    from feedspark.operators import fan_out

    monkeypatch.setattr(fan_out, "ROWS_PER_SALT", 7)
    messages, subs, _ = _world(5)
    m = spark.createDataFrame(messages, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, topic string, created_ts timestamp")
    out = fanout_visible(m, s, max_rows=10)
    assert sorted(map(tuple, out.collect())) == _brute(messages, subs, [])
    assert "salt" in out._jdf.queryExecution().optimizedPlan().toString()


# ---- Bloom filter ----


def test_filter_passes_every_member_and_few_others(spark):
    keys = spark.range(20_000).select(F.col("id").alias("uid"), F.concat(F.lit("d"), F.col("id") % 97).alias("doc"))
    others = keys.select((F.col("uid") + 1_000_000).alias("uid"), "doc")
    blocks = SF_.blocks_for(20_000)
    f = SF_.seen_filter(keys.repartition(5), ["uid", "doc"], blocks)
    assert SF_.maybe_seen(keys, ["uid", "doc"], f, blocks).count() == 20_000
    assert SF_.maybe_seen(others, ["uid", "doc"], f, blocks).count() < 0.05 * 20_000


def test_merged_filters_equal_the_filter_of_all(spark):
    keys = spark.range(3000).select(F.col("id").alias("k"))
    parts = [SF_.seen_filter(keys.where(F.col("k") % 3 == i), ["k"], 4) for i in range(3)]
    together = SF_.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    rows = lambda f: sorted((r.block, bytes(r.bits)) for r in f.collect())
    assert rows(together) == rows(SF_.seen_filter(keys, ["k"], 4))


@pytest.mark.parametrize("bits_per_key", [10, 0])
def test_exact_behind_a_filter_that_lets_others_pass(spark, monkeypatch, bits_per_key):
    """With no bits per key a single block holds far too many keys: nearly all others pass, and the result is the same."""
    existing = spark.range(30_000).select((F.col("id") * 2).alias("k"))
    batch = spark.range(20_000).select((F.col("id") * 3).alias("k"))
    passed = SF_.only_maybe_in(existing, batch, ["k"], bits_per_key=bits_per_key).count()
    if bits_per_key:
        assert passed < 10_000 + 0.1 * 20_000  # 10,000 members in common
    else:
        assert passed > 20_000  # more than half of the 20,000 others
    from feedspark.operators import users

    monkeypatch.setattr(users, "only_maybe_in", lambda a, b, k: SF_.only_maybe_in(a, b, k, bits_per_key=bits_per_key))
    assert {r.k for r in set_add(existing, batch, ["k"]).collect()} == {3 * i for i in range(20_000) if 3 * i % 2 or 3 * i >= 60_000}


def test_a_filter_that_would_be_too_large_is_not_built(spark, monkeypatch):
    monkeypatch.setattr(SF_, "MAX_BYTES", 4096)
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert SF_.only_maybe_in(rows, spark.range(100_000).select(F.col("id").alias("k")), ["k"]) is rows


def test_null_and_empty_keys(spark):
    rows = spark.createDataFrame([(None, "a"), (1, None), (None, None), (2, "b")], "uid long, doc string")
    assert SF_.only_maybe_in(rows, rows, ["uid", "doc"]).count() == 4
    assert SF_.only_maybe_in(rows, rows.limit(0), ["uid", "doc"]).count() == 0


# ---- tables by user ----


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_bucketed_feed_meets_users_without_moving(spark):
    feed, users = (f"t_{uuid.uuid4().hex[:8]}" for _ in range(2))
    rows = spark.range(500).select((F.col("id") % 50).alias("uid"), F.col("id").cast("string").alias("entry_id"), (F.col("id") / 50).cast("int").alias("pos"))
    A.sink_user_feed(rows, feed, buckets=8)
    A.index_users(spark.range(40).select(F.col("id").alias("uid"), F.array(F.lit("a")).alias("interests")), users, buckets=8)
    joined = feed_user_context(spark.table(feed), spark.table(users))
    assert "Exchange" not in _plan(spark, joined)
    assert joined.count() == 500 and joined.where("interests IS NULL").count() == 100
    one = A.read_user(spark, feed, 7)
    assert "SelectedBucketsCount: 1 out of 8" in _plan(spark, one)
    assert one.count() == 10 and one.select(F.input_file_name()).distinct().count() == 1


def test_feed_files_hold_bloom_filters_of_the_user(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    table = f"t_{uuid.uuid4().hex[:8]}"
    A.sink_user_feed(spark.range(2000).select((F.col("id") * 1_000_003).alias("uid"), F.lit("e").alias("entry_id"), F.lit(1).alias("pos")), table, buckets=2)
    path = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first().data_type.removeprefix("file:")
    files = list(Path(path).glob("*.parquet"))
    assert files
    # the filter lies between the row groups and the footer: the file is larger than its column chunks by more than the footer
    meta = pq.ParquetFile(files[0]).metadata
    chunks = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
    assert files[0].stat().st_size - chunks - meta.serialized_size > 1000


def test_range_of_deliveries(spark):
    lo, hi = load_all()["unseen_in_range"].build(spark, SF).agg(F.min("entry_ts"), F.max("entry_ts")).first()
    assert lo is not None and dt.datetime(2024, 1, 3) <= lo <= hi < dt.datetime(2024, 1, 5)


def test_few_subscriptions_with_many_deliveries_lie_in_many_tasks(spark, monkeypatch):
    from feedspark.operators import fan_out

    messages, subs, _ = _world(6)
    m = spark.createDataFrame(messages, "entry_id string, entry_ts timestamp, id string, topic string")
    s = spark.createDataFrame(subs, "uid long, topic string, created_ts timestamp")
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(fanout_visible(m, s)) == 1
    monkeypatch.setattr(fan_out, "ROWS_PER_TASK", 10)
    out = fanout_visible(m, s)
    assert sorted(map(tuple, out.collect())) == _brute(messages, subs, [])
    assert tasks(out) > 3
    seen = spark.createDataFrame([(subs[0][0], messages[0][2])], "uid long, doc_id string")
    assert tasks(Deliveries.of(m, s).unseen(seen).expand()) > 3
