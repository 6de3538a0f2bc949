"""Anchored TTL epochs and first-seen de-duplication.

A user's seen set lives 24 h from its *first* add and is then cleared at
once; the next attempt opens a new set. So the epochs of one user are
anchored: anchor_0 = first attempt, anchor_k+1 = first attempt at or after
anchor_k + ttl. Inside an epoch only the first delivery of a document is kept.

The anchor recurrence is sequential, so it runs as a sorted stream: only
``(uid, ts)`` is hash-partitioned by ``uid`` and sorted with Spark's external
sort; ``mapInPandas`` walks each partition in order, carries ``(uid, anchor)``
across Arrow batches and emits one row per anchor. Memory stays at one batch
however many attempts a user has, and the walk jumps epoch to epoch with a
binary search instead of looping over rows. Epochs go back to the attempts
with an equi-join on ``(uid, ttl bucket)``; the de-duplication and the later
top-N are Spark windows on the same ``uid`` partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MICROS_PER_SECOND, SEEN_TTL_SECONDS
from ..functions.messages import log_order
from ..session import scratch_path


#: Users of a block of the timeline walk: 8 bytes per user and topic are held by its task.
BLOCK_USERS = 200_000


def _anchor_walker(ttl_us: int):
    """mapInPandas body: rows sorted by (uid, ts) in, one row per epoch anchor out."""

    def walk(batches):
        cur_uid = None
        cur_anchor = None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            uid = pdf["_uid"].to_numpy()
            ts = pdf["_ts_us"].to_numpy()
            starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]])
            ends = np.r_[starts[1:], n]
            first = ts[starts].copy()
            carried = cur_uid is not None and uid[0] == cur_uid
            if carried:
                first[0] = cur_anchor
            simple = (ts[ends - 1] - first) < ttl_us  # whole segment in one epoch
            emit = simple.copy()
            if carried:
                emit[0] = False  # its anchor was emitted with an earlier batch
            out_u = [uid[starts[emit]]]
            out_a = [first[emit]]
            last_anchor = first.copy()
            for k in np.flatnonzero(~simple):
                s, e = starts[k], ends[k]
                seg = ts[s:e]
                a = first[k]
                found = [] if (k == 0 and carried) else [a]
                j = int(np.searchsorted(seg, a + ttl_us, "left"))
                while j < len(seg):
                    a = seg[j]
                    found.append(a)
                    j = int(np.searchsorted(seg, a + ttl_us, "left"))
                last_anchor[k] = a
                out_u.append(np.full(len(found), uid[s], dtype=np.int64))
                out_a.append(np.asarray(found, dtype=np.int64))
            cur_uid, cur_anchor = uid[-1], last_anchor[-1]
            yield pd.DataFrame({"uid": np.concatenate(out_u).astype(np.int64),
                                "anchor_us": np.concatenate(out_a).astype(np.int64)})

    return walk


def epoch_anchors(attempts: DataFrame, uid_col: str = "uid", ts_col: str = "ts",
                  ttl_seconds: int = SEEN_TTL_SECONDS, carried: DataFrame | None = None) -> DataFrame:
    """(uid, anchor_us): one row per seen-set life, from a sorted walk per uid partition.

    ``carried`` (uid, anchor_us): lives known from earlier; the walk of a user goes on from the last of them, and only
    new lives are returned. An anchor is an attempt itself, so that is the walk over the whole history; attempts
    before a carried anchor cannot open a life any more.
    """
    enc = attempts.select(
        F.col(uid_col).cast("long").alias("_uid"),
        F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_ts_us"),
    )
    if carried is not None:
        known = last_lives(carried.withColumnRenamed(uid_col, "uid")).select("uid", "anchor_us")
        enc = enc.withColumn("_from", F.lit(None).cast("long")).unionByName(
            known.select(F.col("uid").cast("long").alias("_uid"), F.col("anchor_us").alias("_ts_us"), F.col("anchor_us").alias("_from")))
        since = F.max("_from").over(Window.partitionBy("_uid"))
        enc = enc.withColumn("_since", since).where("_since IS NULL OR _ts_us >= _since").select("_uid", "_ts_us", "_since")
        walked = (enc.repartition("_uid").sortWithinPartitions("_uid", "_ts_us").select("_uid", "_ts_us")
                  .mapInPandas(_anchor_walker(int(ttl_seconds) * MICROS_PER_SECOND), "uid long, anchor_us long"))
        return walked.join(known, ["uid", "anchor_us"], "left_anti").withColumnRenamed("uid", uid_col)
    return (
        enc.repartition("_uid")  # dropped by the planner when already partitioned by uid
        .sortWithinPartitions("_uid", "_ts_us")
        .mapInPandas(_anchor_walker(int(ttl_seconds) * MICROS_PER_SECOND),
                     "uid long, anchor_us long")
        .withColumnRenamed("uid", uid_col)
    )


def last_lives(anchors: DataFrame) -> DataFrame:
    """(uid, anchor_us) of each user's last life: all that a later walk has to know of the history."""
    return anchors.groupBy("uid").agg(F.max("anchor_us").alias("anchor_us"))


def lives_in_ranges(spark: SparkSession, edges_us: list[int], walk: Callable[[int, int, DataFrame | None], DataFrame]) -> DataFrame:
    """(uid, anchor_us) of a history taken in time ranges, as a daily job does.

    ``walk(lo, hi, carried)`` returns the new lives of the times in [lo, hi), going on from the last lives ``carried``.
    Each range is written to the shared folder; the next one reads its own times and a row per user, so no task sees
    a user's whole history or all times, and a lost executor costs a range at most. ``edges_us``: rising, at
    least two. Equal to one walk over [first edge, last edge).
    """
    carried, parts = None, []
    for lo, hi in zip(edges_us[:-1], edges_us[1:], strict=True):
        path = scratch_path(spark, "lives")
        walk(lo, hi, carried).select("uid", "anchor_us").write.parquet(path)
        parts.append(spark.read.schema("uid long, anchor_us long").parquet(path))
        last = parts[-1] if carried is None else carried.unionByName(parts[-1])
        kept = scratch_path(spark, "last-lives")
        last_lives(last).write.parquet(kept)
        carried = spark.read.schema("uid long, anchor_us long").parquet(kept)
    return reduce(DataFrame.unionByName, parts)


def time_edges(times: DataFrame, us: Column, ranges: int) -> list[int]:
    """Edges of ``ranges`` equally long ranges over all times; [0, 0] if there are none."""
    lo, hi = times.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return [0, 0]
    return sorted({lo + (hi + 1 - lo) * k // ranges for k in range(ranges + 1)})


def epochs_in_ranges(attempts: DataFrame, ranges: int, uid_col: str = "uid", ts_col: str = "ts",
                     ttl_seconds: int = SEEN_TTL_SECONDS) -> DataFrame:
    """F4 over ``ranges`` time ranges, each going on from the lives before it."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))

    def walk(lo: int, hi: int, carried: DataFrame | None) -> DataFrame:
        part = attempts.where((us >= lo) & (us < hi)).select(F.col(uid_col).alias("uid"), F.col(ts_col).alias("ts"))
        return epoch_anchors(part, "uid", "ts", ttl_seconds, carried)

    e = lives_in_ranges(attempts.sparkSession, time_edges(attempts, us, ranges), walk)
    return e.select(F.col("uid").alias(uid_col), F.timestamp_micros("anchor_us").alias("anchor"))


def timeline_in_ranges(message_times: DataFrame, subs: DataFrame, ranges: int, ttl_seconds: int = SEEN_TTL_SECONDS,
                       block_users: int = BLOCK_USERS, emit_from_us: int | None = None) -> DataFrame:
    """``timeline_anchors`` over ``ranges`` time ranges: a block's task reads the times of one range. With ``emit_from_us``
    only lives from then on are stored, and of older ones each user's last of a range, from which the next goes on."""
    us = F.unix_micros(F.col("entry_ts").cast("timestamp"))

    def walk(lo: int, hi: int, carried: DataFrame | None) -> DataFrame:
        part = message_times.where((us >= lo) & (us < hi))
        return timeline_anchors(part, subs, ttl_seconds, emit_from_us, block_users, carried, newest=emit_from_us is not None)

    return lives_in_ranges(subs.sparkSession, time_edges(message_times, us, ranges), walk)


def _block_walker(ttl_us: int, floor_us: int, newest: bool = False):
    """mapInPandas body. Rows come sorted by block: first when the next life of a user can start, if known (kind -1),
    then its subscriptions (kind 0), then the message times (kind 1) in order. Of a user only the time from which the next life can start is carried along.

    Users whose subscriptions have all begun and who have the same topics and the same next start go on alike: one of them
    walks for all. So the steps are lives x (topic sets x phases), not lives x users. ``newest``: also each user's
    last new life, if that is before ``floor_us``."""
    never = np.iinfo(np.int64).max // 4

    def merged(walkers: np.ndarray, topic_set: np.ndarray, due: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """``walkers`` without those that have the topics and the next start of another one, which walks for them from now on."""
        order = np.lexsort((due[walkers], topic_set[walkers]))
        w = walkers[order]
        first = np.r_[True, (due[w[1:]] != due[w[:-1]]) | (topic_set[w[1:]] != topic_set[w[:-1]])][:w.size]
        if first.all():
            return walkers
        parent[w] = w[np.flatnonzero(first)[np.cumsum(first) - 1]]
        return w[first]

    def walkers_of(parent: np.ndarray) -> np.ndarray:
        """The walker of each user."""
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return up
            parent = up

    def last(state):
        uid, _, _, due, known_due, _, _, parent, _ = state
        end = due[walkers_of(parent)]
        left = (end > known_due) & (end - ttl_us < floor_us)
        return pd.DataFrame({"uid": uid[left], "anchor_us": end[left] - ttl_us})

    def walk(batches):
        block, held, state = None, [], None
        for pdf in batches:
            for _, part in pdf.groupby("block", sort=False):
                if part["block"].iloc[0] != block:
                    if newest and state is not None:
                        yield last(state)
                    block, held, state = part["block"].iloc[0], [], None
                subs, times = part[part["kind"] < 1], part[part["kind"] == 1]
                if len(subs):
                    held.append(subs)
                if not len(times) or not held:
                    continue
                if state is None:
                    all_held = pd.concat(held)
                    users = all_held[all_held["kind"] == 0].groupby(["uid", "topic"])["us"].min().unstack()
                    start = users.fillna(never).to_numpy(dtype=np.int64)
                    due, known = np.full(len(users), -never, dtype=np.int64), all_held[all_held["kind"] == -1]
                    at = users.index.get_indexer(known["uid"])
                    due[at[at >= 0]] = known["us"].to_numpy(dtype=np.int64)[at >= 0]
                    has = start < never
                    _, topic_set = np.unique(np.packbits(has, axis=1), axis=0, return_inverse=True)
                    settled = np.where(has, start, -never).max(axis=1, initial=-never)
                    state = (users.index.to_numpy(dtype=np.int64), {t: k for k, t in enumerate(users.columns)}, start, due,
                             due.copy(), topic_set.reshape(-1), settled, np.arange(len(users)), np.arange(len(users)))
                uid, column, start, due, known_due, topic_set, settled, parent, walkers = state
                ready = due[walkers] >= settled[walkers]
                walkers = np.r_[merged(walkers[ready], topic_set, due, parent), walkers[~ready]]
                lines = [(column[t], g["us"].to_numpy(dtype=np.int64)) for t, g in times.groupby("topic") if t in column]
                live, of = walkers, None
                while live.size and lines:
                    best = np.full(live.size, never, dtype=np.int64)
                    for k, line in lines:
                        at = np.searchsorted(line, np.maximum(due[live], start[live, k]), "left")
                        best = np.minimum(best, np.where(at < line.size, line[np.minimum(at, line.size - 1)], never))
                    live, best = live[best < never], best[best < never]
                    due[live] = best + ttl_us
                    emit = best >= floor_us
                    if emit.any():
                        of = walkers_of(parent) if of is None else of
                        anchor = np.full(len(uid), never, dtype=np.int64)
                        anchor[live[emit]] = best[emit]
                        anchor = anchor[of]
                        yield pd.DataFrame({"uid": uid[anchor < never], "anchor_us": anchor[anchor < never]})
                    ready = due[live] >= settled[live]
                    one = merged(live[ready], topic_set, due, parent)
                    if one.size < np.count_nonzero(ready):
                        live, of = np.r_[one, live[~ready]], None
                state = (*state[:-1], walkers[parent[walkers] == walkers])
        if newest and state is not None:
            yield last(state)

    return walk


def timeline_anchors(message_times: DataFrame, subs: DataFrame, ttl_seconds: int = SEEN_TTL_SECONDS,
                     emit_from_us: int | None = None, block_users: int = BLOCK_USERS,
                     carried: DataFrame | None = None, newest: bool = False) -> DataFrame:
    """(uid, anchor_us) of the fan-out attempts, computed without the attempts.

    A user's attempt times are the message times of each subscribed topic from that subscription's creation on.
    Users are dealt into blocks; every block gets all distinct (topic, time) rows once, sorted, and walks its users
    along them, batch by batch, with one ``searchsorted`` per topic and life, and one walk for all users that go on alike.
    Rows moved: times x blocks, not
    messages x users; memory: one block of users and one batch of times. ``emit_from_us`` drops older anchors
    from the output (the walk itself always starts at each user's first attempt), with ``newest`` all but each user's last. ``carried`` (uid, anchor_us): lives
    known from earlier; ``message_times`` then need to hold only the times after those that they came from, and only
    new lives are returned.
    """
    n_users = subs.agg(F.approx_count_distinct("uid")).first()[0]
    parallel = subs.sparkSession.sparkContext.defaultParallelism
    blocks = max(n_users // block_users + 1, min(parallel, n_users // 1000 + 1))
    none = F.lit(None).cast("long")
    users = subs.select(F.pmod(F.xxhash64(F.col("uid").cast("long")), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                        F.col("uid").cast("long").alias("uid"), "topic",
                        F.unix_micros(F.col("created_ts").cast("timestamp")).alias("us"))
    ttl_us = int(ttl_seconds) * MICROS_PER_SECOND
    if carried is not None:
        uid = F.col("uid").cast("long")
        users = users.unionByName(last_lives(carried.select(uid.alias("uid"), "anchor_us")).select(
            F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("kind"), "uid",
            F.lit(None).cast("string").alias("topic"), (F.col("anchor_us") + ttl_us).alias("us")))
    times = message_times.select("topic", F.unix_micros(F.col("entry_ts").cast("timestamp")).alias("us")).distinct()
    times = times.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                         none.alias("uid"), "topic", "us")
    floor_us = -(1 << 62) if emit_from_us is None else int(emit_from_us)
    return (users.unionByName(times).repartition("block").sortWithinPartitions("block", "kind", "us")
            .mapInPandas(_block_walker(ttl_us, floor_us, newest), "uid long, anchor_us long"))


def assign_epochs(df: DataFrame, uid_col: str = "uid", ts_col: str = "ts",
                  ttl_seconds: int = SEEN_TTL_SECONDS, epoch_col: str = "epoch",
                  anchors: DataFrame | None = None) -> DataFrame:
    """Add ``epoch`` = anchor time of the seen-set life each row falls in.

    Every attempt lies in exactly one [anchor, anchor + ttl). A life spans at
    most two ttl-wide buckets, so the anchors (a small table: one row per
    user-epoch) are exploded to their buckets and hash-joined on
    ``(uid, bucket)``; the attempts keep their ``uid`` partitioning and are
    neither shuffled nor sorted for it. ``anchors`` (uid, anchor_us) may be given when they
    were computed from a superset of ``df`` (see ``timeline_anchors``).
    """
    ttl_us = int(ttl_seconds) * MICROS_PER_SECOND
    if anchors is None:
        anchors = epoch_anchors(df, uid_col, ts_col, ttl_seconds)
    a = anchors.select(
        F.col(uid_col).alias("_a_uid"), "anchor_us",
        F.explode(F.sequence(F.floor(F.col("anchor_us") / ttl_us),
                             F.floor((F.col("anchor_us") + (ttl_us - 1)) / ttl_us))).alias("_bucket"),
    ).hint("shuffle_hash")  # hash the anchors (one row per user-life and bucket); no sort of the attempts
    ts_us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    d = df.select("*", ts_us.alias("_ts_us"), F.floor(ts_us / ttl_us).alias("_bucket"))
    j = d.join(a, (d[uid_col] == a["_a_uid"]) & (d["_bucket"] == a["_bucket"])
               & (d["_ts_us"] >= a["anchor_us"]) & (d["_ts_us"] < a["anchor_us"] + ttl_us))
    return j.select(*[d[c] for c in df.columns], F.timestamp_micros("anchor_us").alias(epoch_col))


def anchored_ttl_epochs(attempts: DataFrame, uid_col: str = "uid", ts_col: str = "ts",
                        ttl_seconds: int = SEEN_TTL_SECONDS) -> DataFrame:
    """one row per (uid, anchor) seen-set life."""
    e = epoch_anchors(attempts, uid_col, ts_col, ttl_seconds)
    return e.select(uid_col, F.timestamp_micros("anchor_us").alias("anchor"))


def first_seen_dedup(attempts: DataFrame, doc_col: str = "doc", uid_col: str = "uid",
                     ts_col: str = "ts", tiebreak: tuple[str, ...] = ("entry_id",),
                     ttl_seconds: int = SEEN_TTL_SECONDS, anchors: DataFrame | None = None) -> DataFrame:
    """per user, the first delivery of each document inside one seen-set life."""
    e = assign_epochs(attempts, uid_col, ts_col, ttl_seconds, anchors=anchors)
    w = Window.partitionBy(uid_col, "epoch", doc_col).orderBy(*log_order((ts_col, *tiebreak)))
    return e.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_marks(attempts: DataFrame, doc_col: str = "doc", uid_col: str = "uid",
                ts_col: str = "ts", tiebreak: tuple[str, ...] = ("entry_id",),
                ttl_seconds: int = SEEN_TTL_SECONDS) -> DataFrame:
    """Every attempt with ``duplicate`` = it repeats a document inside its epoch."""
    e = assign_epochs(attempts, uid_col, ts_col, ttl_seconds)
    w = Window.partitionBy(uid_col, "epoch", doc_col).orderBy(*log_order((ts_col, *tiebreak)))
    return e.withColumn("duplicate", F.row_number().over(w) > 1)
