"""Shared helpers of the training-data operators: scratch tables, checked broadcast, word hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: One run of ASCII white space; words are what lies between.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A broadcast side holds at most so many (short, numeric) rows; larger sides are shuffled.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df``, known to hold about ``rows`` short rows, in as many partitions as they need.

    A shuffle has as many partitions as the session says; small tables of an iterative job would pay for empty tasks.
    """
    return df.coalesce(rows // per_task + 1)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to hold at most ``max_rows`` rows, else ``df`` as it is.

    Call it on stored tables of fixed-width rows only: counting runs the plan.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered; the memory is bounded by ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _ODD[0]
    for k in range(1, n):
        out = out + mix(h[k:k + m]) * _ODD[k]
    return mix(out)
