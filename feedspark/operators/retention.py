"""Keep-last-N retention.

Per-key top-N is ``row_number() <= n``; Catalyst turns it into a
``WindowGroupLimit`` that also runs before the shuffle, so each map task
sends at most ``n`` rows per key. The global variant uses ``orderBy().limit``
(TakeOrderedAndProject), never a window without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FEED_CAP, RAW_LOG_CAP
from ..functions.messages import log_order


def _desc(cols) -> list[Column]:
    return [c.desc() for c in log_order(cols)]


def keep_last(log: DataFrame, n: int, keys, order=("entry_ts", "entry_id"),
              pos_col: str = "pos") -> DataFrame:
    """Newest ``n`` rows per key; ``pos`` 1 = newest."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    kept = log.withColumn(pos_col, F.row_number().over(w)).where(F.col(pos_col) <= n)
    return kept.withColumn(pos_col, F.col(pos_col).cast("bigint"))  # after the filter: keeps WindowGroupLimit


def feed_top_n(deliveries: DataFrame, n: int = FEED_CAP, order=("ts", "entry_id")) -> DataFrame:
    """newest ``n`` accepted deliveries per user, ``pos`` 1 = newest."""
    return keep_last(deliveries, n, ["uid"], order)


def retain_last_per_topic(log: DataFrame, n: int, order=("entry_ts", "entry_id")) -> DataFrame:
    """exact keep-last-N of each topic log."""
    return keep_last(log, n, ["topic"], order)


def retain_last_global(log: DataFrame, n: int = RAW_LOG_CAP,
                       order=("entry_ts", "entry_id")) -> DataFrame:
    """Newest ``n`` entries overall, read or not."""
    return log.orderBy(*_desc(order)).limit(n)
