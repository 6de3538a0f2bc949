"""Message view columns.

All are built-in expressions over whole tables; no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (AGE_HOURS_LIMIT, AGE_MINUTES_LIMIT, AGE_SECONDS_LIMIT,
                         MAX_READER_RPS, NO_TITLE, POP_RATE)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truthy(c: Column) -> Column:
    """JavaScript truthiness of a string: not null and not empty."""
    return c.isNotNull() & (c != "")


def normalize_message(df: DataFrame, stable_id_from: str = "entry_id") -> DataFrame:
    """UI message normalisation with ``??`` (null-only) fallbacks.

    A missing id gets a stable hash of the entry id instead of a random uuid,
    so re-runs give the same ids.
    """
    topic = F.col("topic")
    return df.select(
        F.coalesce(F.col("id"), F.md5(F.col(stable_id_from))).alias("id"),
        F.coalesce(F.col("title"), F.col("text"), F.lit(NO_TITLE)).alias("title"),
        F.coalesce(F.col("summary"), F.col("body"), F.col("text")).alias("summary"),
        F.col("body").alias("body"),
        F.coalesce(F.col("tags"), F.when(_truthy(topic), F.array(topic))
                   .otherwise(F.array().cast("array<string>"))).alias("tags"),
        topic.alias("topic"),
        *[c for c in df.columns if c in (stable_id_from,)],
    )


def drop_falsy(arr) -> Column:
    """C4: remove NULL and empty values of an array."""
    return F.filter(_c(arr), lambda x: x.isNotNull() & (x != ""))


def message_chips(tags="tags", topic="topic") -> Column:
    """Ordered distinct of tags + topic, falsy values removed (first wins)."""
    both = F.concat(F.coalesce(_c(tags), F.array().cast("array<string>")), F.array(_c(topic)))
    return F.array_distinct(drop_falsy(both))


def message_preview(summary="summary", body="body") -> Column:
    """Shown only when summary or body is non-empty; summary unless it is NULL."""
    s, b = _c(summary), _c(body)
    return F.when(_truthy(s) | _truthy(b), F.coalesce(s, b))


def parse_entry_id(entry_id="entry_id") -> Column:
    """Milliseconds of a ``<ms>-<seq>`` log id; NULL when not a number."""
    head = F.split(_c(entry_id), "-").getItem(0)
    return head.try_cast("bigint")


def entry_seq(entry_id="entry_id") -> Column:
    """Sequence part of a ``<ms>-<seq>`` id (0 when absent)."""
    c = F.col(entry_id) if isinstance(entry_id, str) else entry_id
    return F.coalesce(F.get(F.split(c, "-"), F.lit(1)).try_cast("bigint"), F.lit(0))


def log_order(cols) -> list[Column]:
    """Ordering columns of a log: an ``entry_id`` counts by its sequence number, then as text
    (``...-9`` before ``...-10``); the time column before it holds the millisecond part."""
    out: list[Column] = []
    for c in cols:
        if isinstance(c, str) and c.endswith("entry_id"):
            out.append(entry_seq(c))
        out.append(F.col(c) if isinstance(c, str) else c)
    return out


def relative_age(entry_id="entry_id", now: str | Column = "2024-01-20 00:00:00") -> Column:
    """B12: '<n> s ago' / '<n> m ago' / '<n> h ago' / 'dd Mon', '' for a bad id.

    ``now`` is a parameter (a UTC wall-clock literal or a timestamp column) so
    results repeat; integer parts are truncated toward zero.
    """
    ms = parse_entry_id(entry_id)
    now_ts = now.cast("timestamp") if isinstance(now, Column) else F.to_timestamp(F.lit(now))
    delta = (F.unix_micros(now_ts) - ms * 1000) / 1e6
    trunc = lambda x: x.cast("bigint").cast("string")  # noqa: E731 - cast truncates toward zero
    return (
        F.when(ms.isNull(), F.lit(""))
        .when(delta < AGE_SECONDS_LIMIT, F.concat(trunc(delta), F.lit(" s ago")))
        .when(delta < AGE_MINUTES_LIMIT, F.concat(trunc(delta / 60), F.lit(" m ago")))
        .when(delta < AGE_HOURS_LIMIT, F.concat(trunc(delta / 3600), F.lit(" h ago")))
        .otherwise(F.date_format(F.timestamp_millis(ms), "dd MMM"))
    )


def route_channel(channel="channel") -> tuple[Column, Column]:
    """(mode, key): ``topic:`` = cursor read, ``feed:`` = consuming read, else 'invalid'."""
    ch = _c(channel)
    mode = (F.when(ch.startswith("topic:"), F.lit("cursor"))
            .when(ch.startswith("feed:"), F.lit("consume")).otherwise(F.lit("invalid")))
    key = (F.when(ch.startswith("topic:"), F.substring(ch, 7, 1 << 30))
           .when(ch.startswith("feed:"), F.substring(ch, 6, 1 << 30)))
    return mode, key


def target_rps(latest_uid="latest_uid", fixed_rps: float | None = None) -> Column:
    """Fixed rate if > 0, else min(200, max(1, latest_uid * 0.05))."""
    if fixed_rps is not None and fixed_rps > 0:
        return F.lit(float(fixed_rps))
    return F.least(F.lit(MAX_READER_RPS), F.greatest(F.lit(1.0), _c(latest_uid) * POP_RATE))


def resolve_fixed_rps(cli_value: float | None, env_value: str | None) -> float | None:
    """B15 configuration rule: the environment value overrides the CLI value;
    an unparseable environment value clears it."""
    if env_value is None:
        return cli_value
    try:
        return float(env_value)
    except ValueError:
        return None


def unit_scale(value="value") -> dict[str, Column]:
    """Dashboard unit conversions."""
    v = _c(value)
    return {
        "mb": v / 1024 / 1024,      # bytes -> MB
        "kb_per_s": v / 1024,       # bytes/s -> KB/s
        "micros": v * 1e6,          # seconds -> microseconds
        "percent": v * 100,         # ratio -> %
    }
