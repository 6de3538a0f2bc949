"""Registry of the named queries: a Spark builder and a DuckDB oracle for each.

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
base tables of that folder. ``oracle`` is the equivalent DuckDB SQL over the
same tables, or None where only a row-count check applies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.tables import Tables


@dataclass
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: ``fn(t: Tables) -> DataFrame`` becomes query ``key``."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(Tables(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key!r}")
        REGISTRY[key] = Entry(key, build, oracle)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    from . import aggregates, core, metrics, ordered, projections, sources, streams  # noqa: F401

    return REGISTRY
