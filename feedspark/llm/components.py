"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import sized, stored


def _print(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest id reachable, for every node with an edge to another.

    Loops, repeated edges and rows with NULL are ignored. Every step replaces the edges by at most as many;
    a node with a third of all edges is summed map-side and its join is split by the skew-join rule.
    """
    ordered = (edges.filter(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    current, before = stored(ordered, "edges"), None
    while (now := _print(current)) != before:
        before = now
        n = now[0]
        both = sized(current.union(current.select("lo", "hi")).toDF("u", "v"), 2 * n)
        least = sized(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), n)
        large = sized(both.join(least, "u"), 2 * n).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stored(sized(large.distinct(), n), "edges")
        lowest = sized(large.groupBy("hi").agg(F.min("lo").alias("m")), n)
        linked = sized(large.join(lowest, "hi"), n)
        small = (linked.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(lowest.select("hi", F.col("m").alias("lo"))))
        current = stored(sized(small.distinct(), n), "edges")
    return current.groupBy("hi").agg(F.min("lo").alias("component")).select(
        F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("component")))).alias("x")).select("x.*").union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
