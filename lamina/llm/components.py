"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _smallest(edges: DataFrame, node: str, other: str, rows: int) -> DataFrame:
    """Written before use, so that the join with it can be split at a hub."""
    return stored(edges.groupBy(F.col(node).alias("u")).agg(F.least(F.min(other), F.first(node)).alias("m")), "hub", rows)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a: with b < a, the b of each star is then its smallest node."""
    roles = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("x").agg(F.sum("child").alias("children"), F.max("root").alias("root")).where("children > 1 OR children = 1 AND root = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach.

    A number of rounds that grows with the logarithm of the longest chain; hubs are pre-aggregated and their joins can
    be split. Edges from a node to itself and repeated ones change nothing; nulls are ignored.
    """
    now = stored(edges.dropna().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", edges.count())
    while not _are_stars(now):
        n = now.count()
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "u", "b": "v"})
        large = both.join(_smallest(both, "u", "v", n), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star", n)
        least = _smallest(large, "u", "v", n)
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = stored(hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges", n)
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
