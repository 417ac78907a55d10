"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node.

    Each round is written to the shared folder, so a lost executor costs one
    round at most. Nodes that no edge names are not in the result.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "components")
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct(), "components")
        after = _state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return down.union(down.select(F.col("root").alias("node"), "root").distinct())
