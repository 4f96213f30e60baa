"""Connected components of an edge table, by alternating large and small stars.

A large-star round links every larger neighbour of a node to the smallest of the
node and its neighbours; a small-star round does the same with the smaller
neighbours. After a number of rounds that grows with the logarithm of the input the
edges are stars around each component's smallest node. Rounds are
aggregations and joins; each result is cut off in the shared checkpoint folder. The smallest
neighbour is a minimum that tasks take before the shuffle. Nodes that hold over a thousandth of the edges, of which there are
two thousand at most, are joined to their edges by broadcast, the others by node; so no node's edges are gathered in one task.
Nodes may be of any type that sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import cut


HUB_SHARE = 1000
LEAST_HUB = 64


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows with their node's low; least: (a, low, n), where n is the number of the node's rows."""
    limit = max(LEAST_HUB, n_edges // HUB_SHARE)
    few, hubs = least.where(F.col("n") <= limit).drop("n"), least.where(F.col("n") > limit).drop("n")
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(few, "a")
    return rest.unionByName(rows.join(F.broadcast(hubs), "a"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(both.where(F.col("b") > F.col("a")), least, n_edges)
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, n_edges).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of each node that has an edge, apart from the roots, which are the smallest of their components; edges: (a, b).

    rows: about how many edges there are, if that is known.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), rows)
    before = _sum_of(edges)
    while before[0]:
        large = cut(_large_star(edges, before[0]), before[0])
        edges = cut(_small_star(large, before[0]), before[0])
        now = _sum_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
