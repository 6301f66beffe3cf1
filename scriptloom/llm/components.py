"""Connected components by alternating large-star and small-star steps over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hub_join, written


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Each node sends its larger (large star) or smaller (small star) neighbours to the least node it knows of.

    The minimum is pre-aggregated before the shuffle, and comes to a hub's edges by broadcast, so they never meet in one
    task. n: number of edges.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        moved = hub_join(edges, least, "a", "n", F.xxhash64("b"), total=2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = hub_join(edges, least, "a", "n", F.xxhash64("b"), total=n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) with a > b; a component is named by its least node.

    Both stars keep a > b. The number of rounds grows with the logarithm of the longest chain.
    """
    edges, mark = written(edges.distinct(), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)  # all are stars now
        mark = state
        larger = written(_star(edges, True, state[0]), "edges")
        edges = written(_star(larger, False, larger.count()), "edges")
