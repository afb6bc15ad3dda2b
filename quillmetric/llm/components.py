"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it. Hubs are joined, never collected."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (around.filter("v > u").join(least, "u")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .filter("a <> b").distinct())


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node that can be reached.

    Two contractions per round, written to the shared folder; the rounds end when a round changes nothing, which
    takes a number of rounds that grows with the logarithm of the longest path. No edges give no rows.
    """
    current = work.table(edges.filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        current = work.table(_small_star(_large_star(current)), "edges")
    # stable stars: every node but the root is linked to its root
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
