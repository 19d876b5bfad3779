"""Connected components by alternating large-star and small-star steps on a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citeloom.session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """node and the smallest of itself and its neighbours; combined before the shuffle, so a hub costs a row per task."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_smallest(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = _smallest(down)
    pairs = down.join(lowest, "a")
    return pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).where("a <> b")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node of ``links`` (a, b).

    Runs until the edges stop changing; the number of rounds grows with the logarithm of
    the longest path. Loops and repeated links are harmless; rows with a null end are ignored.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    state = _digest(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        now = _digest(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
