"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.lineage import cut
from coppice.plans.skew import HOT, join_hot


def _least(edges: DataFrame) -> DataFrame:
    """(a, m, n): each node's least neighbour and its number of edges."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _join(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """`edges` with their node's `m`."""
    one = least.select("a", "m")
    return join_hot(edges, one, "a", least.where(F.col("n") > HOT).select("a")) if hubs else edges.join(one, "a")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("a", "m"))
    return _join(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    least = _least(edges)
    moved = _join(edges, least, hubs).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a long, b long) to (node long, root long), root being the smallest node reachable.

    Nodes without an edge to another node are left out.  Each round takes a few shuffles of the edges; the number of
    rounds grows with the logarithm of the longest chain.  Minima are combined before they are moved, and the joins deal
    a hub's edges to several tasks, so no task gets all of them.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while True:
        hubs = before[0] > HOT  # only so many edges can hold a hub
        large = _large_star(edges, hubs)
        edges = cut(_small_star(cut(large) if hubs else large, hubs))
        now = mark(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
