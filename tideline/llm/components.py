"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.plans.attach import attach
from tideline.plans.scratch import freeze


def _least(links: DataFrame) -> DataFrame:
    """For each ``a`` the least node among itself and its neighbours; combines before the shuffle."""
    return links.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")


def _star(links: DataFrame) -> DataFrame:
    """Join every link to the least neighbour of its ``a``; a node with very many links is spread."""
    links = freeze(links, "links")
    return attach(links, _least(links), ["a"], row_bytes=32)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (``a``, ``b``; equal types): the least node it reaches.

    A round hangs the larger neighbours of each node, then the smaller ones, on its least neighbour
    (large star, small star); it needs about log² of the longest chain in rounds and never holds a
    component in one task. Each round is written to the shared folder.
    """
    same = F.col("a") != F.col("b")
    links = freeze(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(same).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        large = _star(_both_ways(links)).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(same)
        # Every a is now above its b, so these are the smaller neighbours.
        small = _star(large.distinct())
        own = small.select("a", F.col("m").alias("b"))
        others = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = freeze(own.union(others).where(same).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())
