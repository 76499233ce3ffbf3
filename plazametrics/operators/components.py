"""Connected components of an edge table, by alternating stars.

A turn hangs every neighbour of a vertex on the least one, first for larger neighbours, then for smaller ones. The
number of edges never grows, no vertex's neighbours are ever gathered in one place, and what is left after a few turns
is one star a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _hung(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _hung(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """u, component: every vertex with an edge to another, and the least vertex of its component."""
    a, b = F.col(u), F.col(v)
    now = checkpointed(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        now = checkpointed(_small_star(_large_star(now)))
    found = now.select("u", F.col("v").alias("component"))
    return found.union(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
