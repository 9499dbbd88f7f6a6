"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, with_least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = with_least(both, "u", "v", "m", 2 * n).filter("v > u")
    return moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = with_least(down, "u", "v", "m", n)
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being the smallest node reachable.

    Self-edges and repeated edges are allowed and change nothing; rows with a null end are ignored; nodes
    without an edge to another node get no row. Each round is written to the shared folder, so a lost executor
    costs one round; rounds grow with the logarithm of the longest path. Minima are combined before the shuffle,
    and a hub's edges stay where they are: its minimum is broadcast to them.
    """
    now = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    n, seen = now.count(), None
    while True:
        star = materialize(_large_star(now, n))
        new = materialize(_small_star(star, n))
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        discard(star)
        if mark == seen:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, n, seen = new, mark[0], mark
