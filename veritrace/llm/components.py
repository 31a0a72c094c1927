"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if it is the lower end of another: then all components are found."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.where("down + up > 1 and down > 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """Union-find by alternating star contractions (large-star, small-star).

    edges: columns u, v (long). Returns (node, root) for every node of an edge but the roots
    themselves; a root is the least node of its component. Loops, repeated edges and
    nulls are ignored. Only counts reach the driver; each round's edges are written to the shared folder.
    Edges that are stars around least nodes already take no round: to add edges to known components, give (node, root) of these and the new edges.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(now):
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
