"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes that have an edge and aren't the smallest of their component, given edges (u, v) with u > v.

    Both kinds of star keep components as they are; the rounds end when the
    edges no longer change, after a number of rounds that grows with the
    logarithm of the largest component. Each round is written out. A table
    without edges gives none.
    """
    current, before = written(edges.select("u", "v").distinct(), "edges"), None
    while True:
        sign = current.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if sign == before or sign[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
        current = written(_small_star(_large_star(current)), "edges")
