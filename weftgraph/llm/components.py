"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import shared_dir


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _links_to_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Join each node's neighbours on one side to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if larger:
        side, around = both.filter("v > u"), both
    else:
        side, around = both.filter("v < u"), both.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (u long, v long) edges; a component is its least node.

    Each round is a pair of joins over the edges, whose number doesn't grow;
    rounds grow with the logarithm of the longest chain.  The lineage is cut in
    the shared folder after each round.
    """
    shared_dir(edges.sparkSession)
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    stamp = _stamp(edges)
    while stamp[0]:
        edges = _links_to_least(_links_to_least(edges, True), False).checkpoint()
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
