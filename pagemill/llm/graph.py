"""Connected components of links held in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v): neighbours are hung on the least node around."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the least neighbour is joined back on; a node of very many links is a skewed join, which AQE splits
    hung = both.join(least, "u")
    out = hung.filter(F.col("v") > F.col("u")) if large else hung
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v), the component being its least node. Loops and copies don't matter.

    Rounds grow with the logarithm of the longest path; each is written to the shared folder."""
    now = cut(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct(), name)
    for _ in range(most):
        # settled: every node hangs on one node, and none of those hangs on another
        n, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        now = cut(_stars(_stars(now, True), False), name)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
