"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Each step hooks neighbours to the smallest node in sight, which halves the
    depth of what is not yet a star; a node's neighbours are never gathered in
    one place, only their minimum is. Self-edges and nulls are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        before, edges = edges, staged(small, "edges")
        drop_staged(before)
        roots = edges.select(F.col("b").alias("a")).distinct()
        loose = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").union(edges.join(roots, "a", "left_semi").select("a"))
        if loose.isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
