"""Connected components of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). Large star: a vertex hands its larger neighbours its least one. Small star: its smaller ones and itself."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the least node that links reach.

    Each round is a written table, so a lost executor costs one round at most;
    rounds grow with the logarithm of the longest path. Loops and repeated
    links do no harm; no links give no rows.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = mark(edges)
    while before[0]:
        edges = durable(_star(_star(edges, True), False), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
