"""Connected components by alternating stars: every round hangs each node on a smaller one, until all hang on their root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import cut


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """(v, u) pairs with v > u; returns such pairs after one star step. Every step aggregates before it joins."""
    if large:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # (node, neighbour)
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        moved = both.join(least, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        moved = edges.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.withColumnRenamed("m", "u"))
    return moved.filter(F.col("v") > F.col("u")).distinct()


def _done(edges: DataFrame) -> bool:
    """Does every node hang on one other, and nothing on that node?"""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("u").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter(
        (F.col("hangs") > 1) | (F.col("hangs") > 0) & (F.col("holds") > 0)).isEmpty()


def roots(links: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for all nodes that have a link; a root is the smallest node of its component and isn't listed itself.

    ``known``: what this gave for earlier links, to which ``links`` are added; only the roots that they connect are looked at again."""
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u"))
    for c in ("v", "u") if known is not None else ():
        ends = ends.join(known.select(F.col("node").alias(c), F.col("root").alias("root_" + c)), c, "left").withColumn(c, F.coalesce("root_" + c, c)).select("v", "u")
    edges = cut(ends.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).filter(F.col("v") > F.col("u")).distinct())
    while not _done(edges):
        edges = cut(_hang(_hang(edges, True), False))
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    if known is None or found.isEmpty():
        return found if known is None else known
    higher = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(known.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(found))
