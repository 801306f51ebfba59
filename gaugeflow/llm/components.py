"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of its neighbourhood: the greater
    neighbours (large star), or the lesser ones and the node itself (small star)."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't its component's least
    node. Each round is written below ``at``; there are about log2 of the longest path."""
    spark = edges.sparkSession
    now = settle(edges.where("u <> v").select("u", "v").distinct(), f"{at}/round-0")
    mark, k = None, 0
    while True:
        k += 1
        after = settle(_stars(_stars(now, True), False), f"{at}/round-{k}")
        remove(spark, f"{at}/round-{k - 1}")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        now = after
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
