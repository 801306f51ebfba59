"""Ranks with ties over tables of any size.

A window without a partition would bring all rows to one task; here values are spread
over buckets at approximate quantiles and only counts of buckets are summed globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def midranks(df: DataFrame, value: str, by: list[str] | None = None, buckets: int = 64, name: str = "rank") -> DataFrame:
    """``df`` with the rank of ``value`` (mean rank among equals) within ``by``, from 1."""
    by = by or []
    # grouping keys spread the work already; without any, quantile buckets do
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__t"))
    if by:
        below = F.sum("__t").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        ranks = counts.select(*by, value, (F.coalesce(below, F.lit(0)) + (F.col("__t") + 1) / F.lit(2.0)).alias(name))
    else:
        shares = [i / buckets for i in range(1, buckets)]
        edges = counts.agg(F.percentile_approx(value, shares, 1000).alias("e")).first()["e"] or []
        edges = sorted(set(edges))
        bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
        placed = counts.withColumn("__b", bucket)
        sums = placed.groupBy("__b").agg(F.sum("__t").alias("__n"))
        before = F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
        offsets = sums.select("__b", F.coalesce(before, F.lit(0)).alias("__o"))  # a row per bucket
        below = F.sum("__t").over(W.partitionBy("__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        ranks = placed.withColumn("__w", F.coalesce(below, F.lit(0))).join(F.broadcast(offsets), "__b").select(
            value, (F.col("__o") + F.col("__w") + (F.col("__t") + 1) / F.lit(2.0)).alias(name)
        )
    return df.join(ranks, [*by, value])
