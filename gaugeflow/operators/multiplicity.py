"""Corrections for many tests: a table of p values, one row a test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holm(tests: DataFrame, p: str = "p_value", order: str = "ord", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adjusted p (running maximum of (k - i) p) and rejection at ``alpha``, inclusive."""
    family = W.partitionBy(*(by or [F.lit(1)]))
    ranked = family.orderBy(p, order)
    k = F.count("*").over(family)
    raw = (k - F.row_number().over(ranked) + 1) * F.col(p)
    out = tests.withColumn("holm_rank", F.row_number().over(ranked)).withColumn("k", k).withColumn("__raw", raw)
    out = out.withColumn("holm_p", F.least(F.lit(1.0), F.max("__raw").over(ranked.rowsBetween(W.unboundedPreceding, 0))))
    return out.drop("__raw").withColumn("holm_reject", F.col("holm_p") <= alpha)


def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    k = F.count("*").over(W.partitionBy(*(by or [F.lit(1)])))
    return tests.withColumn("bonferroni_p", F.least(F.lit(1.0), F.col(p) * k)).withColumn("bonferroni_reject", F.col(p) < F.lit(alpha) / k)


def uncorrected(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("reject", F.col(p) < alpha)


def step_thresholds(adjusted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The level at which each test of a Holm family was decided."""
    rejected = F.sum(F.col("holm_reject").cast("int")).over(W.partitionBy(F.lit(1)))
    left = F.when(F.col("holm_reject"), F.col("k") - F.col("holm_rank") + 1).otherwise(F.greatest(F.col("k") - rejected, F.lit(1)))
    return adjusted.withColumn("step_alpha", F.lit(alpha) / left)
