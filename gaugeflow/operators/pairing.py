"""Pairs of scores of two models on the same examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(cells: DataFrame, a: str, b: str, by: list[str] = ["metric", "example_id"]) -> DataFrame:  # noqa: B006
    """(*by, score_a, score_b, diff): diff is b minus a. One aggregation instead of a
    self-join; examples that lack one of the two fall out."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    two = cells.where(F.col("model").isin(a, b)).groupBy(*by).agg(pick(a).alias("score_a"), pick(b).alias("score_b"))
    return two.where("score_a IS NOT NULL AND score_b IS NOT NULL").withColumn("diff", F.col("score_b") - F.col("score_a"))


def coverage(cells: DataFrame, a: str, b: str) -> DataFrame:
    """How many examples each model has, both have, and only one has."""
    has = lambda m: F.max(F.when(F.col("model") == m, 1).otherwise(0))
    each = cells.where(F.col("model").isin(a, b) & F.col("score").isNotNull()).groupBy("metric", "example_id").agg(has(a).alias("a"), has(b).alias("b"))
    return each.groupBy("metric").agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_paired"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("n_unmatched")
    )


def merge_two(left: DataFrame, right: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Cells of two one-model files on the examples that both have; of an id repeated on
    the right the last row counts. Equal labels get a suffix."""
    label_b = f"{label_b}_2" if label_a == label_b else label_b
    last = right.groupBy("metric", "example_id").agg(F.max(F.struct("ord", "score")).alias("r")).select("metric", "example_id", F.col("r.score").alias("score_b"))
    both = left.select("metric", "example_id", F.col("score").alias("score_a"), "ord").join(last, ["metric", "example_id"])
    sides = F.array(F.struct(F.lit(label_a).alias("model"), F.col("score_a").alias("score")), F.struct(F.lit(label_b).alias("model"), F.col("score_b").alias("score")))
    return both.select("metric", "example_id", "ord", F.inline(sides)).select("metric", "example_id", "model", "score", "ord")


def oriented(mean_diff: Column) -> Column:
    """1 where b leads (ties too), -1 where a does."""
    return F.when(mean_diff >= 0, 1).otherwise(-1)
