"""Effect sizes of paired scores, and tests on counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cohens_h, exact_two_sided, magnitude
from .ranking import midranks


def score_domain(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Whether the scores of both sides are 0 or 1, or 3 to 10 whole levels, or neither."""
    both = pairs.select(*by, F.explode(F.array("score_a", "score_b")).alias("s"))
    flags = both.groupBy(*by).agg(
        F.bool_and(F.col("s").isin(0.0, 1.0)).alias("binary"),
        F.bool_and(F.abs(F.col("s") - F.rint("s")) <= 1e-9).alias("whole"),
        F.countDistinct(F.rint("s")).alias("levels"),
    )
    kind = F.when(F.col("binary"), "binary").when(F.col("whole") & F.col("levels").between(3, 10), "ordinal").otherwise("continuous")
    return flags.select(*by, kind.alias("domain"), "levels")


def discordant(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Examples that only one side gets right."""
    return pairs.groupBy(*by).agg(
        F.count_if(F.expr("score_b = 1 AND score_a = 0")).alias("b_only"), F.count_if(F.expr("score_a = 1 AND score_b = 0")).alias("a_only"), F.count("*").alias("n")
    )


def mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p_value", exact_two_sided(F.col("b_only"), F.col("b_only") + F.col("a_only")))


def cohens_d(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean over sample deviation of differences; without spread 0, or unbounded."""
    m = pairs.groupBy(*by).agg(F.avg("diff").alias("mean_diff"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("sd_diff"), F.count("*").alias("n"))
    d = F.when(F.col("sd_diff") > 0, F.try_divide("mean_diff", "sd_diff")).when(F.col("mean_diff") == 0, 0.0).otherwise(F.signum("mean_diff") * float("inf"))
    return m.withColumn("cohens_d", d).withColumn("magnitude", magnitude(F.col("cohens_d"), "d"))


def rate_effect(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Risk difference and Cohen's h of two success rates."""
    m = pairs.groupBy(*by).agg(F.avg("score_a").alias("rate_a"), F.avg("score_b").alias("rate_b"))
    m = m.withColumn("risk_difference", F.col("rate_b") - F.col("rate_a")).withColumn("cohens_h", cohens_h(F.col("rate_b"), F.col("rate_a")))
    return m.withColumn("magnitude", magnitude(F.col("cohens_h"), "h"))


def superiority(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of examples where b is better, ties for half."""
    return pairs.groupBy(*by).agg(F.avg(F.when(F.col("diff") > 0, 1.0).when(F.col("diff") == 0, 0.5).otherwise(0.0)).alias("prob_superiority"))


def rank_biserial(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Matched-pairs rank correlation: signed share of the ranks of differences, zeros
    left out; 0 without any difference."""
    moved = pairs.where("diff <> 0").select(*by, F.abs("diff").alias("size"), F.signum("diff").alias("sign"))
    ranked = midranks(moved, "size", by)
    found = ranked.groupBy(*by).agg((F.sum(F.col("rank") * F.col("sign")) / F.sum("rank")).alias("rank_biserial")) if by else ranked.agg(
        (F.sum(F.col("rank") * F.col("sign")) / F.sum("rank")).alias("rank_biserial")
    )
    if not by:
        return found.select(F.coalesce("rank_biserial", F.lit(0.0)).alias("rank_biserial"))
    return pairs.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("rank_biserial", F.lit(0.0)).alias("rank_biserial"))
