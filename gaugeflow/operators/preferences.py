"""Judgements that name a winner: (example_id, judge, winner, is_tie)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import exact_two_sided, magnitude


def votes(prefs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Winner of each example by strict majority of its judges, else a tie."""
    each = prefs.groupBy(*(by or []), "example_id").agg(
        F.count_if(F.col("winner") == a).alias("votes_a"), F.count_if(F.col("winner") == b).alias("votes_b"), F.count_if((F.col("winner").isin(a, b)) | F.col("is_tie")).alias("judged")
    ).where("judged > 0")
    outcome = F.when(2 * F.col("votes_a") > F.col("judged"), "a").when(2 * F.col("votes_b") > F.col("judged"), "b").otherwise("tie")
    return each.withColumn("outcome", outcome)


def tallies(prefs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return votes(prefs, a, b, by).groupBy(*(by or [])).agg(count("a").alias("wins_a"), count("b").alias("wins_b"), count("tie").alias("ties"), F.count("*").alias("n_judged"))


def judge_tallies(prefs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return prefs.groupBy(*(by or []), "judge").agg(F.count_if(F.col("winner") == a).alias("wins_a"), F.count_if(F.col("winner") == b).alias("wins_b"), F.count_if("is_tie").alias("ties"))


def sign_test(tally: DataFrame) -> DataFrame:
    """Exact test of the decisive examples, and Cohen's g of the winning rate."""
    n = F.col("wins_a") + F.col("wins_b")
    rate = F.coalesce(F.try_divide(F.col("wins_a"), n), F.lit(0.5))
    return tally.withColumn("n_decisive", n).withColumn("win_rate_a", rate).withColumn("cohens_g", F.abs(rate - 0.5)).withColumn("magnitude", magnitude(F.col("cohens_g"), "g")).withColumn("p_value", exact_two_sided(F.col("wins_a"), n))


def win_rate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Win rate of a on paired scores, ties for half."""
    m = pairs.groupBy(*by).agg(F.count_if(F.expr("diff < 0")).alias("wins_a"), F.count_if(F.expr("diff > 0")).alias("wins_b"), F.count_if(F.expr("diff = 0")).alias("ties"), F.count("*").alias("n"))
    return m.withColumn("win_rate_a", (F.col("wins_a") + F.col("ties") * 0.5) / F.col("n"))
