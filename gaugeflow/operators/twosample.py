"""Run-level comparison of two unpaired samples (model, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import midranks
from .resample import RESAMPLES, interval


def summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return runs.groupBy(*(by or []), "model").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std_score"))


def rank_sums(runs: DataFrame, a: str, b: str) -> DataFrame:
    """U of a, P(a > b) with ties for half, and the sum of t^3 - t over equal values, from
    ranks: no cross join of the samples."""
    own = runs.where(F.col("model").isin(a, b)).select("model", "score")
    ranked = midranks(own, "score")
    ties = own.groupBy("score").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_sum"))
    m = ranked.agg(
        F.count_if(F.col("model") == a).alias("n_a"), F.count_if(F.col("model") == b).alias("n_b"), F.sum(F.when(F.col("model") == a, F.col("rank"))).alias("r_a")
    )
    u = F.col("r_a") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return m.join(F.broadcast(ties)).select("n_a", "n_b", u.alias("u"), F.try_divide(u, F.col("n_a") * F.col("n_b")).alias("p_a_gt_b"), "tie_sum")


def win_share(a: np.ndarray, b: np.ndarray) -> float:
    order = np.sort(b)
    below, upto = np.searchsorted(order, a, "left"), np.searchsorted(order, a, "right")
    return float((below + upto).sum()) / (2 * len(a) * len(b))


def bootstrap_win_share(a: np.ndarray, b: np.ndarray, confidence: float = 0.95, times: int = RESAMPLES, seed: int = 0) -> tuple[float, float, float]:
    """P(a > b) and its interval, both samples resampled."""
    rng, out = np.random.default_rng(seed), np.empty(times)
    for i in range(times):
        x = a[rng.integers(0, len(a), size=len(a))]
        out[i] = win_share(x, b[rng.integers(0, len(b), size=len(b))])
    return win_share(a, b), *interval(out, confidence)
