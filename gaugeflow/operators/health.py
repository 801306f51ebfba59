"""Whether a benchmark still has room and tells models apart; and how reruns behave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saturation(cells: DataFrame, ceiling: float | None = None, fraction: float = 0.95) -> DataFrame:
    """The best model's mean as a share of the ceiling (the greatest score seen, or a
    given one). Without a positive ceiling nothing is saturated."""
    per = cells.groupBy("metric", "model").agg(F.avg("score").alias("m"), F.max("score").alias("x"))
    top = per.groupBy("metric").agg(F.max("m").alias("top_mean"), F.max("x").alias("observed_max"))
    top = top.withColumn("ceiling", F.lit(ceiling) if ceiling is not None else F.col("observed_max"))
    share = F.when(F.col("ceiling") > 0, F.try_divide("top_mean", "ceiling"))
    return top.withColumn("fraction_of_ceiling", share).withColumn("saturated", F.coalesce(share >= fraction, F.lit(False)))


def discrimination(cells: DataFrame, least: float = 0.01) -> DataFrame:
    """Population deviation over all scores of all models."""
    return cells.groupBy("metric").agg(F.stddev_pop("score").alias("pooled_std")).withColumn("discriminating", F.col("pooled_std") >= least)


def run_gaps(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Gap b - a of each run index, over the runs that all examples have."""
    own = runs.where(F.col("model").isin(a, b))
    sizes = own.groupBy("metric", "example_id", "model").agg(F.count("*").alias("k"))
    both = sizes.groupBy("metric", "example_id").agg(F.count("*").alias("sides"), F.min("k").alias("k")).where("sides = 2")
    shared = both.groupBy("metric").agg(F.min("k").alias("r"))
    used = own.join(both.select("metric", "example_id"), ["metric", "example_id"]).join(F.broadcast(shared), "metric").where("run_idx < r AND r >= 2")
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("score")))
    return used.groupBy("metric", "run_idx").agg((mean(b) - mean(a)).alias("gap"))


def rerun_stability(gaps: DataFrame) -> DataFrame:
    """Runs whose leader isn't the overall one; noise against the gap itself."""
    overall = gaps.groupBy("metric").agg(F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("gap_std"), F.count("*").alias("runs"))
    sign = lambda c: F.signum(F.col(c))
    flips = gaps.join(F.broadcast(overall.select("metric", "mean_gap")), "metric").groupBy("metric").agg(F.count_if(sign("gap") != sign("mean_gap")).alias("flips"))
    out = overall.join(flips, "metric")
    status = F.when(F.col("flips") == 0, "pass").when(2 * F.col("flips") < F.col("runs"), "warn").otherwise("fail")
    noise = F.when((F.col("gap_std") > 0) & (F.col("gap_std") >= F.abs("mean_gap")), "warn").otherwise("pass")
    return out.withColumn("stability_status", status).withColumn("variance_status", noise).withColumn("snr", F.try_divide(F.abs("mean_gap"), "gap_std"))


def single_run_means(runs: DataFrame, model: str) -> DataFrame:
    own = runs.where(F.col("model") == model)
    shared = own.groupBy("metric", "example_id").agg(F.count("*").alias("k")).groupBy("metric").agg(F.min("k").alias("r"))
    return own.join(F.broadcast(shared), "metric").where("run_idx < r AND r >= 2").groupBy("metric", "run_idx").agg(F.avg("score").alias("mean_score"))


REASONS = (*(f"{what}_{side}" for what in ("missing_runs", "nonfinite") for side in "ab"), "score_run_mean_disagreement", "singleton_in_mixed")


def rerun_eligible(cells: DataFrame, runs: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, example_id, reason, k_a, k_b, m_a, m_b, v_a, v_b): every example with its
    runs, and the first reason for which it can't take part in a prediction of reruns, if
    any: no score or no run of a model, a run that isn't finite, a score that isn't the
    mean of its runs, or a single run where others have more."""
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    streams = runs.where(F.col("model").isin(a, b)).groupBy("metric", "example_id").agg(*[
        f(F.when(F.col("model") == m, x)).alias(f"{name}_{side}")
        for side, m in (("a", a), ("b", b))
        for name, f, x in (("k", F.count, F.lit(1)), ("m", F.avg, F.col("score")), ("v", F.var_samp, F.col("score")), ("f", F.min, finite))
    ])
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    scores = cells.groupBy("metric", "example_id").agg(pick(a).alias("s_a"), pick(b).alias("s_b"))
    each = scores.join(streams, ["metric", "example_id"], "full")
    lacking = lambda side: F.col(f"s_{side}").isNull() | (F.coalesce(f"k_{side}", F.lit(0)) == 0)
    apart = lambda side: F.abs(F.col(f"s_{side}") - F.col(f"m_{side}")) > 1e-12 + 1e-10 * F.abs(f"m_{side}")
    first = (
        F.when(lacking("a"), REASONS[0]).when(lacking("b"), REASONS[1]).when(~F.col("f_a"), REASONS[2]).when(~F.col("f_b"), REASONS[3]).when(apart("a") | apart("b"), REASONS[4])
    )
    each = each.withColumn("first", first)
    least, most = F.least("k_a", "k_b"), F.greatest("k_a", "k_b")
    mixed = each.where("first IS NULL").groupBy("metric").agg(((F.min(least) == 1) & (F.max(most) > 1)).alias("mixed"))
    reason = F.coalesce("first", F.when(F.coalesce("mixed", F.lit(False)) & (least == 1), REASONS[5]))
    return each.join(F.broadcast(mixed), "metric", "left").select("metric", "example_id", reason.alias("reason"), *[f"{n}_{s}" for n in "kmv" for s in "ab"])  # mixed: a row per metric


def rerun_prediction(eligible: DataFrame, future: int) -> DataFrame:
    """A row per metric: counts by reason, and over the eligible examples the mean gap b - a,
    the variance of the mean gap of ``future`` new runs and its degrees of freedom. Without
    a second run or any spread the variance is 0, and ``degenerate`` says which."""
    ok = F.col("reason").isNull()
    q = lambda s: F.col(f"v_{s}") * (1 / F.col(f"k_{s}") + F.lit(1.0 / future))
    d = lambda s: F.try_divide(q(s) * q(s), F.col(f"k_{s}") - 1)
    out = eligible.groupBy("metric").agg(
        F.count("*").alias("n_total"), F.count_if(ok).alias("n"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
        F.avg(F.when(ok, F.col("m_b") - F.col("m_a"))).alias("mean_gap"), F.max(F.when(ok, F.greatest("k_a", "k_b"))).alias("most"),
        F.sum(F.when(ok, F.coalesce(q("a"), F.lit(0.0)) + F.coalesce(q("b"), F.lit(0.0)))).alias("q"), F.sum(F.when(ok, F.coalesce(d("a"), F.lit(0.0)) + F.coalesce(d("b"), F.lit(0.0)))).alias("d"),
    )
    degenerate = F.when(F.col("most") == 1, "single_run").when(F.col("q") == 0, "observed_zero_variance")
    spread = degenerate.isNull() & (F.col("n") > 0)
    return out.select(
        "metric", "n_total", "n", *REASONS, "mean_gap", F.when(F.col("n") > 0, degenerate).alias("degenerate"),
        F.when(spread, F.col("q") / (F.col("n") * F.col("n"))).alias("variance"), F.when(spread, F.try_divide(F.col("q") * F.col("q"), F.col("d"))).alias("df"),
    )


def rerun_components(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Variance of the mean gap that reruns alone explain: the sum over (example, model)
    streams of s^2 / (k n^2), and its Welch-Satterthwaite degrees of freedom."""
    streams = runs.where(F.col("model").isin(a, b)).groupBy("metric", "example_id", "model").agg(F.count("*").alias("k"), F.avg("score").alias("m"), F.var_samp("score").alias("v"))
    pair = streams.groupBy("metric", "example_id").agg(
        F.count("*").alias("sides"), F.min("k").alias("least"), F.sum(F.when(F.col("model") == b, F.col("m")).otherwise(-F.col("m"))).alias("gap"),
        F.sum(F.col("v") / F.col("k")).alias("q"), F.sum(F.try_divide(F.pow(F.col("v") / F.col("k"), F.lit(2.0)), F.col("k") - 1)).alias("d"),
    ).where("sides = 2 AND least >= 2")
    return pair.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), (F.sum("q") / (F.count("*") * F.count("*"))).alias("variance"), F.try_divide(F.sum("q") * F.sum("q"), F.sum("d")).alias("df")
    )
