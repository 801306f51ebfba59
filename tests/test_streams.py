"""Draws that are split between tasks, against a single loop over the same stream."""

import time

import numpy as np
import pandas as pd
import pytest

from gaugeflow.functions import special
from gaugeflow.operators import families, resample, streams
from gaugeflow.plans import kernels


@pytest.fixture
def split(monkeypatch):
    """Several tasks, and blocks that end within a replicate, for a few hundred values too."""
    monkeypatch.setattr(streams, "WORK", 20_000)


def test_a_stream_goes_on_at_any_word():
    for n in (1, 2, 7, 1000, 70_001):
        all_ = np.random.default_rng(3).integers(0, n, size=5 * n)
        at = streams.starts(None, {(3, n): [0, n, 3 * n]})[3, n]
        for draw, (word, skip) in at.items():
            rng = streams.generator(3, word)
            assert (rng.integers(0, n, size=skip + n)[skip:] == all_[draw : draw + n]).all()


def test_words_are_counted_in_tasks_as_in_one(spark, monkeypatch):
    monkeypatch.setattr(streams, "FEW", 1000)
    n, draws = 3_000_000, [0, 1_500_001, 6_000_000]
    far = streams.starts(spark, {(5, n): draws})[5, n]
    all_ = np.random.default_rng(5).integers(0, n, size=6_000_010)
    for draw, (word, skip) in far.items():
        assert (streams.generator(5, word).integers(0, n, size=skip + 10)[skip:] == all_[draw : draw + 10]).all()


def _scores(n: int = 401) -> pd.DataFrame:
    r = np.random.default_rng(8)
    a = {"fine": r.normal(size=n), "levels": r.integers(0, 5, size=n).astype(float), "yes": r.integers(0, 2, size=n).astype(float)}
    rows = [(m, i, float(x), float(y), f"c{i % 17:02d}") for m, v in a.items() for i, (x, y) in enumerate(zip(v, r.permutation(v)))]
    return pd.DataFrame(rows, columns=["metric", "ord", "score_a", "score_b", "cluster"])


@pytest.mark.parametrize("clustered", [False, True])
def test_comparison_equals_one_loop_bit_by_bit(spark, split, clustered):
    frame, times = _scores(), 300
    got = {r["metric"]: r for r in kernels.compare(spark.createDataFrame(frame.sample(frac=1, random_state=1)), [0.05, 0.01], 0.95, times, 4, clustered).collect()}
    for metric, f in frame.groupby("metric"):
        raw = (f["score_b"] - f["score_a"]).to_numpy()
        sign = 1.0 if raw.mean() >= 0 else -1.0
        d, r, c = sign * raw, got[metric], pd.Series(raw).groupby(f["cluster"].to_numpy(), sort=True)
        s, n = c.sum().to_numpy(), c.size().to_numpy(dtype=float)
        grouped = clustered and metric != "yes"
        means, signed = (resample.clustered_means(sign * s, n, times, 4), resample.clustered_means(s, n, times, 4)) if grouped else (resample.bootstrap_means(d, times, 4), resample.bootstrap_means(raw, times, 4))
        assert (r["ci_low"], r["ci_high"]) == resample.interval(means)
        assert (r["eq_lows"][1], r["eq_highs"][1]) == resample.interval(signed, 0.98) and r["eq_low"] == resample.interval(signed, 0.9)[0]
        if metric == "yes":
            continue
        assert r["p_value"] == (resample.clustered_permutation_p(sign * s, n, times, 4) if clustered else resample.permutation_p(d, times, 4))
        statistic, v = (kernels.signed_rank_share, np.rint(d)) if metric == "levels" else (kernels.paired_d, d)
        assert (r["effect_low"], r["effect_high"]) == resample.interval(resample.bootstrap_statistic(v, statistic, times, 4))


def test_facts_need_no_draws(spark):
    frame = spark.createDataFrame(_scores())
    names = ["metric", "n", "mean_a", "mean_diff", "domain", "effect", "superiority"]
    with_, without = (kernels.compare(frame, 0.05, 0.95, 50, 0, False, draws).select(*names).orderBy("metric").collect() for draws in (True, False))
    assert with_ == without


def test_means_of_groups_equal_one_loop(spark, split):
    frame = _scores()
    frame["diff"] = frame["score_b"] - frame["score_a"]
    got = {r["metric"]: r for r in resample.exact_mean_test(spark.createDataFrame(frame), ["metric"], "ord", times=300, seed=2).collect()}
    for metric, f in frame.groupby("metric"):
        v = f["diff"].to_numpy()
        means = resample.bootstrap_means(v, 300, 2)
        assert (got[metric]["n"], got[metric]["mean_diff"]) == (len(v), v.mean())
        assert (got[metric]["ci_low"], got[metric]["ci_high"]) == resample.interval(means) and got[metric]["p_value"] == resample.permutation_p(v, 300, 2)


def test_ranks_equal_one_loop(spark, split):
    r = np.random.default_rng(1)
    rows = np.round(r.normal(size=(300, 3)), 1)
    rows[r.random(rows.shape) < 0.1] = np.nan
    cells = [("m", i, "abc"[j], i, float(rows[i, j])) for i in range(300) for j in range(3) if not np.isnan(rows[i, j])]
    df = spark.createDataFrame(cells, "metric string, example_id bigint, model string, ord bigint, score double")
    means = np.nanmean(rows, axis=0)
    order = np.array(sorted(range(3), key=lambda i: -means[i]))
    want = families.rank_stability(rows[~np.isnan(rows).all(axis=1)], order, 200, 6)
    for x in families.rank_stability_of(df, 200, 6).collect():
        i = "abc".index(x["model"])
        assert x["occupancy"] == want["occupancy"][i, x["rank"] - 1] and x["top1"] == want["top1"] and x["units"] == want["units"]


def test_exact_binomial_of_millions_of_trials():
    began = time.time()
    assert special.binomial_two_sided(1_799_000, 3_600_000) == pytest.approx(2 * special.normal_cdf(-(1000 - 0.5) / 900_000**0.5), rel=1e-5)
    assert time.time() - began < 5
    whole = 2 * sum(map(int, _binomials(2000, 980))) / 2**2000
    assert special.binomial_two_sided(980, 2000) == pytest.approx(whole, rel=1e-12)


def _binomials(n: int, k: int):
    each = 1
    for i in range(k + 1):
        yield each
        each = each * (n - i) // (i + 1)


def test_metrics_of_a_suite_are_summed_together(spark, tmp_path):
    """One aggregation over lines, and a line without a score counts for no mean, as in SQL."""
    import duckdb

    from gaugeflow import views

    rows = [(1, "A", 0.05, 0.01, 10.0), (1, "A", 0.07, None, 20.0), (1, "R", None, 0.03, 5.0), (2, "N", 0.1, 0.08, None)]
    spark.createDataFrame(rows, "l_partkey bigint, l_returnflag string, l_discount double, l_tax double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = views.suite_cells(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"WITH {views.SUITE} SELECT metric, example_id, model, score FROM cells").fetchall()
    assert sorted(map(tuple, got.select("metric", "example_id", "model", "score").collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan.split("Aggregate")[-1] and plan.count("Aggregate") == 1


def test_hash_draws_of_whole_vectors_are_those_of_rows(spark, split):
    import hashlib

    from gaugeflow.operators import hashdraws

    for seed, replicate, n in ((0, 0, 12), (17, 199, 1001)):
        got = np.concatenate([w for _, w in hashdraws.draws(seed, replicate, n)])
        assert got.tolist() == [int(hashlib.md5(f"{seed}|{replicate}|{s}".encode()).hexdigest()[:8], 16) for s in range(n)]
    x = np.random.default_rng(4).normal(size=1001)
    values = spark.createDataFrame([(7 * i, float(v)) for i, v in enumerate(x)], "slot bigint, x double").repartition(3)
    found = resample.portable_means(values, 20, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no row a draw
    for r in found.collect():
        pick = [int(hashlib.md5(f"5|{r['replicate']}|{s}".encode()).hexdigest()[:8], 16) % 1001 for s in range(1001)]
        assert r["mean"] == x[pick].mean()
