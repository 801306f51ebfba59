import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow import api, cli
from gaugeflow.functions import special
from gaugeflow.functions.scores import coerce_score, normal_text
from gaugeflow.operators import families, health, resample
from gaugeflow.plans.audit import pair_findings, predictive_rerun
from gaugeflow.plans.config import AuditConfig
from gaugeflow.plans.data import EvalFrames
from gaugeflow.plans.findings import Finding, NotTrusted, plain, verdict
from gaugeflow.sources import adapters, load
from gaugeflow.sources.rows import UnknownFormat


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(p)

    return put


def cells(data):
    return {(r["metric"], r["example_id"], r["model"]): r["score"] for r in data.cells.collect()}


def test_coercion(spark):
    raw = ["pass", " 85% ", "", "n/a", "1_000", "1.0d", "0x1p3", "1f", ".5", "-2e-1", "TRUE", "lost", None, "1__0"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select(coerce_score(F.col("raw")).alias("s"), "i").orderBy("i").collect()
    assert [r["s"] for r in rows] == [1.0, 0.85, None, None, 1000.0, None, None, None, 0.5, -0.2, 1.0, 0.0, None, None]
    odd = spark.createDataFrame([("nan",), ("-inf",)], "raw string").select(coerce_score(F.col("raw"))).collect()
    assert odd[0][0] != odd[0][0] and odd[1][0] == float("-inf")


def test_normal_text(spark):
    got = spark.createDataFrame([("  Ça, va?\n bien! ",)], "t string").select(normal_text(F.col("t"))).first()[0]
    assert got == "ça va bien"


def test_long_csv_counts_what_it_skips(spark, write):
    p = write("a.csv", 'ID,Model,Score\n"q,1",A,pass\nq2,A,banana\n"q,1",B,0\nq2,B,1\n')
    data = load.load_suite(spark, p)
    assert cells(data) == {("score", "q,1", "A"): 1.0, ("score", "q,1", "B"): 0.0, ("score", "q2", "B"): 1.0}
    assert data.metadata["skipped_rows"] == 1 and data.model_names() == ["A", "B"]


def test_csv_fields_over_several_lines(spark, write):
    plain = write("p.csv", "id,model,score\n" + "".join(f"{i},A,{i}\n" for i in range(50)))
    broken = write("b.csv", 'id,model,score\n"q\n1",A,1\n"say ""x"", y",A,0\n')
    assert len(cells(load.load_suite(spark, plain))) == 50
    assert cells(load.load_suite(spark, broken)) == {("score", "q\n1", "A"): 1.0, ("score", 'say "x", y', "A"): 0.0}


def test_wide_jsonl_is_unpivoted_and_does_not_count(spark, write):
    p = write("a.jsonl", '{"id": 1, "gpt": "80%", "other": true}\n\n{"id": 2, "gpt": "?", "other": 0}\n')
    data = load.load_suite(spark, p)
    assert cells(data) == {("score", "1", "gpt"): 0.8, ("score", "1", "other"): 1.0, ("score", "2", "other"): 0.0}
    assert data.metadata["skipped_rows"] == 0


def test_broken_line_is_named(spark, write):
    with pytest.raises(UnknownFormat, match="line 2"):
        load.load_suite(spark, write("a.jsonl", '{"id": 1, "m": 1}\n[3]\n'))


def test_metrics_fan_out_or_become_runs(spark, write):
    p = write("a.json", [{"id": 1, "model": "A", "metric": "x", "score": 1}, {"id": 1, "model": "A", "metric": "y", "score": 0}])
    assert load.load_suite(spark, p).metrics() == ["x", "y"]
    one = load.load(spark, p)
    assert cells(one) == {("score", "1", "A"): 0.5} and one.runs.count() == 2


def test_winner_columns_become_preferences(spark, write):
    p = write("a.json", [{"id": i, "A": 1, "B": 0, "winner": w} for i, w in enumerate(["A", "tie", "B", "A"])])
    prefs = load.load_suite(spark, p).preferences.orderBy("row_ord").collect()
    assert [(r["winner"], r["is_tie"]) for r in prefs] == [("A", False), (None, True), ("B", False), ("A", False)]
    with pytest.raises(ValueError, match="no model"):
        load.load_suite(spark, write("b.json", [{"id": 1, "A": 1, "B": 0, "winner": "C"}]))


EXPORTS = {
    "promptfoo": ({"results": {"results": [{"provider": {"id": "m1"}, "testIdx": 3, "score": 0.5}, {"provider": "m2", "success": True}]}}, {("score", "3", "m1"): 0.5, ("score", "1", "m2"): 1.0}),
    "deepeval": ({"testCases": [{"name": "t1", "success": False}, {"name": "t2", "metricsData": [{"score": 0.5}, {"score": 1}]}], "hyperparameters": {"model": "m"}}, {("score", "t1", "m"): 0.0, ("score", "t2", "m"): 0.75}),
    "openevals": ([{"key": "k", "score": 1, "input": "x"}, {"key": "l", "score": None}], {("k", "0", "model"): 1.0}),
    "inspect": ({"eval": {"model": "m"}, "samples": [{"id": 1, "scores": {"acc": {"value": "C"}, "p": {"value": "P"}}}, {"id": 2}]}, {("acc", "1", "m"): 1.0, ("p", "1", "m"): 0.5}),
    "langfuse": ({"data": [{"name": "q", "value": 1, "dataType": "NUMERIC", "subject": {"kind": "trace", "id": "t"}}, {"name": "q", "value": "x", "dataType": "TEXT", "traceId": "u"}], "meta": {}}, {("q", "t", "model"): 1.0}),
    "langsmith": ([{"reference_example_id": "e", "feedback_stats": {"a": {"avg": 1}, "b": {"avg": 0}}}, {"reference_example_id": None, "feedback_stats": {}}], {("score", "e", "model"): 0.5}),
    "ragas": ([{"user_input": "?", "faithfulness": 1, "answer_relevancy": 0.5}], {("score", "0", "model"): 0.75}),
    "helm": ([{"instance_id": "i", "stats": [{"name": {"name": "exact_match"}, "mean": 1}, {"name": {"name": "num_trials"}, "mean": 1}]}], {("exact_match", "i", "model"): 1.0}),
    "mlflow_evaluate": ({"columns": ["q", "em/score", "latency"], "data": [["a", 1, 0.2], ["b", None, 0.4]]}, {("em", "0", "model"): 1.0, ("latency", "0", "model"): 0.2, ("latency", "1", "model"): 0.4}),
    "lighteval": ([{"doc": {"id": 1, "task_name": "t", "query": "", "choices": [], "gold_index": 0}, "metric": {"acc": 1, "acc_stderr": 0.1}}], {("acc", "t:1", "model"): 1.0}),
}


@pytest.mark.parametrize("name", EXPORTS)
def test_exports(spark, write, name):
    raw, want = EXPORTS[name]
    assert adapters.detect(raw).name == name
    data = load.load_suite(spark, write("x.json", raw))
    assert data.source_format == name and cells(data) == pytest.approx(want)


PAD = "x" * 9_000


@pytest.mark.parametrize("name", ["promptfoo", "mlflow_evaluate", "inspect", "langfuse", "lighteval"])
def test_large_exports_are_known_like_small_ones(spark, write, name):
    """More than eight megabytes, and what tells the format stands behind a thousand others."""
    k = 1100
    raw, want = {
        "promptfoo": ({"results": {"results": [{"provider": {"id": "m"}, "testIdx": i, "score": 1, "text": PAD} for i in range(k)]}}, {("score", str(i), "m"): 1.0 for i in range(k)}),
        "mlflow_evaluate": ({"eval_results_table": {"columns": ["q", "em/score"], "data": [[PAD, 0.5]] * k}}, {("em", str(i), "model"): 0.5 for i in range(k)}),
        "inspect": ({"eval": {"model": "m"}, "samples": [{"id": i, "text": PAD} for i in range(k)] + [{"id": k, "scores": {"acc": {"value": "C"}}}]}, {("acc", str(k), "m"): 1.0}),
        "langfuse": ({"data": [{"text": PAD}] * k + [{"name": "q", "value": 1, "traceId": "t"}]}, {("q", "t", "model"): 1.0}),
        "lighteval": ([{"text": PAD}] * k + [{"doc": {"id": 1, "task_name": "t", "query": "", "choices": [], "gold_index": 0}, "metric": {"acc": 1}}], {("acc", "t:1", "model"): 1.0}),
    }[name]
    data = load.load_suite(spark, write("x.json", raw))
    assert data.source_format == name and cells(data) == pytest.approx(want)


def test_outline_keeps_every_structure():
    from gaugeflow.sources.rows import outline

    raw = {"a": {"b": [{"k": i} for i in range(500)] + [{"k": "text"}, {"k": 1, "l": [1, {"m": None}]}]}, "c": [[1, 2]] * 40, "d": "[{", "e": []}
    got = outline(json.dumps(raw, indent=1))
    assert got["a"]["b"] == raw["a"]["b"][:10] + raw["a"]["b"][-2:] and len(got["c"]) == 10 and got["d"] == "[{" and got["e"] == []
    for bad in ("", "{", "[1,]", '{"a" 1}', "[1] 2", '{"a": 1,}', "[" * 100_000):
        with pytest.raises(ValueError):
            outline(bad)
    assert outline(" 3 ") == 3


def test_models_that_come_up_later_are_read(spark, write):
    lines = [{"id": 0, "a": 1}] + [{"id": i, "a": i % 2, "b": 1} for i in range(1, 20)]
    data = load.load_suite(spark, write("a.jsonl", "\n".join(map(json.dumps, lines))))
    assert data.model_names() == ["a", "b"] and len(cells(data)) == 39 and cells(data)["score", "7", "b"] == 1.0
    named = load.load_suite(spark, write("b.json", [{"id": 1, "zeta": 1, "alpha": 0, "criterion": "x"}, {"id": 1, "zeta": 0, "alpha": 0, "criterion": "y"}]))
    assert named.model_names() == ["zeta", "alpha"] and named.metrics() == ["x", "y"]


def test_refusals(spark, write):
    with pytest.raises(ValueError, match="page"):
        load.load_suite(spark, write("a.json", EXPORTS["langfuse"][0] | {"meta": {"page": 1, "totalPages": 2}}))
    with pytest.raises(ValueError, match="totals"):
        adapters.detect({"config_general": {"lighteval_sha": ""}, "results": {}, "config_tasks": {}})
    with pytest.raises(ValueError, match="several"):
        load.load_suite(spark, write("b.json", [{"name": "q", "value": 1, "traceId": "t"}] * 2))


def test_event_logs(spark, write):
    write("results_2026-01-02T03-04-05.6.json", {"model_name": "the-model"})
    p = write("samples_arc_2026-01-02T03-04-05.6.jsonl", '{"doc_id": 0, "resps": [], "metrics": ["acc", "norm"], "acc": 1.0, "norm": 0.5}\n')
    data = load.load_suite(spark, p)
    assert cells(data) == {("acc", "0", "the-model"): 1.0, ("norm", "0", "the-model"): 0.5} and data.metadata["model_name_inferred"] is False
    log = '{"spec": {"completion_fns": ["gpt"]}}\n{"type": "match", "sample_id": "s", "data": {"correct": true}}\n{"type": "match", "sample_id": "t", "data": {"correct": 1}}\n'
    data = load.load_suite(spark, write("e.jsonl", log))
    assert cells(data) == {("accuracy", "s", "gpt"): 1.0} and data.metadata["skipped_rows"] == 1


@pytest.fixture
def nested():
    examples = [{"id": f"e{i}", "scores": {"A": 0, "B": int(i % 12 != 0)}, "runs": {"A": [0, 0], "B": [1, int(i % 5 != 0)]}, "judges": {"gold": {"A": 0, "B": 1}, "j": {"A": 0, "B": int(i % 7 != 0)}}, "attributes": {"kind": "xy"[i % 2]}, "preferences": {"h": ["B", "B", "tie"][i % 3]}} for i in range(60)]
    return {"models": ["A", "B"], "examples": examples}


def test_a_clear_win(spark, write, nested, capsys):
    p = write("n.json", nested)
    cfg = AuditConfig(n_resamples=500, bayesian=True, win_rate=True, run_aware=True, run_aware_future_runs=2, all_pairs=True)
    r = api.audit(spark, p, slice_by="kind", config=cfg)
    by = {f.check: f for f in r.findings}
    assert by["decision"].details["outcome"] == "significant" and by["decision"].details["p_value"] == pytest.approx(2 * 0.5**55)
    assert by["judge_calibration"].details["reference"] == "gold" and by["preference_significance"].status == "pass"
    assert by["slice_comparison"].status == "pass" and by["rerun_stability"].status == "pass" and by["rank_stability"].status == "skip"
    counts = by["predictive_rerun"].details  # scores that aren't the mean of their runs don't count
    assert counts["n_predictive"] + counts["reason_counts"]["score_run_mean_disagreement"] == 60 and 0 < counts["n_predictive"] < 60
    assert json.dumps(r.to_dict()) and r.frame(spark).count() == len(r.findings)
    r.raise_if_below("low")
    out = write("r.json", r.to_dict())
    for args in (["audit", p, "--n-resamples", "200", "--html", out + ".html", "--md", out + ".md", "--explain"], ["audit", p, "--n-resamples", "200", "--json"], ["diff", out, out]):
        assert cli.main(args, spark) == 0
    assert "<h1>" in open(out + ".html").read() and "| PASS |" in open(out + ".md").read()
    assert "No change" in capsys.readouterr().out


def test_pairs_of_files_and_suites(spark, write):
    a = write("a.json", {"examples": [{"id": i, "scores": {"m": i % 2}} for i in range(20)]})
    b = write("b.json", {"examples": [{"id": i, "scores": {"m": 1}} for i in range(5, 30)]})
    r = api.audit(spark, [a, b], config=AuditConfig(n_resamples=200))
    by = {f.check: f.details for f in r.findings}
    assert by["pairing_coverage"]["unmatched_examples"] == 15 and set(r.models) == {"m", "m_2"} and by["decision"]["n"] == 15
    rows = [{"id": i, "model": m, "metric": k, "score": (m == "B") * (i % (3 if k == "x" else 2) > 0)} for i in range(40) for m in "AB" for k in "xy"]
    s = api.audit_suite(spark, write("s.json", rows), config=AuditConfig(n_resamples=200, correction="holm", gated_metrics={"x"}))
    assert list(s.reports) == ["x", "y"] and all(t["rejected"] for t in s.tests.values()) and s.tests["x"]["alpha"] == 0.025
    assert json.dumps(s.to_dict()) and s.level in ("HIGH", "MODERATE", "LOW")
    assert cli.main(["audit", write("t.json", rows), "--html", "x.html", "--n-resamples", "100"], spark) == 2


def scores(**by_metric):
    """Records of models A and B from lists of scores."""
    return [{"id": i, "model": m, "metric": k, "score": v} for k, (a, b) in by_metric.items() for m, values in (("A", a), ("B", b)) for i, v in enumerate(values)]


def test_each_metric_of_a_suite_is_held_to_its_own_level(spark, write):
    p = write("s.json", scores(strong=([0] * 12, [1] * 12), border=([int(i == 4) for i in range(9)], [int(i != 4) for i in range(9)])))
    run = lambda c: api.audit_suite(spark, p, config=AuditConfig(n_resamples=300, correction=c), model_b="B", model_a="A")
    holm, bonferroni, none = run("holm"), run("bonferroni"), run("none")
    decision = lambda r, m: next(f for f in r.reports[m].findings if f.check == "decision").details
    assert decision(bonferroni, "border")["outcome"] != "significant" and decision(holm, "border")["outcome"] == "significant"
    assert {m: t["alpha"] for m, t in holm.tests.items()} == {"strong": 0.025, "border": 0.05}
    assert {decision(bonferroni, m)["alpha"] for m in bonferroni.reports} == {0.025} and {decision(none, m)["alpha"] for m in none.reports} == {0.05}
    p_values = {m: t["p_value"] for m, t in none.tests.items()}
    assert all(t["adjusted_p"] == min(1, 2 * p_values[m]) for m, t in bonferroni.tests.items())
    payload = holm.to_dict()
    assert payload["alpha"] == 0.05 and payload["corrected_alpha"] == 0.025 and payload["metric_alphas"] == {"strong": 0.025, "border": 0.05} and set(payload["adjusted_p"]) == {"strong", "border"}


def test_equivalence_is_claimed_at_the_corrected_level(spark, write):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.148, 60).round(4)
    p = write("e.json", scores(**{k: ([0.5] * 60, (0.5 + noise - noise.mean()).tolist()) for k in "uvwx"}))
    run = lambda c: api.audit_suite(spark, p, config=AuditConfig(n_resamples=4000, correction=c), model_b="B", model_a="A")
    numbers = {c: run(c).reports["u"].numbers for c in ("none", "bonferroni", "holm")}
    assert numbers["bonferroni"]["eq_low"] < numbers["none"]["eq_low"] and numbers["bonferroni"]["eq_high"] > numbers["none"]["eq_high"]
    assert numbers["holm"]["eq_low"] == numbers["bonferroni"]["eq_low"]
    means = resample.bootstrap_means(np.array([numbers["none"]["mean_b"]]), 1)  # draws of one value
    assert means[0] == numbers["none"]["mean_b"]


def preferences_of(spark, **wins):
    rows = [(m, f"e{i}", "j", w, False, i) for m, ws in wins.items() for i, w in enumerate(ws)]
    prefs = spark.createDataFrame(rows, "metric string, example_id string, judge string, winner string, is_tie boolean, row_ord bigint")
    models = spark.createDataFrame([(m, x, i) for m in wins for i, x in enumerate("AB")], "metric string, model string, model_ord int")
    return prefs, models


def test_preferences_of_a_suite_are_one_family(spark):
    prefs, models = preferences_of(spark, u="A" * 9 + "B", v="A" * 8 + "B")
    none = spark.createDataFrame([], "metric string, example_id string, model string, score double, ord bigint")
    s = api.audit_suite(spark, EvalFrames(none, models, preferences=prefs), config=AuditConfig(n_resamples=60, seed=2, correction="holm"))
    assert {m: t["alpha"] for m, t in s.tests.items()} == {"u": 0.025, "v": 0.05}
    assert {m: t["adjusted_p"] for m, t in s.tests.items()} == pytest.approx({"u": 0.04296875, "v": 0.04296875})
    assert all(next(f for f in r.findings if f.check == "preference_significance").details["significant"] for r in s.reports.values())
    both = spark.createDataFrame([(m, f"e{i}", x, float(x == "A"), i) for m in ("u", "v") for i in range(10) for x in "AB"], none.schema)
    with pytest.raises(ValueError, match="scores and of preferences"):
        api.audit_suite(spark, EvalFrames(both, models, preferences=prefs), config=AuditConfig(n_resamples=60, correction="holm"))


def ranked(spark, groups, n=12):
    rng = np.random.default_rng(5)
    rows = [("score", f"e{i}", m, float(v), i) for i in range(n) for m, v in zip("PQR", rng.normal([0.0, 0.2, 0.4], 1.0))]
    frames = spark.createDataFrame(rows, "metric string, example_id string, model string, score double, ord bigint")
    return rows, frames, spark.createDataFrame(groups, "example_id string, group_id string") if groups else None


def test_rank_stability_draws_whole_clusters_by_first_appearance(spark):
    groups = [(f"e{i}", "zyxw"[i % 4]) for i in range(10)]
    rows, frames, of = ranked(spark, groups)
    got = {(r["model"], r["rank"]): r for r in families.rank_stability_of(frames, 400, 7, of).collect()}
    label = {e: "g" + g for e, g in groups}
    names, table = [], np.zeros((12, 3))
    for _, e, m, v, i in rows:
        table[i, "PQR".index(m)] = v
    names = list(dict.fromkeys(label.get(f"e{i}", f"e{i}") for i in range(12)))
    sums = np.array([table[[i for i in range(12) if label.get(f"e{i}", f"e{i}") == g]].sum(axis=0) for g in names])
    sizes = np.array([sum(label.get(f"e{i}", f"e{i}") == g for i in range(12)) for g in names])
    rng, share = np.random.default_rng(7), np.zeros((3, 3))
    for _ in range(400):
        pick = rng.integers(0, len(names), size=len(names))
        means = sums[pick].sum(axis=0) / sizes[pick].sum()
        for place, j in enumerate(np.argsort(-means, kind="stable")):
            share[j, place] += 1 / 400
    assert len(names) == 6 and all(got["PQR"[j], p + 1]["occupancy"] == pytest.approx(share[j, p]) and got["PQR"[j], p + 1]["units"] == 6 for j in range(3) for p in range(3))


def test_pairs_and_slices_of_any_scores(spark):
    """Pairs of scores of 0 and 1 are tested by counts, others by seeded permutations."""
    rng = np.random.default_rng(9)
    values = {"P": rng.normal(1, 1, 40), "Q": (rng.random(40) < 0.5) * 1.0, "R": (rng.random(40) < 0.8) * 1.0}
    cells_ = spark.createDataFrame([("score", f"e{i:02d}", m, float(v[i]), i) for m, v in values.items() for i in range(40)], "metric string, example_id string, model string, score double, ord bigint")
    got = {(r["model_a"], r["model_b"]): r for r in families.all_pairs(cells_, 300, 5).collect()}
    order = sorted(values, key=lambda m: -values[m].mean())
    for n, (a, b) in enumerate([(order[0], order[1]), (order[0], order[2]), (order[1], order[2])]):
        d = values[b] - values[a]
        if "P" in (a, b):
            want = ("permutation", resample.permutation_p(d if d.mean() >= 0 else -d, 300, 5 + n))
        else:
            want = ("mcnemar", special.binomial_two_sided(int((d > 0).sum()), int((d != 0).sum())))
        assert got[a, b]["test"] == want[0] and got[a, b]["p_value"] == pytest.approx(want[1]) and got[a, b]["ord"] == n
    d = values["Q"] - values["P"]
    pairs = spark.createDataFrame([(i, float(values["P"][i]), float(values["Q"][i]), float(d[i]), "xyz"[min(i // 18, 2)]) for i in range(40)], "ord bigint, score_a double, score_b double, diff double, kind string")
    sliced = {r["slice"]: r for r in families.slices(pairs, "kind", times=200, seed=3).collect()}
    for n, (name, lo, hi) in enumerate([("x", 0, 18), ("y", 18, 36)]):
        own = d[lo:hi]
        assert sliced[name]["p_value"] == pytest.approx(resample.permutation_p(own if own.mean() >= 0 else -own, 200, 3 + n)) and sliced[name]["k"] == 2
    assert sliced["z"]["p_value"] is None and not sliced["z"]["tested"] and sliced["z"]["n"] == 4


def test_reasons_why_ranks_are_not_resampled(spark):
    cfg = AuditConfig(n_resamples=50, all_pairs=True)
    _, frames, of = ranked(spark, [(f"e{i}", "one") for i in range(12)])
    order = lambda *names: spark.createDataFrame([("score", m, i) for i, m in enumerate(names)], "metric string, model string, model_ord int")
    reason = lambda data: next(f.details.get("reason") for f in pair_findings(data, cfg) if f.check == "rank_stability")
    assert reason(EvalFrames(frames, order("P", "Q", "R"))) is None
    assert reason(EvalFrames(frames, order("P", "Q", "R"), groups=of)) == "fewer_than_two_units"
    assert reason(EvalFrames(frames, order("P", "Q", "R", "S"))) == "zero_score_model"
    assert reason(EvalFrames(frames.where("model <> 'R'"), order("P", "Q"))) == "fewer_than_three_models"


def test_reruns_are_predicted_from_eligible_examples(spark):
    streams = {
        "both": ({"P": 1.5, "Q": 2.0}, {"P": [1.0, 2.0], "Q": [2.0, 2.0, 2.0]}), "other": ({"P": 0.0, "Q": 1.0}, {"P": [0.0, 0.0], "Q": [0.5, 1.5]}),
        "no a": ({"Q": 1.0}, {"P": [1.0], "Q": [1.0]}), "no runs b": ({"P": 1.0, "Q": 1.0}, {"P": [1.0, 1.0]}), "odd": ({"P": 1.0, "Q": 1.0}, {"P": [float("inf"), 1.0], "Q": [1.0, 1.0]}),
        "apart": ({"P": 1.0, "Q": 1.0}, {"P": [1.0, 2.0], "Q": [1.0, 1.0]}), "single": ({"P": 1.0, "Q": 3.0}, {"P": [1.0], "Q": [2.0, 4.0]}),
    }
    cells_ = spark.createDataFrame([("score", e, m, v) for e, (s, _) in streams.items() for m, v in s.items()], "metric string, example_id string, model string, score double")
    runs = spark.createDataFrame([("score", e, m, i, v) for e, (_, r) in streams.items() for m, vs in r.items() for i, v in enumerate(vs)], "metric string, example_id string, model string, run_idx int, score double")
    r = health.rerun_prediction(health.rerun_eligible(cells_, runs, "P", "Q"), 2).first().asDict()
    assert (r["n_total"], r["n"]) == (7, 2) and [r[k] for k in health.REASONS] == [1, 1, 1, 0, 1, 1]
    q = [0.5 * (1 / 2 + 1 / 2), 0.0, 0.0, 0.5 * (1 / 2 + 1 / 2)]
    assert r["mean_gap"] == pytest.approx(0.75) and r["variance"] == pytest.approx(sum(q) / 4) and r["df"] == pytest.approx(sum(q) ** 2 / sum(x * x for x in q))
    f = predictive_rerun(r, "P", "Q", 2)
    assert f.status == "pass" and f.details["range_low"] < 0.75 < f.details["range_high"] and f.details["reason_counts"]["nonfinite_a"] == 1
    alone = health.rerun_prediction(health.rerun_eligible(cells_.where("example_id = 'no a'").union(spark.createDataFrame([("score", "no a", "P", 1.0)], cells_.schema)), runs.where("example_id = 'no a'"), "P", "Q"), 2).first().asDict()
    assert alone["degenerate"] == "single_run" and predictive_rerun(alone, "P", "Q", 2).details["probability_a_better"] is None
    assert predictive_rerun(None, "P", "Q", 2).status == "skip"


def test_win_rate_of_clusters_by_first_appearance(spark, write):
    rng = np.random.default_rng(2)
    examples = [{"id": f"e{i:02d}", "scores": {"A": float(rng.integers(0, 3)), "B": float(rng.integers(0, 3))}} | ({"group_id": "cab"[i % 3]} if i < 12 else {}) for i in range(16)]
    r = api.audit(spark, write("w.json", {"models": ["A", "B"], "examples": examples}), config=AuditConfig(win_rate=True, seed=4, n_resamples=500), model_b="B", model_a="A")
    d = next(f for f in r.findings if f.check == "paired_win_rate").details
    credit = [1.0 if e["scores"]["A"] > e["scores"]["B"] else 0.5 if e["scores"]["A"] == e["scores"]["B"] else 0.0 for e in examples]
    clusters: dict = {}
    for e, c in zip(examples, credit):
        clusters.setdefault(e.get("group_id", e["id"]), []).append(c)
    s, n = np.array([sum(c) for c in clusters.values()]), np.array([len(c) for c in clusters.values()])
    draw = np.random.default_rng(4)
    means = [s[k].sum() / n[k].sum() for k in (draw.integers(0, len(s), size=len(s)) for _ in range(500))]
    assert d["n_resampling_units"] == 7 and d["clustered"] and (d["ci_low"], d["ci_high"]) == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_near_matches_equal_the_alignment_of_all_pairs(spark):
    from difflib import SequenceMatcher

    from gaugeflow.operators import contamination

    rng = np.random.default_rng(6)
    word = lambda: "".join("abcdefg"[k] for k in rng.integers(0, 7, int(rng.integers(2, 7))))
    bench = [" ".join(word() for _ in range(int(rng.integers(1, 9)))) for _ in range(40)] + ["", None]
    other = []
    for t in bench[:30]:
        w = t.split()
        if len(w) > 2:
            w[int(rng.integers(0, len(w)))] = word()
        other.append(" ".join(w))
    other += [" ".join(word() for _ in range(5)) for _ in range(30)] + [bench[39], None]
    make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    want = {i for i, t in enumerate(bench) if t is not None and t not in other and any(o is not None and (not t + o or SequenceMatcher(None, t, o).ratio() >= 0.7) for o in other)}
    for limit in (1 << 20, 200):
        got = [r["id"] for r in contamination.near_matches(make(bench), make(other), 0.7, broadcast_limit=limit).collect()]
        assert sorted(got) == sorted(want) and 5 < len(want) < 40
    assert contamination.near_matches(make(bench), make(other).limit(0)).count() == 0 == contamination.near_matches(make(bench).limit(0), make(other)).count()


def test_poisson_weights_make_an_interval_like_the_exact_one(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.3, 1.0, 3000)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "metric string, id bigint, diff double")
    one = resample.poisson_bootstrap(df, ["metric"], "id", times=2000).first()
    assert one == resample.poisson_bootstrap(df.repartition(3, "id"), ["metric"], "id", times=2000).first() or one["ci_low"] == pytest.approx(resample.poisson_bootstrap(df.repartition(3, "id"), ["metric"], "id", times=2000).first()["ci_low"])
    exact = resample.interval(resample.bootstrap_means(x, 2000))
    assert (one["ci_low"], one["ci_high"]) == pytest.approx(exact, abs=0.006)
    w = resample.poisson_weights(np.arange(4000), 50)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.03)


def test_single_model_threshold_and_failure_codes(spark, write):
    p = write("one.csv", "id,model,score\n" + "".join(f"{i},m,{i % 4 > 0:d}\n" for i in range(80)))
    r = api.audit(spark, p, threshold=0.5, config=AuditConfig(n_resamples=300))
    assert {f.check: f.details.get("outcome") for f in r.findings}["threshold"] == "above"
    assert cli.main(["audit", p, "--threshold", "0.99", "--n-resamples", "100", "--fail-under", "moderate"], spark) == 1
    with pytest.raises(NotTrusted):
        api.audit(spark, p, threshold=0.99, config=AuditConfig(n_resamples=100)).raise_if_below("high")


def test_run_level(spark, write):
    wide = write("w.csv", "run,A,B\n" + "".join(f"{i},{70 + i % 5},{60 + i % 4}\n" for i in range(12)))
    found = {f.check: f for f in api.audit_run_level(spark, wide, n_resamples=200)}
    assert found["decision"].status == "pass" and found["precision"].status == "pass" and found["effect_size"].details["common_language_effect_size"] == 1.0
    lists = write("l.json", {"A": [1, 2, 3], "B": [1, 2]})
    runs, a, b = load.load_run_level(spark, lists)
    assert (a, b, runs.count()) == ("A", "B", 5)
    with pytest.raises(ValueError, match="finite"):
        load.load_run_level(spark, write("x.json", {"A": [1, True], "B": [1]}))


def test_contamination_command(spark, write, capsys):
    a = write("a.jsonl", '{"text": "The quick brown fox jumps."}\n{"text": "Nothing like it at all"}\n{"other": 1}\n')
    b = write("b.jsonl", '{"text": "the QUICK brown fox jumps"}\n{"text": "nothing like it at ale"}\n')
    assert cli.main(["contamination", a, b, "--json"], spark) == 1
    r = json.loads(capsys.readouterr().out)
    assert (r["exact"], r["near"], r["total"], r["missing"]) == (1, 1, 2, 1)


def test_verdict_lattice_and_plain_values():
    f = lambda c, s, **d: Finding("p", c, c, s, "", "", "", d)
    assert verdict([]).level == verdict([f("a", "skip")]).level == "LOW"
    assert verdict([f("a", "pass"), f("b", "skip")]).level == "HIGH"
    v = verdict([f("decision", "warn", outcome="equivalent"), f("b", "pass")])
    assert v.level == "MODERATE" and "equal" in v.summary and [d.check for d in v.drivers] == ["decision"]
    assert verdict([f("a", "fail"), f("b", "warn")]).level == "LOW"
    assert plain({"x": float("inf"), "y": [float("nan"), 1.5]}) == {"x": None, "y": [None, 1.5]}


def test_config(tmp_path):
    with pytest.raises(ValueError, match="alpha"):
        AuditConfig.of({"alhpa": 1})
    with pytest.warns(UserWarning):
        AuditConfig.of({"nonsense": 1}, strict=False)
    for bad in ({"run_aware": True}, {"score_ceiling": 0.0}, {"gated_metrics": "x"}, {"correction": "fdr"}):
        with pytest.raises(ValueError):
            AuditConfig(**bad)
    (tmp_path / "pyproject.toml").write_text("[tool.gaugeflow]\nalpha = 0.01\n")
    assert AuditConfig.load(start=str(tmp_path)).alpha == 0.01


def test_streamed_totals_equal_the_batch(spark, tmp_path):
    from gaugeflow.operators.records import score_cells
    from gaugeflow.streaming.incremental import ScoreTotals

    ddl = "metric string, example_id string, model string, judge string, score double, row_ord bigint"
    rows = [("m", f"e{i % 7}", "AB"[i % 2], None, float(i % 3), i) for i in range(60)]
    records = spark.createDataFrame(rows, ddl)
    records.repartition(3).write.parquet(str(tmp_path / "in"))
    t = ScoreTotals(spark, str(tmp_path / "totals"))
    t.start(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    key = lambda df: sorted((r["example_id"], r["model"], round(r["score"], 9)) for r in df.collect())
    assert key(t.cells()) == key(score_cells(records))
    t.apply(records.limit(0), 99)
    assert key(t.cells()) == key(score_cells(records))


def test_documents_are_read_once_and_worked_on_by_all_tasks(spark, write):
    """After its split, nothing reads the document again, and its elements are in several files."""
    raw = {"models": ["A", "B"], "examples": [{"id": i, "scores": {"A": i, "B": 1}, "runs": {"A": [i, 1], "B": [1, 1]}, "group_id": "g"} for i in range(200)]}
    data = load.load_suite(spark, write("one.json", raw))
    for part in (data.cells, data.runs, data.groups):
        assert not any("one.json" in f for f in part.inputFiles()) and len(part.inputFiles()) > 1
    assert data.cells.count() == 400 and data.runs.count() == 800 and data.groups.count() == 200


def test_a_document_is_written_line_by_line(spark, tmp_path):
    from gaugeflow import source_queries

    for n in (0, 1, 30_000):
        spark.range(n).selectExpr("id AS c_custkey").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/sf/customer.parquet")
        path = source_queries._document(spark, f"{tmp_path}/sf", "lines", "named_struct('k', c_custkey)", '{"a": [', "]}")
        text = spark.read.text(path, wholetext=True).collect()
        assert len(text) == 1 and json.loads(text[0]["value"]) == {"a": [{"k": i} for i in range(n)]}
