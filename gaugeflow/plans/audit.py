"""Audits: from evaluation tables to findings and a verdict.

Each check is one aggregation over the tables, of which a row or a few reach the driver;
resampling runs in one grouped job for all metrics. Findings come in a fixed order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scores import magnitude_of
from ..operators import families, health, judges, multiplicity, preferences, records, resample, twosample
from ..operators.pairing import paired
from . import kernels
from .config import AuditConfig
from .data import EvalFrames
from .findings import LEVELS, METHODOLOGY_VERSION, SCHEMA_VERSION, Finding, Verdict, plain, verdict

VALIDITY, HEALTH, REPEAT, JUDGES = "Statistical Validity", "Benchmark Health", "Repeatability", "Judge Reliability"
FEW = 100_000  # decisive preferences whose draws are made one by one
PREFERENCE, SLICES, PAIRS, QUALITY, SCORE = "Pairwise Preference", "Per-slice Comparison", "All-pairs Comparison", "Data Quality", "Score Reliability"


@dataclass(frozen=True)
class Report:
    findings: list[Finding]
    verdict: Verdict
    models: list[str]
    source_format: str = "dataframe"
    numbers: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return plain({
            "models": self.models, "verdict": self.verdict.to_dict(), "source_format": self.source_format, "findings": [f.to_dict() for f in self.findings],
            "methodology_version": METHODOLOGY_VERSION, "schema_version": SCHEMA_VERSION,
        })

    def raise_if_below(self, minimum: str) -> None:
        self.verdict.raise_if_below(minimum)

    def frame(self, spark) -> DataFrame:
        import json

        rows = [(i, f.pillar, f.check, f.title, f.status, f.why, f.how_detected, f.how_to_fix, json.dumps(plain(f.details), sort_keys=True)) for i, f in enumerate(self.findings)]
        return spark.createDataFrame(rows, "ord int, pillar string, check string, title string, status string, why string, how_detected string, how_to_fix string, details_json string")


@dataclass(frozen=True)
class SuiteReport:
    """``tests`` has for each metric its p value, the adjusted one, whether it is rejected
    and the level that it was held to."""

    reports: dict[str, Report]
    correction: str
    tests: dict[str, dict]
    gates: frozenset[str]
    alpha: float = 0.05
    corrected_alpha: float = 0.05

    @property
    def level(self) -> str:
        """A gated metric that isn't HIGH makes the suite LOW; else the weakest decides."""
        return overall({m: r.verdict.level for m, r in self.reports.items()}, self.gates)

    def to_dict(self) -> dict:
        each = lambda key: {m: t[key] for m, t in self.tests.items()}
        return plain({
            "correction": self.correction, "overall_level": self.level, "metric_alphas": each("alpha"), "corrected_alpha": self.corrected_alpha, "tests": self.tests,
            "adjusted_p": each("adjusted_p"), "alpha": self.alpha, "applied_weights": {}, "applied_gates": sorted(self.gates & set(self.reports)),
            "methodology_version": METHODOLOGY_VERSION, "schema_version": SCHEMA_VERSION, "metrics": {name: report.to_dict() for name, report in self.reports.items()},
        })

    def raise_if_below(self, minimum: str) -> None:
        Verdict(self.level, "", []).raise_if_below(minimum, "the suite")


def overall(levels: dict[str, str], gates=frozenset()) -> str:
    """The level of a suite from those of its metrics."""
    if any(m in gates and level != "HIGH" for m, level in levels.items()):
        return "LOW"
    return min(levels.values(), key=LEVELS.index, default="LOW")


def _skip(pillar: str, check: str, reason: str, need: str) -> Finding:
    return Finding(pillar, check, f"{check.replace('_', ' ').capitalize()} not assessed", "skip", need, reason.replace("_", " ").capitalize() + ".", need, {"assessed": False, "reason": reason})


def _pairs(data: EvalFrames, a: str, b: str) -> DataFrame:
    two = paired(data.cells, a, b)
    order = data.cells.groupBy("metric", "example_id").agg(F.min("ord").alias("ord"))
    two = two.join(order, ["metric", "example_id"])
    if data.groups is None:
        return two.withColumn("cluster", F.lit(None).cast("string"))
    key = F.when(F.col("group_id").isNull(), F.concat(F.lit("i"), "example_id")).otherwise(F.concat(F.lit("g"), "group_id"))
    return two.join(data.groups.select("example_id", "group_id"), "example_id", "left").withColumn("cluster", key).drop("group_id")


@dataclass(frozen=True)
class Facts:
    """What the findings about a pair rest on: a row of each kind per metric, all metrics of
    a kind in one job."""

    numbers: dict[str, dict]
    saturation: dict[str, dict] = field(default_factory=dict)
    discrimination: dict[str, dict] = field(default_factory=dict)
    reruns: dict[str, dict] = field(default_factory=dict)
    predictions: dict[str, dict] = field(default_factory=dict)
    wins: dict[str, dict] = field(default_factory=dict)
    win_intervals: dict[str, dict] = field(default_factory=dict)
    votes: dict[str, dict] = field(default_factory=dict)
    votes_by_judge: dict[str, dict] = field(default_factory=dict)
    judges: dict[str, list[str]] = field(default_factory=dict)


def _by_metric(rows: DataFrame | None) -> dict[str, dict]:
    return {r["metric"]: r.asDict() for r in rows.collect()} if rows is not None else {}


def facts(data: EvalFrames, a: str, b: str, cfg: AuditConfig, alphas: list[float] | None = None) -> Facts:
    by, pairs, clustered = ["metric"], _pairs(data, a, b), data.groups is not None
    runs, prefs = data.runs, data.preferences
    numbers = _by_metric(kernels.compare(pairs, alphas or [cfg.alpha], 0.95, cfg.n_resamples, cfg.seed, clustered))
    predicted = health.rerun_prediction(health.rerun_eligible(data.cells, runs, a, b), cfg.run_aware_future_runs) if cfg.run_aware and runs is not None else None
    wins = preferences.win_rate(pairs, by) if cfg.bayesian or cfg.win_rate else None
    intervals = None
    if cfg.win_rate:
        credit = pairs.withColumn("diff", F.when(F.col("diff") < 0, 1.0).when(F.col("diff") == 0, 0.5).otherwise(0.0))
        intervals = resample.clustered_mean_test(credit, by, "cluster", times=cfg.n_resamples, seed=cfg.seed, order="ord", test=False) if clustered else resample.exact_mean_test(credit, by, "ord", times=cfg.n_resamples, seed=cfg.seed, test=False)
    each: dict[str, dict] = {}
    for r in preferences.judge_tallies(prefs, a, b, by).collect() if prefs is not None else []:
        each.setdefault(r["metric"], {})[r["judge"]] = [r["wins_a"], r["wins_b"], r["ties"]]
    judged: dict[str, list[str]] = {}
    for r in data.judges.groupBy("metric", "judge").agg(F.min("judge_ord").alias("o")).orderBy("metric", "o", "judge").collect() if data.judges is not None else []:
        judged.setdefault(r["metric"], []).append(r["judge"])
    return Facts(
        numbers, _by_metric(health.saturation(data.cells, cfg.score_ceiling, cfg.saturation_fraction)), _by_metric(health.discrimination(data.cells, cfg.min_spread)),
        _by_metric(health.rerun_stability(health.run_gaps(runs, a, b)) if runs is not None else None), _by_metric(predicted), _by_metric(wins), _by_metric(intervals),
        _by_metric(preferences.sign_test(preferences.tallies(prefs, a, b, by)) if prefs is not None else None), each, judged,
    )


def statistical(x: dict, a: str, b: str, cfg: AuditConfig, significant: bool | None = None) -> list[Finding]:
    lead, trail = (b, a) if x["mean_diff"] >= 0 else (a, b)
    significant = x["p_value"] < cfg.alpha if significant is None else significant
    equal = x["eq_low"] > -cfg.equivalence_margin and x["eq_high"] < cfg.equivalence_margin
    outcome = "significant" if significant else "equivalent" if equal else "inconclusive"
    title = {"significant": f"{lead} beats {trail}", "equivalent": f"{lead} and {trail} are practically equal", "inconclusive": f"No clear winner between {lead} and {trail}"}[outcome]
    decision = Finding(
        VALIDITY, "decision", title, {"significant": "pass", "equivalent": "warn", "inconclusive": "fail"}[outcome], "A gap that chance explains is no reason to prefer a model.",
        f"{x['test']}: p = {x['p_value']:.4g}; the gap lies in [{x['ci_low']:.4g}, {x['ci_high']:.4g}] over {x['n']} paired examples.", "Add examples until the interval leaves 0 or fits the margin.",
        {"outcome": outcome, "p_value": x["p_value"], "alpha": cfg.alpha, "ci_low": x["ci_low"], "ci_high": x["ci_high"], "test": x["test"], "leader": lead, "n": x["n"]},
    )
    kind = {"binary": "h", "ordinal": "r", "continuous": "d"}[x["domain"]]
    size = magnitude_of(x["effect"], kind)
    named = {"h": {"risk_difference": abs(x["mean_diff"]), "cohens_h": x["effect"]}, "r": {"rank_biserial": x["effect"], "prob_superiority": x["superiority"], "scale_levels": x["levels"]}, "d": {"cohens_d": x["effect"]}}[kind]
    effect = Finding(
        VALIDITY, "effect_size", f"The effect is {size}", "pass" if size in ("medium", "large") else "warn", "A real difference may still be too small to matter.",
        f"{next(reversed(named)) if kind == 'h' else next(iter(named))} = {x['effect']:.4g}, {size}.", "Weigh the size against what switching costs.", named | {"magnitude": size, "ci_low": x["effect_low"], "ci_high": x["effect_high"]},
    )
    conclusive = outcome != "inconclusive"
    least = special.detectable_effect(x["n"], cfg.power_target, cfg.alpha)
    need = special.required_n(cfg.smallest_meaningful_effect, cfg.power_target, cfg.alpha)
    precision = Finding(
        VALIDITY, "precision", "Enough examples to conclude" if conclusive else "Too few examples to conclude", "pass" if conclusive else "warn", "Small samples only show large effects.",
        f"{x['n']} pairs find effects from {least:.3g} standard deviations.", "Nothing to do." if conclusive else f"Use {need} examples, {max(0, need - x['n'])} more, to find an effect of {cfg.smallest_meaningful_effect:g}.",
        {"n": x["n"], "minimum_detectable_effect": least, "conclusive": conclusive, "required_n": need},
    )
    return [decision, effect, precision]


def data_quality(metadata: dict) -> list[Finding]:
    out = []
    if metadata.get("skipped_rows"):
        out.append(Finding(QUALITY, "data_quality", "Some rows could not be read", "warn", "What was left out may differ from what was kept.", f"{metadata['skipped_rows']} rows had no readable score.", "Repair these rows.", {"skipped_rows": metadata["skipped_rows"], "kept": metadata.get("kept")}))
    if metadata.get("unmatched_examples"):
        out.append(Finding(QUALITY, "pairing_coverage", "Some examples have no partner", "warn", "Only examples with both scores are compared.", f"{metadata['unmatched_examples']} examples are in one file only.", "Score both models on the same examples.", {"unmatched_examples": metadata["unmatched_examples"], "kept": metadata.get("kept")}))
    return out


def benchmark_health(s: dict | None, d: dict | None, cfg: AuditConfig) -> list[Finding]:
    if s is None or d is None or s["top_mean"] is None:
        return []
    source = "configured" if cfg.score_ceiling is not None else "observed"
    return [
        Finding(HEALTH, "saturation", "The benchmark is nearly solved" if s["saturated"] else "The benchmark has headroom", "warn" if s["saturated"] else "pass", "Near the ceiling models can't be told apart.", f"The best mean is {s['top_mean']:.4g} of {s['ceiling']:.4g}.", "Add harder examples.", {"ceiling": s["ceiling"], "ceiling_source": source, "observed_max": s["observed_max"], "top_mean": s["top_mean"], "fraction_of_ceiling": s["fraction_of_ceiling"], "saturated": s["saturated"]}),
        Finding(HEALTH, "discrimination", "Scores vary" if d["discriminating"] else "Scores hardly vary", "pass" if d["discriminating"] else "warn", "Examples that all score alike carry no information.", f"The pooled deviation is {d['pooled_std']:.4g}.", "Replace examples that every model solves or fails.", {"pooled_std": d["pooled_std"], "discriminating": d["discriminating"]}),
    ]


def repeatability(r: dict | None) -> list[Finding]:
    if r is None:
        return [_skip(REPEAT, "repeatability", "no_repeated_runs", "Run every example at least twice with both models.")]
    return [
        Finding(REPEAT, "rerun_stability", "Reruns agree on the leader" if r["flips"] == 0 else "Reruns change the leader", r["stability_status"], "A leader that changes from run to run is no leader.", f"{r['flips']} of {r['runs']} runs point the other way.", "Average more runs.", {"runs": r["runs"], "flips": r["flips"], "stability": 1 - r["flips"] / r["runs"], "mean_gap": r["mean_gap"]}),
        Finding(REPEAT, "measurement_variance", "Noise is below the gap" if r["variance_status"] == "pass" else "Noise is as large as the gap", r["variance_status"], "Noise between runs hides small gaps.", f"The gap is {r['mean_gap']:.4g}, its deviation over runs {r['gap_std']:.4g}.", "Average more runs or lower the temperature.", {"gap_std": r["gap_std"], "mean_gap": r["mean_gap"], "snr": math.inf if r["snr"] is None else r["snr"]}),
    ]


def judge_findings(cells: DataFrame | None, order: list[str], a: str, b: str, cfg: AuditConfig) -> list[Finding]:
    """``order`` has the judges by first appearance."""
    if len(order) < 2:
        out = [_skip(JUDGES, "judge_reliability", "one_judge" if order else "no_judges", "Score with two or more judges.")]
        return out
    out = []
    each = judges.consensus(cells, a, b).collect()
    if len(each) < 2:
        out.append(_skip(JUDGES, "judge_consensus", "fewer_than_two_usable_judges", "Let every judge score both models."))
    else:
        ok = each[0]["unanimous"]
        out.append(Finding(JUDGES, "judge_consensus", "Judges name the same winner" if ok else "Judges disagree on the winner", "pass" if ok else "fail", "A winner that depends on the judge isn't one.", f"{len(each)} judges compared both models.", "Find out why judges differ.", {"per_judge_winner": {r["judge"]: r["winner"] for r in each}, "unanimous": ok, "skipped_judges": [j for j in order if j not in {r["judge"] for r in each}]}))
    common = judges.common_items(cells)
    agreement = judges.percent_agreement(common).first()["percent_agreement"]
    if agreement is None:
        out.append(_skip(JUDGES, "inter_judge_agreement", "no_common_items", "Let judges score the same items."))
    else:
        levels = common.agg(F.countDistinct("score").alias("n"), F.bool_and(F.abs(F.col("score") - F.rint("score")) <= 1e-9).alias("whole")).first()
        kappa = judges.fleiss_kappa(common).first()["fleiss_kappa"] if levels["n"] <= 10 and levels["whole"] else None
        odd = next((r["judge"] for r in judges.outlier_judge(common).where("is_outlier").collect()), None)
        ok = agreement >= cfg.judge_agreement_threshold
        out.append(Finding(JUDGES, "inter_judge_agreement", "Judges agree" if ok else "Judges disagree", "pass" if ok else "warn", "Scores that judges don't share measure the judge.", f"Pairs of judges agree on {agreement:.1%} of items.", "Sharpen the rubric.", {"percent_agreement": agreement, "fleiss_kappa": kappa, "outlier_judge": odd if len(order) > 2 else None}))
    reference = cfg.reference_judge or next((j for j in order if j.lower() in judges.REFERENCE_NAMES), None)
    if reference is not None:
        values = judges.against(cells, reference).agg(F.bool_and(F.col("score").isin(0.0, 1.0) & F.col("reference_score").isin(0.0, 1.0)).alias("b")).first()["b"]
        if values:
            found = {r["judge"]: r["accuracy"] for r in judges.calibration_exact(cells, reference).collect()}
            floor, name = cfg.judge_agreement_threshold, "accuracies"
        else:
            found = {r["judge"]: r["spearman"] for r in judges.calibration_spearman(cells, reference).collect()}
            floor, name = cfg.judge_correlation_threshold, "correlations"
        known = {j: found[j] for j in order if found.get(j) is not None}
        if not known:
            out.append(_skip(JUDGES, "judge_calibration", "not_measurable", "Let judges score items that the reference scored."))
        else:
            worst = min(known, key=known.get)
            ok = known[worst] >= floor
            out.append(Finding(JUDGES, "judge_calibration", "Judges follow the reference" if ok else f"{worst} departs from the reference", "pass" if ok else "warn", "A judge is worth as much as it agrees with the truth.", f"The worst of {len(known)} judges reaches {known[worst]:.3g}.", "Replace or instruct this judge.", {"reference": reference, name: known, "worst_judge": worst, "worst_value": known[worst]}))
    return out


def preference_findings(t: dict | None, each: dict | None, a: str, b: str, cfg: AuditConfig, significant: bool | None = None) -> list[Finding]:
    """``t`` is the sign test of the examples, ``each`` has the tallies by judge."""
    if not each:
        return []
    if t is None or not t["n_decisive"]:
        return [_skip(PREFERENCE, "preference", "all_ties" if t else "none_relevant", "Collect judgements that name a winner.")]
    n = t["n_decisive"]
    wins = resample.bootstrap_means(np.repeat([1.0, 0.0], [t["wins_a"], t["wins_b"]]), cfg.n_resamples, cfg.seed) if n <= FEW else resample.binary_means(t["wins_a"], n, cfg.n_resamples, cfg.seed)
    lo, hi = resample.interval(wins)
    significant = t["p_value"] < cfg.alpha if significant is None else significant
    lead = a if t["wins_a"] >= t["wins_b"] else b
    base = {"wins_a": t["wins_a"], "wins_b": t["wins_b"], "ties": t["ties"], "n_decisive": n, "n_judged_examples": t["n_judged"], "per_judge": each, "aggregation": "majority"}
    return [
        Finding(PREFERENCE, "preference_significance", f"{lead} is preferred" if significant else "No clear preference", "pass" if significant else "fail", "Preferences scatter like scores do.", f"Sign test over {n} decisive examples: p = {t['p_value']:.4g}.", "Collect more judgements.", base | {"p_value": t["p_value"], "alpha": cfg.alpha, "significant": significant, "outcome": "significant" if significant else "inconclusive", "test": "sign"}),
        Finding(PREFERENCE, "preference_effect", f"The preference is {t['magnitude']}", "pass" if t["magnitude"] in ("medium", "large") else "warn", "A slight preference may not matter.", f"{a} wins {t['win_rate_a']:.1%} of decisive examples.", "Weigh the size against what switching costs.", base | {"win_rate_a": t["win_rate_a"], "cohens_g": t["cohens_g"], "magnitude": t["magnitude"], "ci_low": lo, "ci_high": hi, "confidence": 0.95, "seed": cfg.seed}),
    ]


def predictive_rerun(r: dict | None, a: str, b: str, future: int, central: float = 0.95) -> Finding:
    """Where the mean gap of ``future`` new runs would fall, by normal theory; ``r`` is a row
    of ``health.rerun_prediction``."""
    counts = {k: r[k] if r else 0 for k in health.REASONS}
    base = {"model_a": a, "model_b": b, "n_total": r["n_total"] if r else 0, "n_predictive": r["n"] if r else 0, "reason_counts": counts, "future_runs": future, "central_mass": central}
    if not base["n_predictive"]:
        return replace(_skip(VALIDITY, "predictive_rerun", "nothing_eligible", "Run every example with both models, and let scores be the means of their runs."), details={"assessed": False, "reason": "nothing_eligible"} | base)
    gap = r["mean_gap"]
    if r["degenerate"]:
        low, high, p, how = gap, gap, None, f"Without spread between runs ({r['degenerate'].replace('_', ' ')}) there is a point only."
    else:
        se, edge = math.sqrt(r["variance"]), special.t_ppf((1 + central) / 2, r["df"])
        low, high, p, how = gap - edge * se, gap + edge * se, special.t_cdf(-gap / se, r["df"]), "Normal theory with Welch-Satterthwaite degrees of freedom."
    details = base | {"assessed": True, "point_estimate_b_minus_a": gap, "range_low": low, "range_high": high, "probability_a_better": p, "degenerate_reason": r["degenerate"], "prediction_variance": r["variance"], "degrees_of_freedom": r["df"]}
    return Finding(VALIDITY, "predictive_rerun", f"{future} new runs would give {low:.4g} to {high:.4g}", "pass", "One evaluation is one draw of many.", f"{how} {r['n']} of {r['n_total']} examples could be used.", "Nothing to do.", details)


def win_findings(w: dict | None, t: dict | None, a: str, b: str, cfg: AuditConfig, clustered: bool) -> list[Finding]:
    """``w`` has the counts of wins, ``t`` the interval of the win rate."""
    out = []
    if cfg.bayesian:
        if w is None or w["wins_a"] + w["wins_b"] == 0:
            out.append(_skip(VALIDITY, "bayesian_win_probability", "no_decisive_pair", "Add examples on which the models differ."))
        else:
            p, lo, hi = special.win_posterior(w["wins_a"], w["wins_b"])
            out.append(Finding(VALIDITY, "bayesian_win_probability", f"{a} is better with probability {p:.3g}", "pass", "A probability is easier to act on than a p value.", "Beta posterior of the win rate under the Jeffreys prior.", "Nothing to do.", {"wins_a": w["wins_a"], "wins_b": w["wins_b"], "ties": w["ties"], "n_decisive": w["wins_a"] + w["wins_b"], "probability_a_better": p, "ci_low": lo, "ci_high": hi}))
    if cfg.win_rate:
        if w is None or t is None:
            out.append(_skip(VALIDITY, "paired_win_rate", "no_paired_scores", "Score both models on the same examples."))
        else:
            units = t["n_clusters"] if clustered else w["n"]
            details = {"model_a": a, "model_b": b, "win_rate_a": w["win_rate_a"], "wins_a": w["wins_a"], "wins_b": w["wins_b"], "ties": w["ties"], "n": w["n"], "ci_low": t["ci_low"], "ci_high": t["ci_high"], "confidence": 0.95, "tie_policy": "half", "method": "percentile bootstrap of clusters" if clustered else "percentile bootstrap", "seed": cfg.seed, "clustered": clustered, "n_resampling_units": units}
            out.append(Finding(VALIDITY, "paired_win_rate", f"{a} wins {w['win_rate_a']:.1%} of examples", "pass", "Win rates don't depend on the scale of scores.", "Ties count for half.", "Nothing to do.", details))
    return out


def _rank_skip(data: EvalFrames) -> str | None:
    """Why ranks can't be resampled, if they can't."""
    declared = data.model_names()
    scored = {r["model"]: r["n"] for r in data.cells.groupBy("model").agg(F.count("score").alias("n")).collect()}
    if not scored:
        return "preference_only" if data.preferences is not None else "no_examples"
    if len(set(declared) | set(scored)) < 3:
        return "fewer_than_three_models"
    return "zero_score_model" if any(not scored.get(m) for m in declared) else None


def pair_findings(data: EvalFrames, cfg: AuditConfig) -> list[Finding]:
    tests = families.all_pairs(data.cells, cfg.n_resamples, cfg.seed)
    if cfg.correction == "holm":
        done = multiplicity.holm(tests, alpha=cfg.alpha).withColumnsRenamed({"holm_p": "adjusted", "holm_reject": "separable"})
    elif cfg.correction == "bonferroni":
        done = multiplicity.bonferroni(tests, alpha=cfg.alpha).withColumnsRenamed({"bonferroni_p": "adjusted", "bonferroni_reject": "separable"})
    else:
        done = multiplicity.uncorrected(tests, alpha=cfg.alpha).withColumn("adjusted", F.col("p_value")).withColumnRenamed("reject", "separable")
    rows = [r.asDict() for r in done.orderBy("ord").select("model_a", "model_b", "n", "mean_diff", "test", "p_value", "adjusted", "separable").collect()]
    if not rows:
        return [_skip(PAIRS, "all_pairs", "no_paired_scores", "Score several models on the same examples.")]
    k = sum(r["separable"] for r in rows)
    out = [Finding(PAIRS, "all_pairs", f"{k} of {len(rows)} pairs can be told apart", "pass", "With many models some gaps look large by chance.", f"Correction: {cfg.correction}.", "Nothing to do.", {"method": cfg.correction, "alpha": cfg.alpha, "k": len(rows), "n_separable": k, "pairs": rows})]
    reason = _rank_skip(data)
    ranks = families.rank_stability_of(data.cells, cfg.n_resamples, cfg.seed, data.groups).collect() if reason is None else []
    if not ranks:
        return out + [_skip(PAIRS, "rank_stability", reason or "fewer_than_two_units", "Compare three or more models, each with scores, on two or more examples or groups of them.")]
    table: dict[str, list[float]] = {}
    for r in sorted(ranks, key=lambda r: (r["observed_rank"], r["rank"])):
        table.setdefault(r["model"], []).append(r["occupancy"])
    first = ranks[0]
    return out + [Finding(PAIRS, "rank_stability", f"The first place holds in {first['top1']:.1%} of resamples", "pass", "A ranking may rest on few examples.", "All models are resampled together.", "Nothing to do.", {"occupancy": table, "top1": first["top1"], "full_order": first["full_order"], "tie_resamples": first["tie_resamples"], "n_resampling_units": first["units"], "clustered": data.groups is not None, "n_resamples": cfg.n_resamples, "seed": cfg.seed})]


def slice_finding(data: EvalFrames, pairs: DataFrame, slice_by: str, cfg: AuditConfig) -> Finding:
    if data.attributes is None:
        return _skip(SLICES, "slice_comparison", "attribute_absent", f"Tag examples with {slice_by!r}.")
    tags = data.attributes.where(F.col("attr") == slice_by).select("example_id", "value")
    rows = families.slices(pairs.join(tags, "example_id"), "value", cfg.alpha, times=cfg.n_resamples, seed=cfg.seed).orderBy("slice").collect()
    if not rows:
        return _skip(SLICES, "slice_comparison", "attribute_absent", f"Tag examples with {slice_by!r}.")
    if not any(r["tested"] for r in rows):
        return _skip(SLICES, "slice_comparison", "all_slices_too_small", "Collect five or more examples per slice.")
    bad = [r["slice"] for r in rows if r["regression"]]
    return Finding(SLICES, "slice_comparison", f"{len(bad)} slices go the other way" if bad else "No slice goes the other way", "warn" if bad else "pass", "A gain on average can hide a loss in a part.", f"{sum(r['tested'] for r in rows)} slices of {slice_by!r} tested at a corrected level.", "Look at these slices.", {"slice_by": slice_by, "n_slices": sum(r["tested"] for r in rows), "n_slices_total": len(rows), "corrected_alpha": rows[0]["corrected_alpha"], "overall_mean_diff": rows[0]["overall"], "regressions": bad, "slices": [r.asDict() for r in rows]})


def strongest(data: EvalFrames, count: int) -> list[str]:
    top = records.suite_pair(data.cells, data.models, count).orderBy("rank").collect()
    return [r["model"] for r in top] or data.model_names()[:count]


def comparison(data: EvalFrames, a: str, b: str, cfg: AuditConfig, slice_by: str | None = None, metric: str | None = None, known: Facts | None = None, significant: bool | None = None) -> Report:
    """One pair, one metric: every check, in order. ``known`` are facts of all metrics, and
    ``significant`` is what a family of tests has decided."""
    known = facts(data, a, b, cfg) if known is None else known
    if metric is None:
        metric = next(iter({**known.numbers, **known.saturation, **known.votes_by_judge}), None)
    found, x = data_quality(data.metadata), known.numbers.get(metric)
    if x is None:
        found.append(_skip(VALIDITY, "score_statistical_validity", "preference_only" if data.preferences is not None else "no_paired_scores", "Score both models on the same examples."))
    else:
        found += statistical(x, a, b, cfg, significant)
        if cfg.run_aware:
            found.append(predictive_rerun(known.predictions.get(metric), a, b, cfg.run_aware_future_runs))
        found += win_findings(known.wins.get(metric), known.win_intervals.get(metric), a, b, cfg, data.groups is not None)
        if cfg.all_pairs:
            found += pair_findings(data, cfg)
        found += benchmark_health(known.saturation.get(metric), known.discrimination.get(metric), cfg) + repeatability(known.reruns.get(metric))
        found += judge_findings(data.judges, known.judges.get(metric, []), a, b, cfg)
    found += preference_findings(known.votes.get(metric), known.votes_by_judge.get(metric), a, b, cfg, significant if x is None else None)
    if slice_by and x is not None:
        found.append(slice_finding(data, _pairs(data, a, b), slice_by, cfg))
    return Report(found, verdict(found), [a, b], data.source_format, x or {})


def single(data: EvalFrames, model: str, cfg: AuditConfig, threshold: float | None = None) -> Report:
    """One model's score: how precise, how far from a target, on what benchmark."""
    own = data.cells.where(F.col("model") == model)
    r = resample.exact_mean_test(own.withColumn("diff", F.col("score")), ["model"], "ord", times=cfg.n_resamples, seed=cfg.seed, test=False).first()
    found = data_quality(data.metadata)
    if r is not None:
        half = (r["ci_high"] - r["ci_low"]) / 2
        ok = half <= cfg.precision_margin
        need = math.ceil(r["n"] * (half / cfg.precision_margin) ** 2)
        base = {"mean": r["mean_diff"], "ci_low": r["ci_low"], "ci_high": r["ci_high"]}
        found.append(Finding(SCORE, "single_precision", "The score is precise" if ok else "The score is imprecise", "pass" if ok else "warn", "A score without its error can't be compared.", f"{r['mean_diff']:.4g} within {half:.3g} either way.", "Nothing to do." if ok else f"Use about {need} examples.", base | {"half_width": half, "n": r["n"], "precise": ok, "need_n": need}))
        if threshold is not None:
            outcome = "above" if r["ci_low"] > threshold else "below" if r["ci_high"] < threshold else "inconclusive"
            found.append(Finding(SCORE, "threshold", f"The score is {outcome} {'at' if outcome == 'inconclusive' else ''} {threshold:g}".replace("  ", " "), {"above": "pass", "below": "fail", "inconclusive": "warn"}[outcome], "A target is met when the whole interval meets it.", f"Interval [{r['ci_low']:.4g}, {r['ci_high']:.4g}].", "Add examples or improve the model.", base | {"outcome": outcome, "threshold": threshold}))
        found += benchmark_health(*[next(iter(_by_metric(rows).values()), None) for rows in (health.saturation(own, cfg.score_ceiling, cfg.saturation_fraction), health.discrimination(own, cfg.min_spread))], cfg)
        means = health.single_run_means(data.runs, model).agg(F.avg("mean_score").alias("m"), F.stddev_samp("mean_score").alias("s"), F.count("*").alias("r")).first() if data.runs is not None else None
        if means is None or not means["r"]:
            found.append(_skip(REPEAT, "single_repeatability", "no_repeated_runs", "Run every example at least twice."))
        else:
            noisy = means["s"] > 0 and means["s"] >= abs(means["m"])
            found.append(Finding(REPEAT, "single_repeatability", "Runs scatter" if noisy else "Runs agree", "warn" if noisy else "pass", "A score should survive a rerun.", f"Deviation {means['s']:.4g} over {means['r']} runs.", "Average more runs.", {"score_std": means["s"], "mean_score": means["m"], "runs": means["r"], "snr": means["m"] / means["s"] if means["s"] else math.inf}))
    return Report(found, verdict(found), [model], data.source_format)


def audit_frames(data: EvalFrames, cfg: AuditConfig, a: str | None = None, b: str | None = None, threshold: float | None = None, slice_by: str | None = None) -> Report:
    """Both models named: compare them. A threshold, or one model: audit the (best) one.
    Else compare the two with the best means."""
    names = data.model_names()
    for m in (a, b):
        if m is not None and m not in names:
            raise ValueError(f"no model {m!r}; there are {', '.join(names)}")
    if a and b:
        return comparison(data, a, b, cfg, slice_by)
    if threshold is not None or len(names) == 1:
        return single(data, a or b or strongest(data, 1)[0], cfg, threshold)
    one, two = strongest(data, 2)[:2]
    return comparison(data, one, two, cfg, slice_by)


def corrected(p_values: dict[str, float], correction: str, alpha: float) -> dict[str, dict]:
    """p value, adjusted p, rejection and level of each test of a family. Of a single test
    nothing is corrected."""
    k, names = len(p_values), list(p_values)
    method = "none" if k == 1 else correction
    out: dict[str, dict] = {}
    running = 0.0
    for i, m in enumerate(sorted(names, key=lambda m: (p_values[m], names.index(m)))):
        p = p_values[m]
        running = max(running, min(1.0, (k - i) * p))
        adjusted = {"none": p, "bonferroni": min(1.0, k * p), "holm": running}[method]
        rejected = {"none": p < alpha, "bonferroni": p < alpha / k, "holm": running <= alpha}[method]
        out[m] = {"p_value": p, "adjusted_p": adjusted, "rejected": rejected, "step": k - i}
    left = max(1, k - sum(t["rejected"] for t in out.values()))
    for t in out.values():
        step = t.pop("step")
        t["alpha"] = alpha / {"none": 1, "bonferroni": k, "holm": step if t["rejected"] else left}[method]
    return {m: out[m] for m in names}


def suite(data: EvalFrames, cfg: AuditConfig, a: str | None = None, b: str | None = None) -> SuiteReport:
    """Every metric on one pair. The facts of all metrics come from one job each; the p
    values, of scores or else of preferences, are corrected together, and each metric is
    judged, its interval for equivalence included, at the level that this gives it."""
    if not (a and b):
        a, b = strongest(data, 2)[:2]
    metrics = data.metrics()
    k = len(metrics)
    levels = [cfg.alpha / j for j in range(1, k + 1)] if cfg.correction != "none" else [cfg.alpha]
    known = facts(data, a, b, cfg, levels)
    if k > 1 and cfg.correction != "none" and any(m in known.numbers and m in known.votes_by_judge for m in metrics):
        raise ValueError("a metric has tests of scores and of preferences; as one family they can't be corrected (split it, or use the correction 'none')")

    def p_of(m: str) -> float:
        if m in known.numbers:
            return known.numbers[m]["p_value"]
        return known.votes[m]["p_value"] if m in known.votes and known.votes[m]["n_decisive"] else 1.0

    tests = corrected({m: p_of(m) for m in metrics}, cfg.correction, cfg.alpha)
    for m, x in known.numbers.items():
        at = min(range(len(levels)), key=lambda i: abs(levels[i] - tests[m]["alpha"]))
        x["eq_low"], x["eq_high"] = x["eq_lows"][at], x["eq_highs"][at]
    plainly, holm = cfg.but(all_pairs=False), cfg.correction == "holm" and k > 1
    reports = {m: comparison(data.of_metric(m), a, b, plainly.but(alpha=tests[m]["alpha"]), None, m, known, tests[m]["rejected"] if holm else None) for m in metrics}
    return SuiteReport(reports, cfg.correction if k > 1 else "none", tests, cfg.gated_metrics, cfg.alpha, cfg.alpha / k if k and cfg.correction != "none" else cfg.alpha)


def run_level(runs: DataFrame, a: str, b: str, alpha: float = 0.05, confidence: float = 0.95, times: int = resample.RESAMPLES, seed: int = 0) -> list[Finding]:
    """Two unpaired samples of run scores: decision, effect size and precision."""
    s = twosample.rank_sums(runs, a, b).first()
    about = {r["model"]: r for r in twosample.summary(runs.where(F.col("model").isin(a, b))).collect()}
    if a not in about or b not in about:
        raise ValueError("both models need at least one run")
    one, two = (np.array([r["score"] for r in runs.where(F.col("model") == m).orderBy("run_ord").select("score").toLocalIterator()]) for m in (a, b))
    p_hat, lo, hi = twosample.bootstrap_win_share(one, two, confidence, times, seed)
    p = 1.0 if min(s["n_a"], s["n_b"]) < 3 else special.mann_whitney_p(s["u"], s["n_a"], s["n_b"], s["tie_sum"])
    lead = a if p_hat >= 0.5 else b
    crosses = lo <= 0.5 <= hi
    outcome = "significant" if p < alpha and not crosses else "equivalent" if crosses and 0.45 < p_hat < 0.55 else "inconclusive"
    size = magnitude_of(p_hat - 0.5, "cles")
    stats = {f"mean_{k}": about[m]["mean_score"] for k, m in (("a", a), ("b", b))} | {f"std_{k}": about[m]["std_score"] for k, m in (("a", a), ("b", b))}
    base = {"n_a": s["n_a"], "n_b": s["n_b"], "comparison_path": "run_level"}
    few = min(s["n_a"], s["n_b"]) < 10
    effect = _skip(VALIDITY, "effect_size", "fewer_than_two_runs", "Run both models at least twice.") if min(s["n_a"], s["n_b"]) < 2 else Finding(VALIDITY, "effect_size", f"The effect is {size}", "pass" if size in ("medium", "large") else "warn", "A real difference may still be too small to matter.", f"A random run of {a} beats one of {b} with probability {p_hat:.3g}.", "Weigh the size against what switching costs.", base | stats | {"common_language_effect_size": p_hat, "magnitude": size})
    return [
        Finding(VALIDITY, "decision", {"significant": f"{lead} beats the other", "equivalent": "Practically equal", "inconclusive": "No clear winner"}[outcome], {"significant": "pass", "equivalent": "warn", "inconclusive": "fail"}[outcome], "Totals of runs scatter too.", f"Mann-Whitney p = {p:.4g}; P({a} > {b}) in [{lo:.3g}, {hi:.3g}].", "Add runs.", base | {"outcome": outcome, "p_value_mann_whitney": p, "alpha": alpha, "p_a_gt_b": p_hat, "ci_low": lo, "ci_high": hi}),
        effect,
        Finding(VALIDITY, "precision", "Few runs" if few else "Enough runs", "pass" if p < alpha and not few else "warn", "Few runs only show large effects.", f"{s['n_a']} and {s['n_b']} runs.", "Use ten or more runs of each model.", base),
    ]
