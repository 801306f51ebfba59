"""Command line: audit, diff and contamination. Exit codes: 0 fine, 1 below what was asked
for, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .plans.audit import SuiteReport
from .plans.config import AuditConfig
from .plans.findings import LEVELS, METHODOLOGY_VERSION, plain
from .report import text
from .sources.load import load_comparison, load_suite, load_texts

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeflow", description=__doc__)
    p.add_argument("--version", action="version", version=f"gaugeflow {VERSION} (methodology {METHODOLOGY_VERSION})")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit")
    a.add_argument("results", nargs="+")
    for name in ("model-a", "model-b", "config", "reference-judge", "slice-by", "fail-under", "html", "md"):
        a.add_argument(f"--{name}")
    for name, kind in (("alpha", float), ("equivalence-margin", float), ("seed", int), ("future-runs", int), ("threshold", float), ("n-resamples", int)):
        a.add_argument(f"--{name}", type=kind)
    a.add_argument("--correction", choices=("none", "bonferroni", "holm"))
    for name in ("bayesian", "win-rate", "run-aware", "all-pairs", "run-level", "strict", "json", "plain", "explain"):
        a.add_argument(f"--{name}", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    for name in ("fail-on-regression", "json", "plain"):
        d.add_argument(f"--{name}", action="store_true")
    c = sub.add_parser("contamination")
    c.add_argument("benchmark")
    c.add_argument("reference")
    c.add_argument("--column", default="text")
    c.add_argument("--fail-over", type=float, default=0.15)
    c.add_argument("--json", action="store_true")
    return p


def _audit(spark: SparkSession, o: argparse.Namespace) -> int:
    cfg = AuditConfig.load(o.config).but(
        alpha=o.alpha, equivalence_margin=o.equivalence_margin, seed=o.seed, correction=o.correction, reference_judge=o.reference_judge, n_resamples=o.n_resamples,
        bayesian=o.bayesian or None, win_rate=o.win_rate or None, all_pairs=o.all_pairs or None, run_aware_future_runs=o.future_runs,
    )
    if o.run_aware:
        cfg = cfg.but(run_aware=True)
    floor = (o.fail_under or ("high" if o.strict else "")).upper()
    if o.run_level:
        found = api.audit_run_level(spark, o.results[0], model_a=o.model_a, model_b=o.model_b, alpha=cfg.alpha, confidence=1 - cfg.alpha, seed=cfg.seed)
        print(json.dumps(plain({"findings": [f.to_dict() for f in found]}), indent=2) if o.json else "\n".join(f"[{f.status}] {f.title}: {f.how_detected}" for f in found))
        worst = "LOW" if any(f.status == "fail" for f in found) else "MODERATE" if any(f.status == "warn" for f in found) else "HIGH"
        return int(bool(floor) and LEVELS.index(worst) < LEVELS.index(floor))
    if len(o.results) == 2:
        data = load_comparison(spark, *o.results, label_a=o.model_a, label_b=o.model_b)
        report = api.audit(spark, data, slice_by=o.slice_by, config=cfg.but(all_pairs=False))
    else:
        data = load_suite(spark, o.results[0])
        many = len(data.metrics()) > 1
        report = api.audit_suite(spark, data, model_a=o.model_a, model_b=o.model_b, config=cfg) if many else api.audit(spark, data, model_a=o.model_a, model_b=o.model_b, threshold=o.threshold, slice_by=o.slice_by, config=cfg)
    is_suite = isinstance(report, SuiteReport)
    if o.html:
        if is_suite:
            raise ValueError("a suite has no HTML page; use --md or --json")
        Path(o.html).write_text(text.page(report))
    if o.md:
        Path(o.md).write_text(text.markdown_suite(report) if is_suite else text.markdown(report))
    if o.json:
        print(json.dumps(report.to_dict(), indent=2))
    else:
        colour = sys.stdout.isatty() and not o.plain
        print(text.plain_suite(report, colour) if is_suite else text.plain(report, o.explain, colour), end="")
    level = report.level if is_suite else report.verdict.level
    return int(bool(floor) and LEVELS.index(level) < LEVELS.index(floor))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gaugeflow").getOrCreate()
    try:
        if o.command == "audit":
            return _audit(spark, o)
        if o.command == "diff":
            found = api.compare_reports(spark, o.old, o.new)
            print(json.dumps(found, indent=2) if o.json else text.plain_diff(found), end="")
            return int(o.fail_on_regression and any(c["regression"] for c in found))
        (bench, gone), (reference, _) = load_texts(spark, o.benchmark, o.column), load_texts(spark, o.reference, o.column)
        r = api.audit_contamination(bench, reference) | {"missing": gone}
        print(json.dumps(r, indent=2) if o.json else f"{r['exact']} exact and {r['near']} near matches of {r['total']} ({r['fraction']:.1%})")
        return int(r["fraction"] >= o.fail_over)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
