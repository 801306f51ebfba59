"""The functions a user calls."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, contamination
from .plans import audit as A
from .plans.config import AuditConfig
from .plans.data import EvalFrames
from .plans.findings import Finding
from .sources import load as L


def _config(config: AuditConfig | None, **changes_) -> AuditConfig:
    return (config or AuditConfig.load()).but(**changes_)


def audit(spark: SparkSession, source, *, model_a: str | None = None, model_b: str | None = None, threshold: float | None = None, slice_by: str | None = None, config: AuditConfig | None = None, **settings) -> A.Report:
    """Audit a file, a pair of files, a DataFrame of records or evaluation tables."""
    cfg = _config(config, **settings)
    if isinstance(source, (list, tuple)):
        data = L.load_comparison(spark, *source, label_a=model_a, label_b=model_b)
        model_a = model_b = threshold = None
    elif isinstance(source, EvalFrames):
        data = source
    elif isinstance(source, DataFrame):
        data = EvalFrames.of_records(source)
    else:
        data = L.load(spark, str(source))
    return A.audit_frames(data, cfg, model_a, model_b, threshold, slice_by)


def audit_suite(spark: SparkSession, source, *, model_a: str | None = None, model_b: str | None = None, config: AuditConfig | None = None, **settings) -> A.SuiteReport:
    """Audit every metric of a file, of a DataFrame of records or of evaluation tables."""
    data = source if isinstance(source, EvalFrames) else EvalFrames.of_records(source) if isinstance(source, DataFrame) else L.load_suite(spark, str(source))
    return A.suite(data, _config(config, **settings), model_a, model_b)


def audit_run_level(spark: SparkSession, path: str, *, model_a: str | None = None, model_b: str | None = None, seed: int = 0, n_resamples: int = 10_000, confidence: float = 0.95, alpha: float = 0.05) -> list[Finding]:
    runs, a, b = L.load_run_level(spark, path, model_a, model_b)
    return A.run_level(runs, a, b, alpha, confidence, n_resamples, seed)


def audit_contamination(benchmark: DataFrame, reference: DataFrame, *, threshold: float = contamination.THRESHOLD) -> dict:
    """Counts of exact and near matches of (id, text) tables, and their share."""
    return contamination.summary(benchmark, reference, threshold).first().asDict()


def compare_reports(spark: SparkSession, old: str, new: str) -> list[dict]:
    """What changed between two audits saved as JSON, scope by scope in the old one's order."""
    a, b = (json.loads(Path(p).read_text()) for p in (old, new))
    if ("metrics" in a) != ("metrics" in b):
        raise ValueError("a suite can't be compared with a single audit")

    def rows(r: dict) -> list[tuple]:
        outcome = lambda x: next((f["details"].get("outcome") for f in x.get("findings", []) if f["details"].get("check") == "decision"), None)
        if "metrics" not in r:
            return [("overall", r["verdict"]["level"], outcome(r), 0)]
        return [("overall", r["overall_level"], None, 0)] + [(m, x["verdict"]["level"], outcome(x), i + 1) for i, (m, x) in enumerate(r["metrics"].items())]

    tables = [spark.createDataFrame(rows(r), "scope string, confidence string, decision string, ord int") for r in (a, b)]
    found = changes.report_diff(*(t.drop("ord") for t in tables)).join(tables[0].select("scope", "ord"), "scope")
    return [r.asDict() for r in found.orderBy("ord", F.col("field")).drop("ord").collect()]
