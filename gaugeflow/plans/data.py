"""Evaluation data as narrow tables, and how they come from observation rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R

RECORD_DDL = "metric string, example_id string, model string, judge string, score double, row_ord bigint"
PREF_DDL = "metric string, example_id string, judge string, winner string, is_tie boolean, row_ord bigint"


@dataclass(frozen=True)
class EvalFrames:
    """``cells`` (metric, example_id, model, score, ord); the others are None where the
    source has nothing of the kind. ``models`` has (metric, model, model_ord)."""

    cells: DataFrame
    models: DataFrame
    runs: DataFrame | None = None
    judges: DataFrame | None = None
    preferences: DataFrame | None = None
    attributes: DataFrame | None = None  # example_id, attr, value
    groups: DataFrame | None = None  # example_id, group_id
    source_format: str = "dataframe"
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of_records(cls, records: DataFrame, source_format: str = "dataframe", **more) -> EvalFrames:
        return cls(R.score_cells(records), R.models_in_order(records), R.run_cells(records), R.judge_cells(records), source_format=source_format, **more)

    def metrics(self) -> list[str]:
        rows = self.models.groupBy("metric").agg(F.min("model_ord").alias("o")).orderBy("o", "metric").collect()
        return [r["metric"] for r in rows]

    def of_metric(self, metric: str) -> EvalFrames:
        pick = lambda df: None if df is None or "metric" not in df.columns else df.where(F.col("metric") == metric)
        return replace(self, cells=pick(self.cells), models=pick(self.models), runs=pick(self.runs), judges=pick(self.judges), preferences=pick(self.preferences))

    def model_names(self) -> list[str]:
        rows = self.models.groupBy("model").agg(F.min("model_ord").alias("o")).orderBy("o", "model").collect()
        return [r["model"] for r in rows]


def collapse_metrics(records: DataFrame) -> DataFrame:
    """All metrics as one, as when a file is loaded without regard to its metric column:
    rows of one (example, model) then count as repeated runs."""
    return records.withColumn("metric", F.lit("score"))
