"""What changed between two audits: (scope, confidence, decision) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {name: i for i, name in enumerate("LOW MODERATE HIGH".split())}
OUTCOMES = {name: i for i, name in enumerate("inconclusive equivalent significant".split())}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def report_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, field, old, new, regression, improvement) of the scopes in both reports."""
    long = lambda df, name: df.unpivot(["scope"], ["confidence", "decision"], "field", name)
    both = long(old, "old").join(long(new, "new"), ["scope", "field"]).where("old IS NOT NULL AND new IS NOT NULL AND old <> new")
    rank = lambda c: F.when(F.col("field") == "confidence", _rank(F.col(c), LEVELS)).otherwise(_rank(F.col(c), OUTCOMES))
    return both.select("scope", "field", "old", "new", (rank("new") < rank("old")).alias("regression"), (rank("new") > rank("old")).alias("improvement"))
