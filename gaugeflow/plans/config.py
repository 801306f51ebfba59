"""The policy of an audit: thresholds, seeds and what is opted into."""

from __future__ import annotations

import difflib
import tomllib
import warnings
from dataclasses import dataclass, fields, replace
from pathlib import Path

SECTION = "gaugeflow"


@dataclass(frozen=True)
class AuditConfig:
    all_pairs: bool = False
    alpha: float = 0.05
    bayesian: bool = False
    correction: str = "bonferroni"
    equivalence_margin: float = 0.05
    gated_metrics: frozenset[str] = frozenset()
    judge_agreement_threshold: float = 0.8
    judge_correlation_threshold: float = 0.8
    min_spread: float = 0.01
    n_resamples: int = 10_000
    power_target: float = 0.8
    precision_margin: float = 0.05
    reference_judge: str | None = None
    run_aware: bool = False
    run_aware_future_runs: int | None = None
    saturation_fraction: float = 0.95
    score_ceiling: float | None = None
    seed: int = 0
    smallest_meaningful_effect: float = 0.2
    win_rate: bool = False

    def __post_init__(self):
        runs = self.run_aware_future_runs
        if self.run_aware and (isinstance(runs, bool) or not isinstance(runs, int) or runs <= 0):
            raise ValueError("run_aware needs run_aware_future_runs, a whole number above 0")
        if self.score_ceiling is not None and not 0 < self.score_ceiling < float("inf"):
            raise ValueError("score_ceiling must be finite and above 0")
        if self.correction not in ("none", "bonferroni", "holm"):
            raise ValueError(f"unknown correction {self.correction!r}")
        if isinstance(self.gated_metrics, str):
            raise ValueError("gated_metrics is a list of names, not one name")
        object.__setattr__(self, "gated_metrics", frozenset(self.gated_metrics))

    @classmethod
    def of(cls, values: dict, strict: bool = True) -> AuditConfig:
        """Unknown names are an error, or a warning if not ``strict``."""
        known = {f.name for f in fields(cls)}
        for name in sorted(set(values) - known):
            near = difflib.get_close_matches(name, known, 1)
            text = f"unknown setting {name!r}" + (f"; did you mean {near[0]!r}?" if near else "")
            if strict:
                raise ValueError(text)
            warnings.warn(text, stacklevel=2)
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def load(cls, path: str | None = None, start: str = ".") -> AuditConfig:
        """From a named TOML file, else from what is found in ``start``, else the defaults."""
        if path is not None:
            table = tomllib.loads(Path(path).read_text())
            return cls.of(table.get("tool", {}).get(SECTION, table))
        own, project = Path(start, f".{SECTION}.toml"), Path(start, "pyproject.toml")
        if own.exists():
            return cls.of(tomllib.loads(own.read_text()), strict=False)
        if project.exists():
            return cls.of(tomllib.loads(project.read_text()).get("tool", {}).get(SECTION, {}), strict=False)
        return cls()

    def but(self, **changes) -> AuditConfig:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
