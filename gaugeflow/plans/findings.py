"""Findings, the verdict over them, and their form as data."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

SCHEMA_VERSION, METHODOLOGY_VERSION = "1.0", "1.1"
STATUSES = ("pass", "warn", "fail", "skip")
LEVELS = ("LOW", "MODERATE", "HIGH")


@dataclass(frozen=True)
class Finding:
    pillar: str
    check: str
    title: str
    status: str
    why: str
    how_detected: str
    how_to_fix: str
    details: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        texts = {k: getattr(self, k) for k in ("pillar", "title", "why", *(f"how_{x}" for x in ("detected", "to_fix")))}
        return texts | {"status": self.status.upper(), "details": plain({"check": self.check} | self.details)}


def plain(value):
    """A value that JSON has: no NaN or infinity, no array scalars, enums by value."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, Enum):
        return value.value
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


class NotTrusted(AssertionError):
    """An audit came out below the level that was asked for."""


@dataclass(frozen=True)
class Verdict:
    level: str
    summary: str
    drivers: list[Finding]

    def to_dict(self) -> dict:
        titles = [f.title for f in self.drivers]
        return {"label": f"{self.level.capitalize()} Confidence", "drivers": titles, "level": self.level, "summary": self.summary}

    def raise_if_below(self, minimum: str, where: str = "") -> None:
        want = minimum.strip().upper()
        if want not in LEVELS:
            raise ValueError(f"no such level: {minimum!r}")
        if LEVELS.index(self.level) < LEVELS.index(want):
            raise NotTrusted(f"confidence {self.level} is below {want}" + (f" in {where}" if where else ""))


_BY_LEVEL = {"HIGH": "The evidence carries the conclusion.", "MODERATE": "Likely right; look at the warnings first.", "LOW": "The evidence doesn't carry a decision yet."}
_BY_OUTCOME = {"equivalent": "The two are practically equal; choose by price or speed.", "inconclusive": "Too little data to name a winner."}
_BY_THRESHOLD = {"above": "The model is above the target.", "below": "The model is below the target.", "inconclusive": "Too near the target to tell; more examples are needed."}


def verdict(findings: list[Finding]) -> Verdict:
    """LOW if anything fails or nothing could be assessed, MODERATE if anything warns, else HIGH."""
    active = [f for f in findings if f.status != "skip"]
    if not active:
        return Verdict("LOW", "Nothing in the data could be assessed.", [])
    fails, warns = ([f for f in active if f.status == s] for s in ("fail", "warn"))
    level = "LOW" if fails else "MODERATE" if warns else "HIGH"
    by_check = {f.check: f for f in reversed(findings)}
    text = _BY_OUTCOME.get(by_check["decision"].details.get("outcome")) if "decision" in by_check else None
    if text is None and "threshold" in by_check:
        text = _BY_THRESHOLD.get(by_check["threshold"].details.get("outcome"))
    elif text is None and "single_precision" in by_check:
        text = "The score is measured precisely enough." if by_check["single_precision"].details.get("precise") else "More examples are needed to pin the score down."
    return Verdict(level, text or _BY_LEVEL[level], fails or warns)
