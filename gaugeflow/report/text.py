"""Reports for a terminal, as Markdown and as one HTML page."""

from __future__ import annotations

import html
import math

from ..plans.audit import Report, SuiteReport
from ..plans.findings import Finding

MARK = {"pass": "+", "warn": "!", "fail": "x", "skip": "-"}
COLOUR = {"pass": "32", "warn": "33", "fail": "31", "skip": "2", "HIGH": "32", "MODERATE": "33", "LOW": "31"}


def by_pillar(findings: list[Finding]) -> dict[str, list[Finding]]:
    """Pillars in the order in which they first come up."""
    out: dict[str, list[Finding]] = {}
    for f in findings:
        out.setdefault(f.pillar, []).append(f)
    return out


def detected(f: Finding) -> str:
    """How it was detected; an infinite effect reads as unbounded."""
    d = f.details.get("cohens_d")
    return f.how_detected.replace("inf", "unbounded") if isinstance(d, float) and math.isinf(d) else f.how_detected


def plain(report: Report, explain: bool = False, colour: bool = False) -> str:
    def tint(text: str, key: str) -> str:
        return f"\033[{COLOUR[key]}m{text}\033[0m" if colour else text

    lines = [tint(f"{report.verdict.level} confidence", report.verdict.level) + f": {report.verdict.summary}", f"Models: {' vs '.join(report.models)} (from {report.source_format})"]
    for pillar, found in by_pillar(report.findings).items():
        lines += ["", pillar]
        for f in found:
            lines.append(f"  {tint(f'[{MARK[f.status]}]', f.status)} {f.title}")
            if explain or f.status in ("warn", "fail"):
                lines += [f"      {name}: {text}" for name, text in (("Why", f.why), ("How", detected(f)), ("Fix", f.how_to_fix))]
    return "\n".join(lines) + "\n"


def plain_suite(report: SuiteReport, colour: bool = False) -> str:
    lines = [f"{report.level} confidence over {len(report.reports)} metrics (correction: {report.correction})"]
    for metric, r in report.reports.items():
        t = report.tests.get(metric)
        tail = f", p = {t['p_value']:.4g}, adjusted {t['adjusted_p']:.4g}" if t else ""
        lines.append(f"  {metric}: {r.verdict.level}{tail}{' (gate)' if metric in report.gates else ''}. {r.verdict.summary}")
    return "\n".join(lines) + "\n"


def plain_diff(changes: list[dict]) -> str:
    if not changes:
        return "No change.\n"
    kind = lambda c: "worse" if c["regression"] else "better" if c["improvement"] else "changed"
    return "".join(f"{c['scope']}: {c['field']} {c['old']} -> {c['new']} ({kind(c)})\n" for c in changes)


def _cell(text: str) -> str:
    for c in "\\`*_[]<>|":
        text = text.replace(c, "\\" + c)
    return text.replace("\n", " ")


def markdown(report: Report) -> str:
    out = [f"## {report.verdict.level.capitalize()} confidence", "", _cell(report.verdict.summary), "", f"Models: {_cell(' vs '.join(report.models))}", ""]
    for pillar, found in by_pillar(report.findings).items():
        out += [f"### {pillar}", "", "| | Finding | How detected | What to do |", "|-|-|-|-|"]
        out += [f"| {f.status.upper()} | {_cell(f.title)} | {_cell(detected(f))} | {_cell(f.how_to_fix)} |" for f in found] + [""]
    return "\n".join(out)


def markdown_suite(report: SuiteReport) -> str:
    out = [f"## {report.level.capitalize()} confidence", "", "| Metric | Level | p | Adjusted p | Summary |", "|-|-|-|-|-|"]
    for metric, r in report.reports.items():
        t = report.tests.get(metric, {})
        number = lambda k: f"{t[k]:.4g}" if k in t else ""  # noqa: B023, E731
        out.append(f"| {_cell(metric)} | {r.verdict.level} | {number('p_value')} | {number('adjusted_p')} | {_cell(r.verdict.summary)} |")
    return "\n".join(out) + "\n"


_STYLE = "body{font:16px/1.5 sans-serif;max-width:50em;margin:2em auto;padding:0 1em}.pass{color:#176b2c}.warn{color:#8a5a00}.fail{color:#a11}.skip{color:#666}dt{font-weight:600}"


def page(report: Report) -> str:
    """A standalone HTML page; suites have none."""
    e = html.escape
    body = [f"<h1>{report.verdict.level.capitalize()} confidence</h1><p>{e(report.verdict.summary)}</p><p>{e(' vs '.join(report.models))}</p>"]
    for pillar, found in by_pillar(report.findings).items():
        body.append(f"<h2>{e(pillar)}</h2>")
        for f in found:
            body.append(f'<section class="{f.status}"><h3>{f.status.upper()}: {e(f.title)}</h3><dl><dt>Why</dt><dd>{e(f.why)}</dd><dt>How</dt><dd>{e(detected(f))}</dd><dt>Fix</dt><dd>{e(f.how_to_fix)}</dd></dl></section>')
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Audit</title><style>{_STYLE}</style></head><body>{"".join(body)}</body></html>\n'
