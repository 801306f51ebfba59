"""The resampling part of a comparison: facts in a task per metric, draws split between tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import binomial_two_sided
from ..operators import resample as S
from ..operators import streams as T


def paired_d(rows: np.ndarray) -> np.ndarray:
    mean, sd = rows.mean(axis=1), rows.std(axis=1, ddof=1) if rows.shape[1] > 1 else np.zeros(len(rows))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sd > 0, mean / sd, np.where(mean == 0, 0.0, np.sign(mean) * np.inf))


def signed_rank_share(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for k, row in enumerate(rows):
        d = row[row != 0]
        if len(d):
            _, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
            rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
            out[k] = float((rank * np.sign(d)).sum() / rank.sum())
    return out


COLUMNS = [
    "metric string", "n bigint", "mean_a double", "mean_b double", "mean_diff double", "domain string", "levels int", "test string", "b_only bigint", "a_only bigint", "n_clusters bigint",
    "p_value double", "ci_low double", "ci_high double", "eq_lows array<double>", "eq_highs array<double>", "effect double", "effect_low double", "effect_high double", "superiority double",
]


def found_facts(table: pa.Table, clustered: bool, vectors: bool = True) -> tuple[dict, dict]:
    """What of a comparison doesn't depend on draws, and the vectors to draw from."""
    f = table.take(pc.sort_indices(table, sort_keys=[("ord", "ascending")]))
    a, b = (f[c].to_numpy().astype(float) for c in ("score_a", "score_b"))
    raw = b - a
    sign = 1.0 if raw.mean() >= 0 else -1.0
    d, values = sign * raw, np.unique(np.concatenate([a, b]))
    levels = len(np.unique(np.rint(values)))
    whole = bool((np.abs(values - np.rint(values)) <= 1e-9).all())
    domain = "binary" if set(values) <= {0.0, 1.0} else "ordinal" if whole and 3 <= levels <= 10 else "continuous"
    lead, trail = (b, a) if sign > 0 else (a, b)
    b_only, a_only = int(((lead == 1) & (trail == 0)).sum()), int(((trail == 1) & (lead == 0)).sum())
    facts = {"metric": f["metric"][0].as_py(), "n": len(d), "mean_a": float(a.mean()), "mean_b": float(b.mean()), "mean_diff": float(raw.mean()), "domain": domain, "levels": levels, "b_only": b_only, "a_only": a_only, "sign": sign, "k": None}
    v = np.rint(d) if domain == "ordinal" else d
    if domain == "binary":
        facts["effect"] = float(2 * np.arcsin(np.sqrt(lead.mean())) - 2 * np.arcsin(np.sqrt(trail.mean())))
    else:
        facts["effect"] = float((signed_rank_share if domain == "ordinal" else paired_d)(v[None, :])[0])
    facts["superiority"] = float(((d > 0) + 0.5 * (d == 0)).mean())
    facts["seen"] = abs(float(d.mean()))
    out = {}
    if clustered:
        frame = pd.DataFrame({"c": f["cluster"].to_pandas(), "d": raw}).groupby("c", sort=True)["d"]
        sums, sizes = sign * frame.sum().to_numpy(), frame.size().to_numpy(dtype=float)
        facts |= {"k": len(sums), "total": float(sizes.sum()), "seen_clusters": abs(float(sums.sum()) / float(sizes.sum()))}
        if vectors and domain != "binary":
            out |= T.coded(sums, "sum") | T.coded(sizes, "size") | T.coded(sums / sizes * sizes, "flip")
    if vectors:
        out |= T.coded(d) | (T.coded(v, "v") if domain == "ordinal" else {})
    return facts, out


class MeanAndD(T.Means):
    """The mean of the drawn differences and ``paired_d`` of them."""

    width = 2

    def __init__(self, vectors: dict):
        self.x = T.Values(vectors, exact=False)
        self.parts, self.away = [self.x], np.empty(self.x.n)

    def found(self) -> tuple:
        n, row = self.x.n, self.x.row
        mean = self.x.total() / n
        if n < 2:
            sd = 0.0
        else:
            np.subtract(row, mean, out=self.away)
            np.multiply(self.away, self.away, out=self.away)
            sd = np.sqrt(self.away.sum() / (n - 1))
        return mean, mean / sd if sd > 0 else 0.0 if mean == 0 else np.sign(mean) * np.inf


class _Counts:
    """How often each distinct value is drawn; with it ranks are sums of halves, so exact."""

    def __init__(self, vectors: dict):
        self.codes, self.table = vectors["v"], vectors["v.table"]
        self.size, self.at = np.unique(np.abs(self.table[self.table != 0]), return_inverse=True)

    def begin(self) -> None:
        self.counts = np.zeros(len(self.table), dtype=np.int64)

    def take(self, lo: int, pick: np.ndarray) -> None:
        self.counts += np.bincount(self.codes[pick], minlength=len(self.table))

    def share(self) -> float:
        moved = self.table != 0
        c, signs = self.counts[moved].astype(float), np.sign(self.table[moved])
        both, net = np.bincount(self.at, c, len(self.size)), np.bincount(self.at, c * signs, len(self.size))
        rank = np.cumsum(both) - (both - 1) / 2
        return float((rank * net).sum() / (rank * both).sum()) if both.any() else 0.0


class MeanAndRanks(T.Means):
    """The mean of the drawn differences and ``signed_rank_share`` of them, rounded."""

    width = 2

    def __init__(self, vectors: dict):
        self.x, self.v = T.Values(vectors), _Counts(vectors)
        self.parts = [self.x, self.v]

    def found(self) -> tuple:
        return self.x.total() / self.x.n, self.v.share()


class _PooledSums(T.Pooled):
    def __init__(self, vectors: dict):
        self.x, self.size = T.Values(vectors, "sum"), T.Values(vectors, "size")
        self.parts = [self.x, self.size]


class _ClusterFlips(T.Flips):
    def __init__(self, vectors: dict):
        super().__init__(vectors, "flip")


def compare(pairs: DataFrame, alpha: float | list[float], confidence: float, times: int, seed: int, clustered: bool, draws: bool = True) -> DataFrame:
    """A row per metric. ``pairs`` has metric, ord, score_a, score_b and cluster (null
    without groups). All numbers but the intervals for equivalence favour the leader, b on
    ties. These are given for every level in ``alpha`` (eq_lows, eq_highs), as only a whole
    family's p values tell which of them a metric is held to, and for the first one alone.
    Without ``draws`` what depends on them is null."""
    levels_of_alpha = [alpha] if isinstance(alpha, float) else list(alpha)

    def prepare(table: pa.Table) -> tuple[dict, dict]:
        return found_facts(table, clustered, draws)

    def plan(x: dict) -> list[T.Draws]:
        if not draws:
            return []
        n, each = x["n"], {"binary": T.Means, "ordinal": MeanAndRanks, "continuous": MeanAndD}[x["domain"]]
        out = [T.Draws(each, n, times, seed, ("x", "v") if x["domain"] == "ordinal" else ("x",))]
        if x["domain"] != "binary" and clustered:
            out += [T.Draws(_ClusterFlips, x["k"], times, seed, ("flip",)), T.Draws(_PooledSums, x["k"], times, seed, ("sum", "size"))]
        elif x["domain"] != "binary":
            out.append(T.Draws(T.Flips, n, times, seed))
        return out

    def finish(x: dict, found: list[np.ndarray]) -> list[tuple]:
        binary, grouped, p = x["domain"] == "binary", clustered and x["domain"] != "binary", None
        test = "mcnemar" if binary else "clustered permutation" if grouped else "permutation"
        if binary:
            p = binomial_two_sided(x["b_only"], x["b_only"] + x["a_only"])
        elif found:
            total, seen = (x["total"], x["seen_clusters"]) if grouped else (x["n"], x["seen"])
            p = (int(np.count_nonzero(np.abs(found[1][:, 0] / total) >= seen)) + 1) / (times + 1)
        lo = hi = e_lo = e_hi = lows = highs = None
        if found:
            means = (found[2] if grouped else found[0])[:, 0]
            lo, hi = S.interval(means, confidence)
            eq = [S.interval(x["sign"] * means, 1 - 2 * level) for level in levels_of_alpha]  # of b - a: the same draws
            lows, highs = [e[0] for e in eq], [e[1] for e in eq]
            e_lo, e_hi = (lo, hi) if binary else S.interval(found[0][:, 1], confidence)
        row = [x[c] for c in ("metric", "n", "mean_a", "mean_b", "mean_diff", "domain", "levels")]
        return [(*row, test, x["b_only"], x["a_only"], x["k"], p, lo, hi, lows, highs, x["effect"], e_lo, e_hi, x["superiority"])]

    columns = ["metric", "ord", "score_a", "score_b", *(["cluster"] if clustered else [])]
    out = T.spread(pairs.select(*columns), ["metric"], prepare, plan, finish, ", ".join(COLUMNS))
    return out.withColumns({"eq_low": F.col("eq_lows")[0], "eq_high": F.col("eq_highs")[0]})
