"""Whole benchmark texts that also stand in a reference corpus, exactly or nearly."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scores import normal_text

THRESHOLD, BROADCAST_LIMIT, CLASSES = 0.85, 16 << 20, 128


def _normal(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), normal_text(F.col(text)).alias("norm"))


def exact_matches(bench: DataFrame, reference: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Benchmark rows whose normalised text is in the reference: a semi-join on the text."""
    return _normal(bench, text, key).join(_normal(reference, text, key).select("norm").distinct(), "norm", "left_semi").select("id")


class _Benchmark:
    """Benchmark texts in the order of their lengths, with counts of their characters by
    hash, for the workers."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.rows, self.threshold = sorted(rows, key=lambda r: len(r[1])), threshold
        self.sizes = np.array([len(t) for _, t in self.rows], dtype=np.int64)
        self.letters = np.array([_letters(t) for _, t in self.rows], dtype=np.int32).reshape(-1, CLASSES)

    def like(self, text: str, done: set):
        """Ids of the texts of similarity ``threshold`` or more that aren't in ``done``."""
        t, n = self.threshold, len(text)
        # 2 min(a, b) / (a + b) is the greatest similarity of texts of these lengths
        most = n * (2 - t) / t if t > 0 else float("inf")
        lo, hi = np.searchsorted(self.sizes, t * n / (2 - t) - 1e-9, "left"), np.searchsorted(self.sizes, most + 1e-9, "right")
        if lo == hi:
            return
        shared = np.minimum(self.letters[lo:hi], _letters(text)).sum(axis=1)
        near = lo + np.flatnonzero(2 * shared >= t * (self.sizes[lo:hi] + n))
        matcher = SequenceMatcher(None)
        for k in near.tolist():
            number, other = self.rows[k]
            if number in done:
                continue
            if n + len(other):
                if matcher.b is not text:
                    matcher.set_seq2(text)
                matcher.set_seq1(other)
                if matcher.quick_ratio() < t or matcher.ratio() < t:
                    continue
            done.add(number)
            yield number


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % CLASSES, minlength=CLASSES)


def near_matches(bench: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "id", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Benchmark rows without an exact match that have a reference text of similarity
    ``threshold`` or more: the share of matching characters, 2 M / (a + b).

    The benchmark meets all reference texts in the scan, in blocks of at most
    ``broadcast_limit`` bytes, each of which is sent to the workers. Exact: only pairs are
    aligned whose lengths, and then whose counts of characters, allow that similarity; a
    worker looks for each benchmark text only until it has found a match. Two texts have to
    be aligned to know more, so the work is the number of such pairs."""
    open_ = _normal(bench, text, key).join(_normal(reference, text, key).select("norm").distinct(), "norm", "left_anti").select("id", "norm")
    right = _normal(reference, text, key).select("norm").distinct()
    spark, kind = bench.sparkSession, bench.schema[key].dataType
    size = open_.agg(F.sum(F.octet_length("norm"))).first()[0] or 0
    blocks = max(1, -(-2 * size // broadcast_limit))
    arrow, ddl, out = to_arrow_type(kind), f"id {kind.simpleString()}", None
    for k in range(blocks):
        mine = open_.where(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == k) if blocks > 1 else open_
        # numbers stand for rows, as ids may repeat or be null
        rows = [(i, r["norm"], r["id"]) for i, r in enumerate(mine.collect())]  # a block: bounded
        shared = spark.sparkContext.broadcast((_Benchmark([r[:2] for r in rows], threshold), [r[2] for r in rows]))

        def scan(batches, shared=shared):
            test, ids = shared.value
            done: set = set()
            for b in batches:
                found = [i for t in b["norm"].to_pylist() for i in test.like(t, done)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found], arrow), pa.array(found, pa.int64())], names=["id", "number"])

        hits = right.mapInArrow(scan, f"{ddl}, number bigint").distinct().select("id")
        out = hits if out is None else out.unionByName(hits)
    return out


def summary(bench: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "id") -> DataFrame:
    """One row: exact, near, total, fraction (0 for an empty benchmark)."""
    total = bench.where(F.col(text).isNotNull()).agg(F.count("*").alias("total"))
    exact = exact_matches(bench, reference, text, key).agg(F.count("*").alias("exact"))
    near = near_matches(bench, reference, threshold, text, key).agg(F.count("*").alias("near"))
    one = total.join(exact).join(near)
    return one.select("exact", "near", "total", F.coalesce(F.try_divide(F.col("exact") + F.col("near"), F.col("total")), F.lit(0.0)).alias("fraction"))
