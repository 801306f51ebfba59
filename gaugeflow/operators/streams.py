"""Seeded streams of draws, split between tasks.

The replicates of a group are drawn one after the other by the generator of one seed, so that
a seed gives the same numbers on any machine. Its stream can be advanced to any word in
constant time. Replicate r of n draws begins at draw r * n: the generator skips a word now and
then (Lemire's rejection, which depends on that word alone), so words that it uses are counted
first, in tasks of their own. Then each task draws some of the replicates, bit by bit those of
a single loop. Every such task holds the group's vector: a byte or two a value where there are
few distinct ones, else eight.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder
from . import hashdraws

#: Draws of a task, tasks of a form and group at most (each gets a copy of the vector), values
#: drawn at a time, bytes of a row of a stored vector, words that the driver counts itself.
WORK, PARTS, BLOCK, CHUNK, FEW = 50_000_000, 48, 1 << 16, 1 << 20, 20_000_000
CODES = 1 << 16


def generator(seed: int, word: int) -> np.random.Generator:
    """``default_rng(seed)`` after ``word`` words of 32 bits."""
    bits = np.random.PCG64(seed)
    bits.advance(word // 2)
    if word % 2:
        half = int(bits.random_raw()) >> 32
        bits.state = bits.state | {"has_uint32": 1, "uinteger": half}
    return np.random.Generator(bits)


def unused(n: int) -> int:
    """Of 2 ** 32 words, how many a draw from 0 .. n - 1 skips."""
    if not 0 < n < 1 << 32:
        raise ValueError(f"{n} values can't be drawn from by words of 32 bits")
    return ((1 << 32) - n) % n


def used(seed: int, n: int, first: int, words: int, step: int) -> list[int]:
    """Words that draws from 0 .. n - 1 use, in every ``step`` of ``words``; all even."""
    bits, least, out = np.random.PCG64(seed), np.uint32(unused(n)), []
    bits.advance(first // 2)
    for at in range(0, words, step):
        count, end = 0, min(at + step, words)
        for lo in range(at, end, BLOCK):
            w = bits.random_raw(min(BLOCK, end - lo) // 2).view(np.uint32)
            count += int(np.count_nonzero(w * np.uint32(n) >= least))
        out.append(count)
    return out


def starts(spark: SparkSession, wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], dict[int, tuple[int, int]]]:
    """For each (seed, n) and draw: a word at or before it, and how many draws lie between."""
    out: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    tasks, steps = [], {}
    for (seed, n), draws in wanted.items():
        last, skipped = max(draws), unused(n) / 2**32
        if not skipped or not last:
            out[seed, n] = {d: (d, 0) for d in draws}
            continue
        words = last / (1 - skipped)
        step = 2 * max(1 << 19, int(words) // 20_000)
        number = int(words + 12 * (words * skipped) ** 0.5) // step + 2
        steps[seed, n], each = step, -(-number // (1 if number * step <= FEW else 4 * PARTS))
        tasks += [(seed, n, k * step, min(each, number - k) * step, step) for k in range(0, number, each)]
    if sum(t[3] for t in tasks) <= FEW:
        counts = [used(*t) for t in tasks]
    else:
        counts = spark.sparkContext.parallelize(tasks, len(tasks)).map(lambda t: used(*t)).collect()
    for (seed, n), step in steps.items():
        before = np.concatenate([[0], np.cumsum(np.concatenate([c for t, c in zip(tasks, counts) if t[:2] == (seed, n)]))])
        if before[-1] <= max(wanted[seed, n]):
            raise ArithmeticError("more words were skipped than can be")
        at = np.searchsorted(before, wanted[seed, n], side="right") - 1
        out[seed, n] = {d: (int(k) * step, int(d - before[k])) for d, k in zip(wanted[seed, n], at)}
    return out


# vectors


def coded(values: np.ndarray, name: str = "x") -> dict[str, np.ndarray]:
    """A vector for ``Values``: numbers of its distinct values and these, if they are few."""
    values = np.asarray(values, dtype=float)
    table, codes = np.unique(values, return_inverse=True)
    if len(table) > CODES:
        return {name: values}
    return {name: codes.astype(np.uint8 if len(table) <= 256 else np.uint16), f"{name}.table": table}


class Values:
    """Draws from a vector: ``total`` of a replicate, the sum as of an array in that order."""

    def __init__(self, vectors: dict[str, np.ndarray], name: str = "x", exact: bool = True):
        self.codes, self.table = vectors[name], vectors.get(f"{name}.table")
        self.n, self.row, self.exact = len(self.codes), None, None
        if exact and self.table is not None and (np.abs(self.table) <= 60).all() and (2 * self.table == np.rint(2 * self.table)).all():
            self.exact = (2 * self.table).astype(np.int8)[self.codes]  # sums of halves are exact in any order

    def all(self) -> np.ndarray:
        return self.codes if self.table is None else self.table[self.codes]

    def begin(self) -> None:
        self.sum = 0
        if self.exact is None and self.row is None:
            self.row = np.empty(self.n)

    def take(self, lo: int, pick: np.ndarray) -> None:
        if self.exact is not None:
            self.sum += int(self.exact[pick].sum(dtype=np.int64))
        elif self.table is None:
            np.take(self.codes, pick, out=self.row[lo : lo + len(pick)], mode="clip")
        else:
            np.take(self.table, self.codes[pick], out=self.row[lo : lo + len(pick)], mode="clip")

    def total(self) -> float:
        return self.sum / 2 if self.exact is not None else float(self.row.sum())


# forms: what is drawn for a replicate; each returns a row of numbers


class Means:
    """The mean of n values drawn with replacement."""

    #: Signs take every word; hashed draws take none; the cost of a draw decides on tasks.
    signs, hashed, width, cost = False, False, 1, 1

    def __init__(self, vectors: dict):
        self.x = Values(vectors)
        self.parts = [self.x]

    def __call__(self, rng: np.random.Generator) -> tuple:
        n = self.parts[0].n
        for p in self.parts:
            p.begin()
        for lo in range(0, n, BLOCK):
            pick = rng.integers(0, n, size=min(BLOCK, n - lo))
            for p in self.parts:
                p.take(lo, pick)
        return self.found()

    def found(self) -> tuple:
        return (self.x.total() / self.x.n,)


class HashedMeans(Means):
    """The mean of n values drawn by hashes instead of a stream: ``functions.draws``."""

    hashed, cost = True, 20

    def __call__(self, seed: int, replicate: int) -> tuple:
        self.x.begin()
        for lo, words in hashdraws.draws(seed, replicate, self.x.n):
            self.x.take(lo, (words % np.uint32(self.x.n)).astype(np.int64))
        return self.found()


class Pooled(Means):
    """Means of drawn clusters, from the sum and the size of each."""

    def __init__(self, vectors: dict):
        self.x, self.size = Values(vectors), Values(vectors, "size")
        self.parts = [self.x, self.size]

    def found(self) -> tuple:
        return (self.x.total() / self.size.total(),)


class Flips:
    """The total of values under random signs."""

    signs, hashed, width, cost = True, False, 1, 1

    def __init__(self, vectors: dict, name: str = "x"):
        self.values = np.ascontiguousarray(Values(vectors, name).all())
        self.row = np.empty(len(self.values))

    def __call__(self, rng: np.random.Generator) -> tuple:
        # a sign is the first bit of a word; in a double it is the first bit of the second half
        high = self.row.view(np.uint32)[1::2]
        for lo in range(0, len(self.row), BLOCK):
            part = self.row[lo : lo + BLOCK]
            part[:] = self.values[lo : lo + BLOCK]
            word = rng.integers(0, 1 << 32, size=len(part), dtype=np.uint32)
            high[lo : lo + BLOCK] ^= ~word & np.uint32(1 << 31)
        return (float(self.row.sum()),)


@dataclass(frozen=True)
class Draws:
    """``times`` replicates of a form with n draws each. ``names`` are vectors that it reads."""

    form: Callable
    n: int
    times: int
    seed: int
    names: tuple[str, ...] = ("x",)


def _perform(draws: Draws, vectors: dict, count: int, word: int, skip: int, first: int = 0) -> np.ndarray:
    form, rng = draws.form(vectors), generator(draws.seed, word)
    if form.hashed:
        return np.array([form(draws.seed, first + i) for i in range(count)])
    for lo in range(0, skip, BLOCK):
        rng.integers(0, draws.n, size=min(BLOCK, skip - lo))
    out = np.empty((count, form.width))
    for i in range(count):
        out[i] = form(rng)
    return out


def spread(frame: DataFrame, by: list[str], prepare: Callable, plan: Callable, finish: Callable, ddl: str) -> DataFrame:
    """A row, or several, for each group of ``frame``.

    ``prepare(table)`` gives facts about a group and its vectors, in one task a group;
    ``plan(facts)`` says what is to be drawn; ``finish(facts, found)`` makes the rows from an
    array (times, width) for each of these. Facts and what is drawn reach the driver:
    ``times`` numbers a form and group."""
    spark, path = frame.sparkSession, folder(frame.sparkSession, "vectors")

    def store(table: pa.Table) -> pa.Table:
        facts, vectors = prepare(table)
        key, rows = uuid.uuid4().hex, []
        kinds = {name: (v.dtype.str, v.shape) for name, v in vectors.items()}
        rows.append((key, "", 0, pickle.dumps((facts, kinds))))
        for name, v in vectors.items():
            flat = memoryview(np.ascontiguousarray(v)).cast("B") if v.size else memoryview(b"")
            rows += [(key, name, i, bytes(flat[at : at + CHUNK])) for i, at in enumerate(range(0, max(1, len(flat)), CHUNK))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.binary()))], names=["vec", "name", "seq", "data"])

    frame.groupBy(*by).applyInArrow(store, "vec string, name string, seq int, data binary").write.parquet(f"{path}/all")
    stored = spark.read.parquet(f"{path}/all")
    about = {r["vec"]: pickle.loads(r["data"]) for r in stored.where("name = ''").select("vec", "data").collect()}  # a row per group
    plans = {vec: plan(facts) for vec, (facts, _) in about.items()}
    units, wanted = [], {}
    for vec, each in plans.items():
        for k, d in enumerate(each):
            parts = min(PARTS, d.times, max(1, -(-d.times * d.n * d.form.cost // WORK)))
            edges = [d.times * i // parts for i in range(parts + 1)]
            units += [(vec, k, d, lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
            if not (d.form.signs or d.form.hashed):
                wanted.setdefault((d.seed, d.n), []).extend(lo * d.n for lo in edges[:-1])
    begin = starts(spark, wanted)
    work, sent, load, part = {}, [], 0, 0
    for i, (vec, k, d, lo, count) in enumerate(units):
        if load and load + count * d.n * d.form.cost > WORK:
            load, part = 0, part + 1
        load += count * d.n * d.form.cost
        word, skip = (lo * d.n, 0) if d.form.signs or d.form.hashed else begin[d.seed, d.n][lo * d.n]
        work[i] = (vec, k, d, lo, count, word, skip)
        sent += [(vec, name, i, part) for name in about[vec][1] if name.split(".")[0] in d.names]
    kinds = {vec: k for vec, (_, k) in about.items()}

    def draw(batches):
        held: dict[int, dict[str, list]] = {}
        for b in batches:
            for i, name, seq, data in zip(b["unit"].to_pylist(), b["name"].to_pylist(), b["seq"].to_pylist(), b["data"]):
                held.setdefault(i, {}).setdefault(name, []).append((seq, data.as_buffer()))
        for i in sorted(held):
            vec, k, d, lo, count, word, skip = work[i]
            vectors = {}
            for name, pieces in held.pop(i).items():
                kind, shape = kinds[vec][name]
                vectors[name] = np.concatenate([np.frombuffer(p, dtype=np.dtype(kind)) for _, p in sorted(pieces, key=lambda p: p[0])]).reshape(shape)
            found = _perform(d, vectors, count, word, skip, lo)
            yield pa.RecordBatch.from_arrays([pa.array([vec]), pa.array([k], pa.int32()), pa.array([lo], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["vec", "k", "lo", "data"])

    found: dict[tuple[str, int], list] = {}
    if units:
        shares = spark.createDataFrame(sent, "vec string, name string, unit int, part int")
        placed = stored.where("name <> ''").join(F.broadcast(shares), ["vec", "name"]).repartitionById(part + 1, F.col("part"))
        for r in placed.select("unit", "name", "seq", "data").mapInArrow(draw, "vec string, k int, lo bigint, data binary").collect():
            found.setdefault((r["vec"], r["k"]), []).append((r["lo"], r["data"]))
    rows = []
    for vec, (facts, _) in about.items():
        each = [np.frombuffer(b"".join(p for _, p in sorted(found[vec, k]))).reshape(d.times, -1) for k, d in enumerate(plans[vec])]
        rows += finish(facts, each)
    return spark.createDataFrame(rows, ddl)
