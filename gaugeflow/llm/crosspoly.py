"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; the hash
of a unit vector is the signed axis that its rotation is nearest to, one of 2 d values,
or that of each of ``axes`` rotations, (2 d) ** axes values. Each of ``tables`` tables has
its own rotations. A vector is stored once per table, in its bucket; a query probes its
``probes`` nearest buckets of each, and what it meets there is ranked by exact cosine.

Probing costs the queries only, storing every row. The index is fitted: for ``sample``
queries, chosen by hash, the exact neighbours are looked up among all rows, and of a grid
of axes, tables and probes the cheapest is taken that puts the share ``recall`` of these
neighbours into probed buckets, at most half of a table's. So recall is held at any size; what it costs depends on
how near neighbours are (where they are hardly nearer than other vectors, a query has to
meet a constant share of the rows with any index).

Queries that met fewer than ``least`` rows a table search again with one axis less, in the
end all rows (which in a small table is at once the case), so that k rows come whenever k
others exist.

Neighbouring buckets of a table, some ``block`` stored vectors, are one group of rows; a
group that holds more, as of near copies, is cut into blocks by hash, each met by all of
its queries. Stored vectors of a block are held by one task, queries stream past them, no
pair is ever a row, and only the best of a query leave. Rows of equal vectors are one
class, stored once with its k + 1 least ids (no other can be among the best of anyone) and
asked once, so that any number of copies costs one row.

Defined cases: a null or empty vector, one of length 0, one with a value that isn't
finite, or of another dimension than the table's most frequent one, is no query and no
neighbour; a vector isn't its own neighbour, but another row of the same vector is; rows
that repeat a vec_id are one vector (of them the greatest); rows without vec_id are left
out; ties of cosine (to nine decimals) go to the lesser vec_id; a query gets fewer than k
rows only if fewer others exist; an empty table gives none; other columns are ignored;
vec_id may be of any type that can be ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle, workdir

K, BLOCK, LEAST, SAMPLE, RECALL = 10, 1 << 14, 512, 256, 0.97
MOST_AXES, MOST_TABLES, MOST_PROBES = 3, 16, 256
MOST_EACH = 48  # axes of each rotation that the probes of several combine
MOVE, MEET = 20.0, 0.03  # microseconds to move a row and to compare two, about


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([(y[:, :, 0] + y[:, :, 1])[:, :, None], (y[:, :, 0] - y[:, :, 1])[:, :, None]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotation number ``seed`` of the rows, filled up to a power of two."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), (3, size))
    y = np.zeros((n, size), dtype=np.float32)
    y[:, :d] = x
    for s in signs:
        y = hadamard(y * s) / np.float32(np.sqrt(size))
    return y


def axes_of(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each row, best first, and their coordinates."""
    both = np.concatenate([y, -y], axis=1)
    best = np.argpartition(-both, min(probes, both.shape[1] - 1), axis=1)[:, :probes]
    value = np.take_along_axis(both, best, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)


def width_of(d: int) -> int:
    """Signed axes of a rotation of vectors of ``d`` values."""
    return 2 * (1 << max(0, (d - 1).bit_length()))


def buckets(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """(n, probes) buckets of a table, the own one first: with several axes, those of the
    greatest sums of coordinates. Without an axis all rows are in one bucket."""
    if not axes:
        return np.zeros((len(x), 1), dtype=np.int64)
    each = probes if axes == 1 else min(probes, MOST_EACH)
    parts = [axes_of(rotated(x, 1009 * table + a), each) for a in range(axes)]
    code, value = parts[0][0].astype(np.int64), parts[0][1]
    for c, v in parts[1:]:
        code = (code[:, :, None] * width_of(x.shape[1]) + c[:, None, :]).reshape(len(x), -1)
        value = (value[:, :, None] + v[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-value, axis=1, kind="stable")[:, :probes]
        code, value = np.take_along_axis(code, order, axis=1), np.take_along_axis(value, order, axis=1)
    return code


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, d)


def _unit(vectors: DataFrame, kind: str, d: int) -> DataFrame:
    def scan(batches):
        for b in batches:
            x = np.array(b["v"].flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            unit = (x[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)  # no negative zeros: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(ok)), pa.array([u.tobytes() for u in unit], pa.binary())], names=["vec_id", "v"])

    return vectors.mapInArrow(scan, f"vec_id {kind}, v binary")


def _words(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per row, of the 64-bit numbers between its offsets."""
    values = np.ascontiguousarray(values, dtype=np.int64)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _exact(rows: DataFrame, sample: list, d: int, k: int) -> list[np.ndarray]:
    """The vectors of the k nearest classes of each sampled one: one scan of all rows."""
    own = {bytes(r["v"]): i for i, r in enumerate(sample)}
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def scan(batches):
        own = shared.value
        q = np.frombuffer(b"".join(own), dtype=np.float32).reshape(-1, d).T
        best: list[list[tuple[float, bytes]]] = [[] for _ in own]
        for b in batches:
            blobs = b["v"].to_pylist()
            for at in range(0, len(blobs), 4096):
                part = blobs[at : at + 4096]
                sims = (np.frombuffer(b"".join(part), dtype=np.float32).reshape(-1, d) @ q).T
                for row, v in enumerate(part):
                    if v in own:
                        sims[own[v], row] = -2
                near = np.argpartition(-sims, min(k, len(part) - 1), axis=1)[:, :k]
                for i, columns in enumerate(near):
                    best[i] = sorted(best[i] + [(float(sims[i, c]), part[c]) for c in columns if sims[i, c] >= -1.5], reverse=True)[:k]
        found = [(i, s, v) for i, each in enumerate(best) for s, v in each]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.binary())], names=["i", "s", "v"])

    top = rows.select("v").mapInArrow(scan, "i int, s double, v binary").withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k)
    out: list[list[bytes]] = [[] for _ in sample]
    for r in top.select("i", "v").collect():  # k rows a sampled query
        out[r["i"]].append(bytes(r["v"]))
    return [np.frombuffer(b"".join(v), dtype=np.float32).reshape(-1, d) for v in out]


def fitted(queries: np.ndarray, near: list[np.ndarray], n: int, share: float, block: int, recall: float) -> tuple[int, int, int]:
    """(axes, tables, probes): the cheapest by which the neighbours ``near`` of the queries
    are met, for n rows of which ``share`` are queries."""
    d, width = queries.shape[1], width_of(queries.shape[1])
    who, x = np.repeat(np.arange(len(near)), [len(v) for v in near]), np.concatenate(near)
    best, choice = np.inf, (1, 1, width)  # meets all rows
    for axes in range(1, MOST_AXES + 1):
        most = min(MOST_PROBES, width**axes // 2)
        place = np.full(len(x), most, dtype=np.int64)  # of a neighbour's bucket among the query's, in the best table so far
        for t in range(MOST_TABLES):
            if (t + 1) * MOVE >= best:
                break
            own = buckets(x, t, axes, 1)[:, 0]
            for lo in range(0, len(queries), 32):
                probed = buckets(queries[lo : lo + 32], t, axes, most)
                mine = np.flatnonzero((who >= lo) & (who < lo + 32))
                hit = probed[who[mine] - lo] == own[mine, None]
                place[mine] = np.minimum(place[mine], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            probes = int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1 if len(place) else 1
            if probes > most:
                continue
            groups = min(probes, max(1, min(width**axes, n // block)))
            cost = (t + 1) * (MOVE + share * (probes * n / width**axes * MEET + groups * MOVE))
            if cost < best:
                best, choice = cost, (axes, t + 1, probes)
        if n <= width**axes:
            break
    return choice


class _Layout:
    """Which rows go to which group, for a number of axes."""

    def __init__(self, d: int, n: int, axes: int, tables: int, probes: int, block: int):
        self.d, self.axes, self.tables, self.probes = d, axes, tables if axes else 1, probes
        codes = width_of(d) ** axes
        self.per = -(-codes // max(1, min(codes, n // block)))  # bucket numbers per group

    def counts(self, rows: DataFrame) -> DataFrame:
        """(t, g, n): stored rows of each group, summed up by task."""

        def scan(batches):
            total: dict[tuple[int, int], int] = {}
            for b in batches:
                x = _matrix(b["v"], self.d)
                for t in range(self.tables):
                    g, n = np.unique(buckets(x, t, self.axes, 1)[:, 0] // self.per, return_counts=True)
                    for k, c in zip(g.tolist(), n.tolist()):
                        total[t, k] = total.get((t, k), 0) + c
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["t", "g", "n"])

        return rows.select("v").mapInArrow(scan, "t int, g bigint, n bigint").groupBy("t", "g").agg(F.sum("n").alias("n"))

    def placed(self, rows: DataFrame, kind: str) -> DataFrame:
        """(t, g, asked, cid, v, ids, codes): a row per table and stored class, and one per
        table and group that an asked class probes, with the buckets that it probes there."""

        def batch(t, g, asked, cid, v, ids, codes):
            n = len(g)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(t, pa.int32()), n), pa.array(g), pa.repeat(pa.scalar(asked, pa.int32()), n), cid, v, ids, codes], names=["t", "g", "asked", "cid", "v", "ids", "codes"])

        def scan(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    x = _matrix(b["v"], self.d)
                    ask = np.flatnonzero(b["asked"].to_numpy(zero_copy_only=False))
                    for t in range(self.tables):
                        own = buckets(x, t, self.axes, 1)[:, 0]
                        yield batch(t, own // self.per, 0, b["cid"], b["v"], b["ids"], _words(own, np.arange(len(own) + 1)))
                        if not len(ask):
                            continue
                        codes = np.sort(buckets(x[ask], t, self.axes, self.probes), axis=1)
                        g, row = (codes // self.per).ravel(), np.repeat(np.arange(len(ask)), codes.shape[1])
                        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]))
                        who = pa.array(ask[row[first]])
                        yield batch(t, g[first], 1, b["cid"].take(who), b["v"].take(who), pa.nulls(len(who), b["ids"].type), _words(codes.ravel(), np.append(first, codes.size)))

        return rows.select("cid", "v", "ids", "asked").mapInArrow(scan, f"t int, g bigint, asked int, cid {kind}, v binary, ids array<{kind}>, codes binary")


def _best(sims: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row; ties to the lesser rank."""
    k = min(k, sims.shape[1])
    if sims.shape[1] > 4 * k:
        near = np.argpartition(-sims, 2 * k, axis=1)[:, : 2 * k]
        edge = np.take_along_axis(sims, near, axis=1).min(axis=1)
        if ((sims >= edge[:, None]).sum(axis=1) == 2 * k).all():
            s = np.take_along_axis(sims, near, axis=1)
            order = np.lexsort((rank[near], -s), axis=1)[:, :k]
            return np.take_along_axis(near, order, axis=1)
    return np.lexsort((np.broadcast_to(rank, sims.shape), -sims), axis=1)[:, :k]


class _Block:
    """The stored classes of a block, by bucket."""

    def __init__(self, parts: list[pa.RecordBatch], d: int):
        table = pa.Table.from_batches(parts).combine_chunks()
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.x = codes[order], _matrix(table["v"], d)[order].astype(np.float64)
        rank = np.empty(len(codes), dtype=np.int64)
        rank[pc.sort_indices(table["cid"]).to_numpy()] = np.arange(len(codes))
        self.rank, self.ids = rank[order], table["ids"].combine_chunks().take(pa.array(order))

    def best(self, asked: pa.RecordBatch, d: int, k: int):
        """Per asked row: rows met, and the ids and cosines of the k best classes' rows."""
        x = _matrix(asked["v"], d).astype(np.float64)
        blobs = asked["codes"].to_pylist()
        size = np.array([len(b) // 8 for b in blobs])
        code, row = np.frombuffer(b"".join(blobs), dtype=np.int64), np.repeat(np.arange(len(x)), size)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        met, rows, columns, sims = np.zeros(len(x), np.int64), [], [], []
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(code)]):
            lo, hi = np.searchsorted(self.codes, code[a], "left"), np.searchsorted(self.codes, code[a], "right")
            if hi == lo:
                continue
            r = row[a:z]
            met[r] += hi - lo
            s = np.round(x[r] @ self.x[lo:hi].T, 9)
            at = _best(s, self.rank[lo:hi], k)
            rows.append(np.repeat(r, at.shape[1]))
            columns.append((lo + at).ravel())
            sims.append(np.take_along_axis(s, at, axis=1).ravel())
        if not rows:
            return None
        row, column, sim = np.concatenate(rows), np.concatenate(columns), np.concatenate(sims)
        order = np.lexsort((self.rank[column], -sim, row))
        row, column, sim = row[order], column[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, column, sim = row[place < k], column[place < k], sim[place < k]
        ids = self.ids.take(pa.array(column))
        each = np.diff(ids.offsets.to_numpy())
        row, sim, found = np.repeat(row, each), np.repeat(sim, each), ids.flatten()
        offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([asked["cid"], pa.array(met), pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(offsets, pa.array(sim))], names=["q", "met", "n", "s"])


def _search(rows: DataFrame, kind: str, layout: _Layout, k: int, block: int, at: str) -> DataFrame:
    """(q, met, n, s): what each asked class met in each block, and the best of it."""
    full = settle(layout.counts(rows).where(F.col("n") > block).select("t", "g", F.ceil(F.col("n") / block).cast("int").alias("blocks")), f"{at}/full")
    placed = layout.placed(rows, kind)
    if full.isEmpty():
        placed = placed.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.when(F.col("asked") == 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), blocks).cast("int")))
        placed = placed.join(full, ["t", "g"], "left").select(*placed.columns, F.explode(own).alias("block"))
    d = layout.d

    def meet(batches):
        held, parts, store = None, [], None
        for b in batches:
            key = np.stack([b[c].to_numpy() for c in ("t", "g", "block", "asked")], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
            for lo, hi in zip(cut, [*cut[1:], len(key)]):
                group, piece = tuple(key[lo, :3].tolist()), b.slice(lo, hi - lo)
                if not key[lo, 3]:
                    if group != held:
                        held, parts = group, []
                    parts.append(piece)
                    store = None
                elif group == held:
                    store = store or _Block(parts, d)
                    for i in range(0, piece.num_rows, 512):
                        out = store.best(piece.slice(i, 512), d, k)
                        if out is not None:
                            yield out

    grouped = placed.repartition("t", "g", "block").sortWithinPartitions("t", "g", "block", "asked")
    return settle(grouped.mapInArrow(meet, f"q {kind}, met bigint, n array<{kind}>, s array<double>"), f"{at}/found")


def neighbours(
    vectors: DataFrame, k: int = K, queries: str | Column | None = None, index: tuple[int, int, int] | None = None,
    block: int = BLOCK, least: int = LEAST, sample: int = SAMPLE, recall: float = RECALL,
) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine) of the k nearest found among all rows for every
    row that meets the condition ``queries`` on vec_id (all rows if there is none).
    ``index`` gives axes, tables and probes instead of a fit."""
    spark = vectors.sparkSession
    at = workdir(spark, "crosspoly")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    full = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    common = full.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {kind}, neighbour_id {kind}, rank int, cosine double"
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    one = full.where(F.size("embedding") == d).groupBy("vec_id").agg(F.max("embedding").alias("v"))
    units = settle(_unit(one, kind, d), f"{at}/units")
    members = units if queries is None else units.where(queries)
    # the limit on the row number is applied before the shuffle as well as after it
    least_ids = units.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    every = least_ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = members.select("v").distinct().withColumn("asked", F.lit(True))
    classes = rows = settle(every.join(asked, "v", "left").select(F.col("ids")[0].alias("cid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), f"{at}/classes")
    n, asking = rows.agg(F.count("*"), F.count_if("asked")).first()
    if index is None and n > least:
        drawn = rows.where("asked").orderBy(F.xxhash64("v"), "v").select("v").limit(sample).collect()
        near = _exact(rows, drawn, d, k) if drawn else []
        index = fitted(_matrix(pa.array([bytes(r["v"]) for r in drawn]), d), near, n, asking / n, block, recall) if near else None
    axes, tables, probes = index or (0, 1, 1)

    found = []
    for a in range(axes, -1, -1):
        layout = _Layout(d, n, a, tables, probes, block)
        found.append(_search(rows, kind, layout, k + 1, block, f"{at}/axes-{a}"))
        if not a:
            break
        met = found[-1].groupBy(F.col("q").alias("cid")).agg(F.sum("met").alias("met"))
        short = rows.where("asked").select("cid").join(met, "cid", "left").where(F.coalesce("met", F.lit(0)) < max(least, k + 1) * layout.tables)
        short = settle(short.select("cid", F.lit(True).alias("asked")), f"{at}/short-{a}")
        if short.isEmpty():
            break
        rows = rows.drop("asked").join(short, "cid", "left").select("cid", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))

    each = found[0].select("q", "n", "s")
    for f in found[1:]:
        each = each.unionByName(f.select("q", "n", "s"))
    each = each.select("q", F.inline(F.arrays_zip("n", "s"))).repartition("q").groupBy("q", F.col("n").alias("neighbour_id")).agg(F.max("s").alias("cosine"))
    rank = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.desc("cosine"), "neighbour_id"))
    top = each.withColumn("r", rank("q")).where(F.col("r") <= k + 1).drop("r")
    who = members.join(classes.select("v", F.col("cid").alias("q")), "v").select("vec_id", "q")
    out = who.join(top, "q").where("neighbour_id <> vec_id").withColumn("rank", rank("vec_id")).where(F.col("rank") <= k)
    return out.select("vec_id", "neighbour_id", "rank", "cosine")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries="vec_id % 20 = 0")
