"""Substring dedup by level-wise doubling of repeated word windows.

A window is *repeated* if its words occur in a row at two places of the corpus, in two
documents or in one. The result covers exactly the repeated windows of ``min_words``:

1. Windows of half that length are compared at *anchors* only: of every run of
   neighbouring windows the one of least hash, so that equal stretches of ``min_words``
   words hold an equal anchor at the same place, and one window in a dozen is shuffled.
2. Around anchors that repeat, and nowhere else, windows of ``min_words`` are compared.
3. Windows repeated at one length are alone extended to twice that length (all their
   places lie in runs of repeated windows), until no candidate survives.

Documents with the same words are one class with one representative, the least doc_id:
a class of thousands of copies costs as much as one document, and each level moves only
hashes of stretches that repeated at the level before. Counts are aggregated in the map
tasks first, so a passage that a million documents share is one row per task. Windows
found to repeat pass a Bloom filter (16 MB at most) to all workers, so that hardly any
others are shuffled to be joined with them. Documents are joined with the places of their
repeated anchors in the scan while these take up ``broadcast_limit`` bytes, else by shuffle.

Defined cases: null, empty and short texts (under ``min_words`` words) have no window;
rows without doc_id are left out, as no span could be attributed; rows that share doc_id
and words are copies of each other and listed once; rows that share only the doc_id are
documents of their own, whose spans are all listed under it; an empty table gives no
span; other columns are ignored. Words are those of ``textkit``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import remove, settle, workdir
from .textkit import U, fmix64, minimizers, powers, slices, window_starts, windows, words

MIN_WORDS, BROADCAST_LIMIT, SIEVE_BITS = 50, 32 << 20, 27
_TEXT_BASE, _STRETCH = 0xD6E8FEB86659FD93, 1 << 16


def content_hashes(w) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    out = np.zeros(len(w.counts), dtype=U)
    up, _ = powers(_TEXT_BASE, _STRETCH)
    for i, (a, n) in enumerate(zip(w.offsets[:-1].tolist(), w.counts.tolist())):
        for at in range(0, n, _STRETCH):
            part = fmix64(w.hashes[a + at : a + min(n, at + _STRETCH)])
            out[i : i + 1] += (part * up[: len(part)]).sum(dtype=U, keepdims=True) * U(pow(_TEXT_BASE, at, 1 << 64))
    return fmix64(out + w.counts.astype(U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan(docs: DataFrame, base: int, least: int) -> DataFrame:
    """Per document a row with pos = -1, and one row per anchor."""
    kind = docs.schema["doc_id"].dataType

    def scan(batches):
        for b in slices(batches):
            w = words(b["text"])
            cls = content_hashes(w)
            long = w.counts >= least
            at, text = window_starts(w.counts, w.offsets, base)
            use = long[text]
            at, text = at[use], text[use]
            values = windows(w.hashes, base)[at] if len(at) else np.zeros(0, U)
            chosen = minimizers(values, text, least - base + 1)
            docs_at = np.flatnonzero(long)
            who = np.concatenate([docs_at, text[chosen]])
            pos = np.concatenate([np.full(len(docs_at), -1), at[chosen] - w.offsets[text[chosen]]])
            h = np.concatenate([np.zeros(len(docs_at), U), values[chosen]])
            ids = b["doc_id"].take(pa.array(docs_at))
            ids = pa.concat_arrays([ids, pa.nulls(len(chosen), ids.type)])
            yield pa.RecordBatch.from_arrays(
                [_signed(h), ids, _signed(cls[who]), pa.array(w.counts[who].astype(np.int32)), pa.array(pos.astype(np.int32))],
                names=["h", "doc_id", "cls", "n", "pos"],
            )

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(
        scan, f"h bigint, doc_id {kind.simpleString()}, cls bigint, n int, pos int"
    )


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of sorted intervals that overlap or touch."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return starts[first], np.maximum.reduceat(ends, first)


def _regions(found: DataFrame, base: int, least: int, ddl: str) -> DataFrame:
    """The stretches around repeated anchors, as word hashes, one row per document."""

    def cut(batches):
        for b in slices(batches):
            w = words(b["text"])
            cls = content_hashes(w).view(np.int64)
            rows = []
            for r, (doc, want, anchors) in enumerate(zip(b["doc_id"].to_pylist(), b["cls"].to_pylist(), b["anchors"])):
                if cls[r] != want:
                    continue
                n, h = int(w.counts[r]), w.hashes[w.offsets[r] : w.offsets[r + 1]]
                a = np.sort(anchors.values.to_numpy())
                s, e = _merge(np.maximum(a - (least - base), 0), np.minimum(a + least, n))
                keep = e - s >= least
                s, e = s[keep], e[keep]
                if len(s):
                    rows.append((doc, s, e, np.concatenate([h[x:y] for x, y in zip(s.tolist(), e.tolist())])))
            yield _region_batch(rows, b["doc_id"].type)

    return found.mapInArrow(cut, ddl)


def _lists(parts, kind):
    sizes = np.cumsum([0] + [len(p) for p in parts])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.astype(kind)))


def _region_batch(rows, doc_type, extra=None):
    arrays = [
        pa.array([r[0] for r in rows], doc_type),
        _lists([r[1] for r in rows], np.int32),
        _lists([r[2] for r in rows], np.int32),
        pa.array([r[3].tobytes() for r in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "starts", "ends", "words"])


def _split(row_starts, row_ends, blob):
    h = np.frombuffer(blob, dtype=U)
    at = 0
    for s, e in zip(row_starts.tolist(), row_ends.tolist()):
        yield s, e, h[at : at + e - s]
        at += e - s


class _Sieve:
    """A Bloom filter of bounded size over hashes, for the workers: rows that it keeps out
    needn't be shuffled to a join; what it lets through by mistake the join drops."""

    def __init__(self, keys: DataFrame):
        """``keys`` is a written table with a column h."""
        size = 1 << min(SIEVE_BITS, max(16, (12 * keys.count()).bit_length()))

        def places(h):
            h = h.to_numpy().view(U)
            return [(x & U(size - 1)).astype(np.int64) for x in (h, h >> U(64 - SIEVE_BITS))]

        def mark(batches):
            bits = np.zeros(size // 8, dtype=np.uint8)
            for b in batches:
                for at in places(b["h"]):
                    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            pieces = bits.reshape(-1, 1 << 13)
            used = np.flatnonzero(pieces.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([pieces[i].tobytes() for i in used], pa.binary())], names=["piece", "bits"])

        def unite(batches):
            found: dict[int, np.ndarray] = {}
            for b in batches:
                for i, blob in zip(b["piece"].to_pylist(), b["bits"].to_pylist()):
                    piece = np.frombuffer(blob, dtype=np.uint8)
                    found[i] = piece | found[i] if i in found else piece
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["piece", "bits"])

        ddl = "piece int, bits binary"
        bits = np.zeros(size // 8, dtype=np.uint8).reshape(-1, 1 << 13)
        tasks = 2 * keys.sparkSession.sparkContext.defaultParallelism
        for r in keys.select("h").coalesce(tasks).mapInArrow(mark, ddl).repartition("piece").mapInArrow(unite, ddl).collect():  # SIEVE_BITS at most
            bits[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.shared, self.places = keys.sparkSession.sparkContext.broadcast(bits.ravel()), places

    def test(self):
        """What tells, in a worker, which of an array of hashes may be among the keys."""
        shared, places = self.shared, self.places

        def may(h: pa.Array) -> np.ndarray:
            one, two = places(h)
            bits = shared.value
            return ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)

        return may

    def through(self, rows: DataFrame) -> DataFrame:
        may = self.test()

        def scan(batches):
            for b in batches:
                yield b.filter(pa.array(may(b["h"])))

        return rows.mapInArrow(scan, rows.schema)


def _windows_of(regions: DataFrame, length: int, sieve: _Sieve | None = None) -> DataFrame:
    kind = regions.schema["doc_id"].dataType.simpleString()
    may = sieve.test() if sieve else None

    def emit(batches):
        for b in slices(batches, "words", 2 << 20):
            h = np.frombuffer(b"".join(b["words"].to_pylist()), dtype=U)
            starts, ends = b["starts"].flatten().to_numpy(), b["ends"].flatten().to_numpy()
            counts = (ends - starts).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            at, region = window_starts(counts, offsets, length)
            if not len(at):
                continue
            row = np.repeat(np.arange(b.num_rows), np.diff(b["starts"].offsets.to_numpy()))[region]
            pos = (at - offsets[region] + starts[region]).astype(np.int32)
            values = _signed(windows(h, length)[at])
            if may is not None:
                keep = np.flatnonzero(may(values))
                values, row, pos = values.take(pa.array(keep)), row[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([values, b["doc_id"].take(pa.array(row)), pa.array(pos)], names=["h", "doc_id", "pos"])

    return regions.mapInArrow(emit, f"h bigint, doc_id {kind}, pos int")


def _runs(regions: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of each document, and its stretches for the next level."""
    kind = regions.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in slices(batches, "words"):
            rows, runs = [], []
            for doc, s, e, blob, pos, own in zip(b["doc_id"], b["starts"], b["ends"], b["words"], b["pos"], b["own"]):
                p = np.sort(pos.values.to_numpy())
                o = np.sort(own.values.to_numpy())
                first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1] + 1]))
                last = np.concatenate([first[1:], [len(p)]]) - 1
                a, z = p[first], p[last]
                mine = np.searchsorted(o, z, side="right") - np.searchsorted(o, a, side="left")
                runs.append((a, z + length, mine))
                long = z - a >= length
                parts = []
                if long.any():
                    for start, _, h in _split(s.values.to_numpy(), e.values.to_numpy(), blob.as_py()):
                        parts += [h[x - start : y + length - start] for x, y in zip(a[long].tolist(), z[long].tolist()) if start <= x < start + len(h)]
                rows.append((doc.as_py(), a[long], z[long] + length, np.concatenate(parts) if parts else np.zeros(0, U)))
            base = _region_batch(rows, b["doc_id"].type)
            yield pa.RecordBatch.from_arrays(
                [*base.columns, _lists([r[0] for r in runs], np.int32), _lists([r[1] for r in runs], np.int32), _lists([r[2] for r in runs], np.int32)],
                names=[*base.schema.names, "run_start", "run_end", "run_own"],
            )

    return regions.join(hits.hint("shuffle_hash"), "doc_id").select("doc_id", "starts", "ends", "words", "pos", "own").mapInArrow(
        cut, f"doc_id {kind}, starts array<int>, ends array<int>, words binary, run_start array<int>, run_end array<int>, run_own array<int>"
    )


def _spans(runs: DataFrame, least: int) -> DataFrame:
    """Repeated windows of ``least`` words merged to spans, with their highest level."""
    kind = runs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def fold(batches):
        for b in batches:
            out = []
            for doc, each in zip(b["doc_id"].to_pylist(), b["runs"].to_pylist()):
                spans = []
                for r in sorted((r for r in each if r["level"] == least), key=lambda r: r["s"]):
                    n = r["e"] - r["s"] - least + 1
                    if spans and r["s"] <= spans[-1][1]:
                        last = spans[-1]
                        last[1], last[3], last[4] = max(last[1], r["e"]), last[3] + n, last[4] + r["own"]
                    else:
                        spans.append([r["s"], r["e"], least, n, r["own"]])
                starts = [x[0] for x in spans]
                for r in each:
                    span = spans[bisect_right(starts, r["s"]) - 1]
                    span[2] = max(span[2], r["level"])
                out += [(doc, *x) for x in spans]
            cols = list(zip(*out)) if out else [[]] * 6
            types = [arrow] + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start_word", "end_word", "level", "n_windows", "n_first"])

    grouped = runs.groupBy("doc_id").agg(F.collect_list(F.struct("level", "s", "e", "own")).alias("runs"))
    return grouped.mapInArrow(fold, f"doc_id {kind.simpleString()}, start_word int, end_word int, level int, n_windows int, n_first int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, level, n_windows, n_first).

    Spans are unions of overlapping or touching repeated windows of ``min_words`` words,
    counted from 0, end exclusive. ``level`` is the longest length min_words * 2**j of
    which the span holds a repeated window, ``n_windows`` how many windows of
    ``min_words`` it has that are repeated, and ``n_first`` how many of these are the first
    of their copies in (doc_id, place) order: a span with 0 can go without loss."""
    spark = docs.sparkSession
    at = workdir(spark, "substring")
    least, base = min_words, max(1, min_words // 2)
    # a document is known by its id and its words, as ids may repeat
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},cls:bigint>"
    known = F.struct("doc_id", "cls").alias("doc_id")

    scan = settle(_scan(docs, base, least), f"{at}/scan")
    classes = scan.where("pos = -1").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    anchors = scan.where("pos >= 0").select("h", "cls", "n", "pos")
    place = F.struct("cls", "n", "pos")
    again = settle(anchors.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h"), f"{at}/again-{base}")
    hits = _Sieve(again).through(anchors).join(again, "h").groupBy("cls", "n").agg(F.collect_set("pos").alias("anchors"))
    wanted = settle(hits.join(classes, ["cls", "n"]).select(F.col("rep").alias("__gf_rep"), "cls", "anchors"), f"{at}/wanted")
    size = wanted.agg(F.sum(64 + 4 * F.size("anchors"))).first()[0] or 0
    side = F.broadcast(wanted) if size <= broadcast_limit else wanted.hint("shuffle_hash")
    found = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("__gf_rep")).select(known, "text", "cls", "anchors")
    regions = settle(_regions(found, base, least, f"doc_id {kind}, starts array<int>, ends array<int>, words binary"), f"{at}/regions-{least}")
    for part in (f"again-{base}", "wanted"):
        remove(spark, f"{at}/{part}")

    runs, length = None, least
    while not regions.isEmpty():
        spot = F.struct("doc_id", "pos")
        again = _windows_of(regions, length).groupBy("h").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("h", "a")
        sieve = None
        if length == least:  # at later lengths hardly any window is a new one
            again = settle(again, f"{at}/again-{length}")
            sieve = _Sieve(again)
        mine = F.when((F.col("a.doc_id") == F.col("doc_id")) & (F.col("a.pos") == F.col("pos")), F.col("pos"))
        hits = _windows_of(regions, length, sieve).join(again, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("pos"), F.collect_set(mine).alias("own"))
        level = settle(_runs(regions, hits, length), f"{at}/level-{length}")
        each = level.select("doc_id", F.lit(length).alias("level"), F.inline(F.arrays_zip(F.col("run_start").alias("s"), F.col("run_end").alias("e"), F.col("run_own").alias("own")))).select("doc_id", "level", "s", "e", "own")
        runs = each if runs is None else runs.unionByName(each)
        if length == least:
            for part in (f"again-{least}", f"regions-{least}"):
                remove(spark, f"{at}/{part}")
        regions = level.where("size(starts) > 0").select("doc_id", "starts", "ends", "words")
        length *= 2

    members = scan.where("pos = -1").select("doc_id", "cls", "n").join(classes, ["cls", "n"])
    whole = F.lit(least) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / F.lit(float(least))) + F.lit(1e-9)))
    copies = members.where("copies > 1")
    if runs is None:
        out = copies.select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), whole.cast("int").alias("level"), (F.col("n") - least + 1).alias("n_windows"), F.when(F.col("doc_id") == F.col("rep"), F.col("n") - least + 1).otherwise(0).alias("n_first"))
    else:
        spans = _spans(runs.distinct(), least)
        lost = spans.groupBy("doc_id").agg(F.sum(F.col("n_windows") - F.col("n_first")).cast("int").alias("lost")).select(F.col("doc_id.doc_id").alias("rep"), "doc_id.cls", "lost")
        first = F.when(F.col("doc_id") == F.col("rep"), F.col("n") - least + 1 - F.coalesce("lost", F.lit(0))).otherwise(0)
        full = copies.join(lost, ["rep", "cls"], "left").select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), whole.cast("int").alias("level"), (F.col("n") - least + 1).alias("n_windows"), first.alias("n_first"))
        flat = spans.select("doc_id.doc_id", "doc_id.cls", "start_word", "end_word", "level", "n_windows", "n_first")
        single = members.where("copies = 1").select("doc_id", "cls").join(flat, ["doc_id", "cls"]).drop("cls")
        out = full.unionByName(single)
    ints = ["start_word", "end_word", "n_words", "level", "n_windows", "n_first"]
    return out.withColumn("n_words", F.col("end_word") - F.col("start_word")).select("doc_id", *[F.col(c).cast("int").alias(c) for c in ints]).distinct()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(least: int = MIN_WORDS, levels: int = 10) -> str:
    word_list = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    parts = [
        f"""d AS (SELECT doc_id, {word_list} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i:i + {least - 1}], ' ')) AS k
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - {least - 2})) AS i)),
r0 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS o FROM g) WHERE c > 1)"""
    ]
    for j in range(1, levels):
        parts.append(
            f"""r{j} AS (SELECT * FROM (SELECT doc_id, p, k, count(*) OVER (PARTITION BY k) AS c FROM
  (SELECT a.doc_id, a.p, md5(a.k || b.k) AS k FROM r{j - 1} a JOIN r{j - 1} b ON a.doc_id = b.doc_id AND b.p = a.p + {least * 2 ** (j - 1)})) WHERE c > 1)"""
        )
    marks = " UNION ALL ".join(f"SELECT doc_id, p, {least * 2 ** j} AS level FROM r{j}" for j in range(levels))
    return "WITH " + ",\n".join(parts) + f""",
m AS (SELECT doc_id, p, max(level) AS level FROM ({marks}) GROUP BY doc_id, p),
s AS (SELECT r0.doc_id, r0.p, r0.o, m.level,
             CASE WHEN r0.p <= lag(r0.p) OVER (PARTITION BY r0.doc_id ORDER BY r0.p) + {least} THEN 0 ELSE 1 END AS fresh
      FROM r0 JOIN m ON r0.doc_id = m.doc_id AND r0.p = m.p),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM s)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {least} AS INTEGER) AS end_word,
       CAST(max(p) + {least} - min(p) AS INTEGER) AS n_words, CAST(max(level) AS INTEGER) AS level,
       CAST(count(*) AS INTEGER) AS n_windows, CAST(count(*) FILTER (WHERE o = 1) AS INTEGER) AS n_first
FROM t GROUP BY doc_id, span
"""


OP2_SQL = _oracle()
