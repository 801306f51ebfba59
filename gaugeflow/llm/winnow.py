"""Benchmark decontamination by winnowing.

Every run of ``window`` consecutive k-grams (of words, by the rule of ``textkit``) keeps
its least hash. Two texts that share ``k + window - 1`` words in a row share such a run,
so they keep a common fingerprint at the same place: no span of that length is missed.
Documents are joined with the benchmark on fingerprints, and each hit is extended along
its diagonal to the maximal spans of equal words; spans of fewer than ``k + window - 1``
words are left out, so the result is exactly the set of maximal shared spans that long.

The benchmark is sent to every worker while its fingerprints are at most
``broadcast_limit``: then documents are fingerprinted and tested in the scan and nothing
is shuffled. A larger one is joined by shuffling fingerprints (16 bytes per selected
k-gram, about 2 in ``window + 1`` words) and then the texts of the candidate pairs only;
rows are known by a hash of id and text there, so both ways give the same rows.

Defined cases: null and empty texts share nothing; texts of fewer than
``k + window - 1`` words can't hold a span that long; whole texts are read; rows that
repeat a doc_id give their spans each; a null doc_id is reported as null; an empty
benchmark or table gives no span; other columns are ignored (``decontaminate`` keeps
them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import unused
from .textkit import U, minimizers, slices, window_starts, windows, words

K, WINDOW = 8, 6
BROADCAST_LIMIT = 4_000_000


def fingerprints(texts, k: int, window: int):
    """(hash, text, word within the text) of the selected k-grams; the words too."""
    w = words(texts)
    grams = windows(w.hashes, k)
    at, text = window_starts(w.counts, w.offsets, k)
    values = grams[at] if len(at) else np.zeros(0, U)
    chosen = minimizers(values, text, window)
    return values[chosen], text[chosen], at[chosen] - w.offsets[text[chosen]], w


def _diagonal_spans(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int):
    """Maximal runs of equal words of doc[i] and item[i - diagonal]."""
    low, high = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = doc[low:high] == item[low - diagonal : high - diagonal]
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s >= least:
            yield low + s, low + s - diagonal, e - s


class Benchmark:
    """A benchmark's words and fingerprints, for the workers."""

    def __init__(self, ids: list, texts: list, k: int, window: int):
        self.k, self.window, self.ids = k, window, ids
        h, text, pos, w = fingerprints(pa.array(texts, pa.string()), k, window)
        order = np.argsort(h, kind="stable")
        self.hashes, self.text, self.pos = h[order], text[order], pos[order]
        self.words, self.offsets = w.hashes, w.offsets

    def spans(self, texts):
        """(text index, item index, doc start, item start, words) of every span."""
        h, text, pos, w = fingerprints(texts, self.k, self.window)
        left = np.searchsorted(self.hashes, h, side="left")
        right = np.searchsorted(self.hashes, h, side="right")
        hit = np.flatnonzero(right > left)
        times = (right - left)[hit]
        mine = np.repeat(hit, times)
        other = np.repeat(left[hit], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        found = np.unique(np.stack([text[mine], self.text[other], pos[mine] - self.pos[other]], axis=1), axis=0) if len(mine) else []
        least = self.k + self.window - 1
        for t, i, diagonal in (found.tolist() if len(found) else []):
            doc = w.hashes[w.offsets[t] : w.offsets[t + 1]]
            item = self.words[self.offsets[i] : self.offsets[i + 1]]
            for a, b, n in _diagonal_spans(doc, item, diagonal, least):
                yield t, i, a, b, n


def _small(benchmark: DataFrame, limit: int) -> bool:
    """Whether the benchmark's fingerprints surely stay under ``limit`` (a word has a byte
    at least and is followed by one)."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size / 2 <= limit


def _collected(benchmark: DataFrame, k: int, window: int) -> Benchmark:
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").collect()
    return Benchmark([r[0] for r in rows], [r[1] for r in rows], k, window)


def _types(docs: DataFrame, benchmark: DataFrame):
    d, i = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    ddl = f"doc_id {d.simpleString()}, item_id {i.simpleString()}, doc_start int, item_start int, n_words int"
    return ddl, to_arrow_type(d), to_arrow_type(i)


def _span_batch(rows, d, i):
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [d, i, pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): the maximal spans of at least
    ``k + window - 1`` words that a document shares with a benchmark text, counted in
    words from 0."""
    ddl, d_type, i_type = _types(docs, benchmark)
    if not _small(benchmark, broadcast_limit):
        return _spans_by_shuffle(docs, benchmark, k, window, ddl, d_type, i_type).drop("doc_row")
    shared = docs.sparkSession.sparkContext.broadcast(_collected(benchmark, k, window))

    def scan(batches):
        test = shared.value
        for b in slices(batches):
            ids = b["doc_id"]
            rows = [(ids[t].as_py(), test.ids[i], s, at, n) for t, i, s, at, n in test.spans(b["text"])]
            if rows:
                yield _span_batch(rows, d_type, i_type)

    return docs.select("doc_id", "text").mapInArrow(scan, ddl)


def _rows(df: DataFrame, key: str, row: str) -> DataFrame:
    """The ids and texts of ``df`` with a number of each row, the same for equal rows."""
    return df.where("text IS NOT NULL").select(F.xxhash64(key, "text").alias(row), key, "text")


def _printed(df: DataFrame, key: str, k: int, window: int) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def scan(batches):
        for b in slices(batches):
            h, text, pos, _ = fingerprints(b["text"], k, window)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b[key].take(pa.array(text)), pa.array(pos.astype(np.int32))], names=["h", key, "pos"])

    return df.select(key, "text").mapInArrow(scan, f"h bigint, {key} {kind}, pos int")


def _spans_by_shuffle(docs, benchmark, k, window, ddl, d_type, i_type) -> DataFrame:
    docs, benchmark = _rows(docs, "doc_id", "doc_row"), _rows(benchmark, "item_id", "item_row")
    a = _printed(docs, "doc_row", k, window)
    b = _printed(benchmark, "item_row", k, window).withColumnRenamed("pos", "item_pos")
    pairs = a.join(b, "h").select("doc_row", "item_row", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    both = (
        pairs.join(docs, "doc_row")
        .join(benchmark.withColumnRenamed("text", "item_text"), "item_row")
        .select("doc_row", "doc_id", "item_id", "diagonal", "text", "item_text")
    )
    least = k + window - 1

    def extend(batches):
        for batch in slices(batches):
            mine, other = words(batch["text"]), words(batch["item_text"])
            rows, places = [], []
            for r, (doc, item, diagonal) in enumerate(zip(batch["doc_id"].to_pylist(), batch["item_id"].to_pylist(), batch["diagonal"].to_pylist())):
                x = mine.hashes[mine.offsets[r] : mine.offsets[r + 1]]
                y = other.hashes[other.offsets[r] : other.offsets[r + 1]]
                rows += [(doc, item, s, at, n) for s, at, n in _diagonal_spans(x, y, diagonal, least)]
                places += [r] * (len(rows) - len(places))
            if rows:
                found = _span_batch(rows, d_type, i_type)
                yield pa.RecordBatch.from_arrays([batch["doc_row"].take(pa.array(places)), *found.columns], names=["doc_row", *found.schema.names])

    return both.mapInArrow(extend, f"doc_row bigint, {ddl}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The documents that share no span with the benchmark, all columns as they are."""
    if not _small(benchmark, broadcast_limit):
        row, doc = unused(docs, "__gf_row", "__gf_bad")
        bad = _spans_by_shuffle(docs, benchmark, k, window, *_types(docs, benchmark)).select(F.col("doc_row").alias(row), F.col("doc_id").alias(doc)).distinct()
        same = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col(row)) & docs["doc_id"].eqNullSafe(F.col(doc))
        return docs.join(bad.hint("shuffle_hash"), same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_collected(benchmark, k, window))
    at = docs.columns.index("text")

    def scan(batches):
        test = shared.value
        for b in slices(batches):
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[t for t, *_ in test.spans(b.column(at))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS_SQL = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {K + WINDOW - 2}], ' ') AS g
       FROM d, LATERAL (SELECT unnest(range(1, len(w) - {K + WINDOW - 2} + 1)) AS i)),
bg AS (SELECT item_id, i - 1 AS p, array_to_string(w[i:i + {K + WINDOW - 2}], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - {K + WINDOW - 2} + 1)) AS i)),
hits AS (SELECT doc_id, item_id, dg.p AS dp, bg.p AS bp FROM dg JOIN bg USING (g)),
runs AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY dp) AS run FROM hits)
SELECT doc_id, item_id, CAST(min(dp) AS INTEGER) AS doc_start, CAST(min(bp) AS INTEGER) AS item_start,
       CAST(count(*) + {K + WINDOW - 2} AS INTEGER) AS n_words
FROM runs GROUP BY doc_id, item_id, dp - bp, run
"""
