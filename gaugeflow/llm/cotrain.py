"""Quality classifier by co-training of two views of a document.

The *text view* sees the words: which words occur, which first four bytes of words, and
how often words repeat. The *metadata view* sees what the page is like without reading
it: source, language, length, and its layout (lines, capitals, digits, symbols,
separators). Each view is a logistic regression over hashed binary features.

A document is good if its label says quality 1 and not toxic. Both views are fitted on
labelled documents; then, in each round, each labels the unlabelled documents of which it
is confident, these join the other view's training set, and both are fitted again. At
last each view is calibrated on labelled documents that no fit has seen (Platt scaling),
and a regression over the two calibrated scores and the lesser of them combines the views.

Labelled documents are a bounded sample by hash of doc_id (``max_labelled``, a fifth of
them held out), whose feature numbers reach the driver. Unlabelled ones all take part:
their feature numbers are written once; each round scans them to label them and count
their features, then for each but the first of ``SCANS`` steps for the gradient over all
confident ones, of which only sums reach the driver. A confident document weighs half a
labelled one. Scoring takes the same feature numbers, or those of other documents, in
the scan and without a shuffle.

Defined cases: a null text counts as empty; null sources and languages are values of
their own; labels with a null are not used, and of several labels of a document the worst
counts; rows that repeat a doc_id are scored each; a null doc_id is scored, but never
trains; without labels of both kinds every score is 0.5 and every document is kept; an
empty table gives an empty result; other columns are ignored (``drop_rejected`` keeps
them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import remove, settle, workdir
from .textkit import U, as_array, fmix64, pieces, slices, utf8_bytes, words

TEXT_BITS, META_BITS = 18, 12
MAX_LABELLED, ROUNDS, SCANS, CONFIDENT, BROADCAST_LABELS = 16_000, 2, 16, 0.97, 4_000_000
SLICE = 1 << 14  # feature sums are added up in pieces of so many
RUN = 1 << 20


@dataclass
class Sparse:
    """Binary rows: row i has the features ``index[offsets[i]:offsets[i + 1]]``."""

    index: np.ndarray
    offsets: np.ndarray

    def _runs(self):
        """Runs of rows of about RUN features, so that what is made of them stays small."""
        a, n = 0, len(self.offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + RUN, side="right")) - 1)
            yield a, min(b, n)
            a = b

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.offsets)[rows]
        parts = [np.zeros(0, self.index.dtype)]
        for i in range(0, len(rows), 1024):
            own = size[i : i + 1024]
            at = np.repeat(self.offsets[rows[i : i + 1024]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            parts.append(self.index[at])
        return Sparse(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's features."""
        out = np.zeros(len(self.offsets) - 1)
        for a, b in self._runs():
            sums = np.concatenate([[0.0], np.cumsum(w[self.index[self.offsets[a] : self.offsets[b]]])])
            at = self.offsets[a : b + 1] - self.offsets[a]
            out[a:b] = sums[at[1:]] - sums[at[:-1]]
        return out

    def scatter(self, values: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows' values over each feature."""
        out = np.zeros(size)
        for a, b in self._runs():
            weights = np.repeat(values[a:b], np.diff(self.offsets[a : b + 1]))
            out += np.bincount(self.index[self.offsets[a] : self.offsets[b]], weights=weights, minlength=size)
        return out

    @staticmethod
    def of(rows: np.ndarray, index: np.ndarray, n: int) -> Sparse:
        """From (row, feature) pairs, repeated ones once."""
        key = np.unique((rows.astype(np.int64) << 32) | index.astype(np.int64))
        size = np.bincount(key >> 32, minlength=n)
        return Sparse((key & 0xFFFFFFFF).astype(np.int32), np.concatenate([[0], np.cumsum(size)]))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(1 + np.maximum(x, 0))).astype(np.int64)


def _hashed(kind: int, values: np.ndarray, bits: int) -> np.ndarray:
    return (fmix64(values.astype(np.int64).view(U) + U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) & U((1 << bits) - 1)).astype(np.int64)


def text_view(texts) -> Sparse:
    w = words(texts, prefix=4)
    n, doc = len(w.counts), w.text_of_word()
    low = U((1 << TEXT_BITS) - 1)
    rows, index = [doc, doc], [(w.hashes & low).astype(np.int64), (fmix64(w.prefixes) & low).astype(np.int64)]
    key = np.unique((doc.astype(U) << U(40)) | (w.hashes >> U(24)))
    distinct = np.bincount((key >> U(40)).astype(np.int64), minlength=n)
    ratio = np.floor(20 * distinct / np.maximum(w.counts, 1)).astype(np.int64)
    every = np.arange(n)
    for kind, value in ((1, ratio), (2, ratio * 64 + _bucket(w.counts) // 4)):
        rows.append(every)
        index.append(_hashed(kind, value, TEXT_BITS))
    return Sparse.of(np.concatenate(rows), np.concatenate(index), n)


_CLASSES = np.zeros(256, dtype=np.int8)
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
for _c in "!?":
    _CLASSES[ord(_c)] = 3
for _c in "%$#&*@^~<>{}[]\\/=+_":
    _CLASSES[ord(_c)] = 4
for _c in "|\t;":
    _CLASSES[ord(_c)] = 5
_CLASSES[ord("\n")] = 6
_CLASSES[ord(" ")] = 7
for _c in ".,":
    _CLASSES[ord(_c)] = 8


def metadata_view(texts, sources, langs) -> Sparse:
    texts = as_array(texts)
    n = len(texts)
    counts = np.zeros((n, 9), dtype=np.int64)
    for i, j, part in pieces(texts):
        raw, offsets = utf8_bytes(part)
        text = np.repeat(np.arange(j - i), np.diff(offsets))
        counts[i:j] += np.bincount(text * 9 + _CLASSES[raw], minlength=9 * (j - i)).reshape(j - i, 9)
    size = counts.sum(axis=1)
    every = np.arange(n)
    index = [_hashed(10, _bucket(size), META_BITS), _hashed(11, _bucket(counts[:, 6]), META_BITS), _hashed(12, _bucket(size / (1 + counts[:, 6])), META_BITS)]
    for c in (1, 2, 3, 4, 5, 7, 8):
        index.append(_hashed(20 + c, _bucket(1000 * counts[:, c] / np.maximum(size, 1)), META_BITS))
    for kind, column in ((40, sources), (41, langs)):
        names = column.dictionary_encode()
        values = words(names.dictionary.cast(pa.string())).hashes
        size_of = words(names.dictionary.cast(pa.string())).offsets
        sums = np.array([values[a:b].sum(dtype=U) for a, b in zip(size_of[:-1], size_of[1:])] + [U(1)], dtype=U)
        at = names.indices.fill_null(len(sums) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        index.append(_hashed(kind, sums[at].view(np.int64), META_BITS))
    return Sparse.of(np.tile(every, len(index)), np.concatenate(index), n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, size: int, more: tuple | None = None, steps: int = 40, ridge: float = 1.0, least_rows: int = 3, rate: float = 0.1):
    """Logistic regression by full-batch Adagrad; the last weight is the intercept.

    Each feature is scaled by the square of its log odds ratio (add-one smoothed), and
    those of fewer than ``least_rows`` rows by 0: otherwise the fit explains its rows by
    the words that only they have. ``more`` has the sums (good, bad) over further rows by
    feature, the numbers of rows last. A generator: it gives the weights after each step
    that needs the gradient over further rows, which is to be sent, and after the last."""
    good, bad = x.scatter(y, size), x.scatter(1 - y, size)
    n_good, n_bad, rows, n = y.sum(), (1 - y).sum(), good + bad, len(y)
    if more is not None:
        rows = rows + more[0][:-1] + more[1][:-1]
        good, bad = good + 0.5 * more[0][:-1], bad + 0.5 * more[1][:-1]
        n_good, n_bad = n_good + 0.5 * more[0][-1], n_bad + 0.5 * more[1][-1]
        n = n_good + n_bad
    scale = np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))
    scale = np.append(scale * scale, 1.0)
    scale[:-1][rows < least_rows] = 0
    v, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for step in range(steps):
        w = v * scale
        if more is not None:  # all weights are 0 at first, and the sums give the gradient
            further = (yield w) if step else 0.5 * (more[1] - more[0])
        error = _sigmoid(x.dot(w[:-1]) + w[-1]) - y
        g = np.append(x.scatter(error, size), error.sum())
        if more is not None:
            g += 0.5 * further
        g = g / n * scale
        g[:-1] += ridge * v[:-1] / n
        seen += g * g
        v -= rate * g / np.sqrt(seen)
    yield v * scale


def score(x: Sparse, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


def _dense_fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression of a few columns, by Newton steps with a little ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    """Both views, their calibration (slope, intercept) and the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray

    def predict(self, texts, sources, langs):
        """Calibrated probabilities to be good: text view, metadata view, both."""
        return self.combine(text_view(texts), metadata_view(texts, sources, langs))

    def combine(self, text: Sparse, meta: Sparse):
        zt = score(text, self.text) * self.text_scale[0] + self.text_scale[1]
        zm = score(meta, self.meta) * self.meta_scale[0] + self.meta_scale[1]
        both = np.column_stack([zt, zm, np.minimum(zt, zm), np.ones(len(zt))]) @ self.mix
        return _sigmoid(zt), _sigmoid(zm), _sigmoid(both)


def _hash_below(column: str, share: float):
    unit = F.pmod(F.xxhash64(F.lit("co-training"), column), F.lit(1 << 30)) / float(1 << 30)
    return unit < share


def _sparse(column) -> Sparse:
    """Rows of feature numbers, each one binary value of 32-bit numbers."""
    column = as_array(column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Sparse(raw.view(np.int32), (offsets - offsets[0]) // 4)


def _blobs(v: Sparse) -> pa.Array:
    offsets = pa.py_buffer((4 * v.offsets).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(v.offsets) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(v.index, dtype=np.int32).tobytes())])


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): the feature numbers of both views."""

    def scan(batches):
        for b in slices(batches):
            t, m = text_view(b["text"]), metadata_view(b["text"], b["source"], b["lang"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], _blobs(t), _blobs(m)], names=["doc_id", "t", "m"])

    return docs.select("doc_id", "text", "source", "lang").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t binary, m binary")


def _prepared(docs: DataFrame, labels: DataFrame, at: str, broadcast_labels: int) -> tuple[DataFrame, int]:
    """(doc_id, t, m, y) of every document, written below ``at``; y is null for unlabelled
    ones. And how many documents the labels name. Labels are sent to the scan while they
    are at most ``broadcast_labels`` rows, else joined by shuffle."""
    rated = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("y"))
    )
    rated = settle(rated, f"{at}/rated")
    n_labels = rated.count()
    side = F.broadcast(rated) if n_labels <= broadcast_labels else rated
    return settle(_featured(docs).join(side, "doc_id", "left").select("doc_id", "t", "m", "y"), f"{at}/features"), n_labels


def _labelled(features: DataFrame) -> tuple[Sparse, Sparse, np.ndarray]:
    """Feature numbers and labels of ``features``, a bounded number of rows, on the driver."""
    table = features.select("doc_id", "t", "m", "y").toArrow().combine_chunks()
    if not table.num_rows:
        empty = Sparse(np.zeros(0, np.int32), np.zeros(1, np.int64))
        return empty, empty, np.zeros(0)
    order = np.argsort(np.array(table["doc_id"].to_pylist()), kind="stable")
    return _sparse(table["t"]).take(order), _sparse(table["m"]).take(order), table["y"].to_numpy()[order]


VIEWS = {"text": 1 << TEXT_BITS, "meta": 1 << META_BITS}
OTHER = {"text": "meta", "meta": "text"}


def _sums(free: DataFrame, givers: dict, confident: float, takers: dict | None = None) -> dict[str, list[np.ndarray]]:
    """Sums over the unlabelled documents of which a view's giver (weights, calibration) is
    confident, by feature, that over the documents themselves last: how many are good and
    bad, or, with the weights of ``takers``, the gradient."""
    spark = free.sparkSession
    shared = spark.sparkContext.broadcast((givers, takers))
    parts = 2 if takers is None else 1
    at, ends = 0, {}
    for k, size in VIEWS.items():
        ends[k] = (at, at + parts * (size + 1))
        at = ends[k][1]

    def scan(batches):
        givers, takers = shared.value
        total = np.zeros(at)
        for batch in batches:
            for b in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = {k: _sparse(b[c]) for k, c in (("text", "t"), ("meta", "m"))}
                x = {k: Sparse(v.index.astype(np.intp), v.offsets) for k, v in x.items()}
                for k, size in VIEWS.items():
                    w, calibration = givers[OTHER[k]]
                    p = _sigmoid(score(x[OTHER[k]], w) * calibration[0] + calibration[1])
                    sure, y = (p >= confident) | (p <= 1 - confident), p >= 0.5
                    values = [sure & y, sure & ~y] if takers is None else [np.where(sure, _sigmoid(score(x[k], takers[k])) - y, 0.0)]
                    for j, value in enumerate(values):
                        lo = ends[k][0] + j * (size + 1)
                        total[lo : lo + size] += x[k].scatter(value, size)
                        total[lo + size] += value.sum()
        pieces = range(0, at, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in pieces], pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in pieces], pa.binary())], names=["piece", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, sums in zip(b["piece"].to_pylist(), b["sums"].to_pylist()):
                total[piece] = total.get(piece, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["piece", "sums"])

    ddl = "piece int, sums binary"
    found = free.select("t", "m").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(scan, ddl).repartition("piece").mapInArrow(add, ddl).collect()
    shared.unpersist()
    total = np.zeros(at)
    for piece, sums in found:
        total[piece * SLICE : piece * SLICE + len(sums) // 8] = np.frombuffer(sums)
    return {k: np.split(total[lo:hi], parts) for k, (lo, hi) in ends.items()}


def _fitted(features: DataFrame, n_labels: int, max_labelled: int, rounds: int, confident: float) -> QualityModel | None:
    if not n_labels:
        return None
    t, m, y = _labelled(features.where(F.col("y").isNotNull() & _hash_below("doc_id", min(1.0, max_labelled / n_labels))))
    known = np.arange(len(y))
    if len(np.unique(y)) < 2:
        return None
    held, used = known[::5], np.delete(known, np.s_[::5])
    if len(np.unique(y[used])) < 2 or len(np.unique(y[held])) < 2:
        held = used = known
    views = {"text": t, "meta": m}
    free = features.where("doc_id IS NOT NULL AND y IS NULL")

    def fits(sums):
        schedule = {} if sums is None else {"steps": SCANS, "rate": 0.17}  # as far in all as 40 steps of 0.1
        return {k: fit(views[k].take(used), y[used], VIEWS[k], sums[k] if sums else None, **schedule) for k in VIEWS}

    def calibrated(name, w):
        z = score(views[name].take(held), w)
        return z, _dense_fit(z[:, None], y[held])

    models = {k: next(f) for k, f in fits(None).items()}
    for _ in range(rounds):
        givers = {k: (w, calibrated(k, w)[1]) for k, w in models.items()}
        going = fits(_sums(free, givers, confident))
        models = {k: next(f) for k, f in going.items()}
        for _ in range(SCANS - 1):
            gradients = _sums(free, givers, confident, models)
            models = {k: f.send(gradients[k][0]) for k, f in going.items()}
    zt, st = calibrated("text", models["text"])
    zm, sm = calibrated("meta", models["meta"])
    zt, zm = zt * st[0] + st[1], zm * sm[0] + sm[1]
    return QualityModel(models["text"], models["meta"], st, sm, _dense_fit(np.column_stack([zt, zm, np.minimum(zt, zm)]), y[held]))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, broadcast_labels: int = BROADCAST_LABELS) -> QualityModel | None:
    """Fit both views; None without labelled documents of both kinds."""
    at = workdir(docs.sparkSession, "quality")
    model = _fitted(*_prepared(docs, labels, at, broadcast_labels), max_labelled, rounds, confident)
    remove(docs.sparkSession, at)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``score_all`` by a model trained on the same documents, from the features that
    training has written: texts are read once."""
    features, n_labels = _prepared(docs, labels, workdir(docs.sparkSession, "quality"), broadcast_labels)
    model = _fitted(features, n_labels, max_labelled, rounds, confident)
    return _scored(features.select("doc_id", "t", "m"), docs, model, threshold, lambda q, b: q.combine(_sparse(b["t"]), _sparse(b["m"])))


def _scored(rows: DataFrame, docs: DataFrame, model: QualityModel | None, threshold: float, predict) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = rows.columns[1]

    def scan(batches):
        q = shared.value
        for b in slices(batches, column):
            p = [np.full(b.num_rows, 0.5)] * 3 if q is None else predict(q, b)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(arrow), *[pa.array(np.round(x, 6)) for x in p], pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "p_good", "keep"])

    return rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, p_text double, p_meta double, p_good double, keep boolean")


def score_all(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, p_good, keep) of every document."""
    rows = docs.select("doc_id", "text", "source", "lang")
    return _scored(rows, docs, model, threshold, lambda q, b: q.predict(b["text"], b["source"], b["lang"]))


def drop_rejected(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "source", "lang")]

    def scan(batches):
        q = shared.value
        for b in slices(batches):
            yield b if q is None else b.filter(pa.array(q.predict(*[b.column(i) for i in at])[2] >= threshold))

    return docs.mapInArrow(scan, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
