"""Language identification by language-bitmask n-gram filters.

Training counts byte 4-grams of every document with a known language. A language
*contains* an n-gram if it is frequent enough there (``least_count`` times, and at least
``least_share`` of the rate in the language where it is most frequent), so that strays do
not enter. A bit-sliced Bloom filter holds all languages at once: each slot is a bitmask
with one bit per language, an insertion sets the language's bit in an n-gram's slots, and
the AND of the slots of an n-gram is the set of languages that contain it.

A document is decided by popcounts: of its n n-grams, c(L) hit language L. As the filter
answers yes by mistake at a rate f(L), its fill to the power of the probes, the share is
corrected to (c / n - f) / (1 - f). The greatest share wins, the first in alphabetical
order on ties; below ``least_hit`` of it, or without an n-gram, the language is null.

N-grams are windows of four bytes of the lower-cased text with every byte that no word of
``textkit`` has replaced by a space; windows of two or more spaces are skipped. Both
passes read whole texts of all documents; only counts leave the tasks, and slots are put
together where the counts are. The model grows with the n-grams of a language that pass
``least_rate``, at most 1 / least_rate of them: it can't take more than 2 ** 24 slots (128
MB for each 64 languages) with the default, whatever the corpus, and is sent to all workers.

Defined cases: null and empty texts get a null language and share 0; documents without a
known language don't train; without any training document every language is null; rows
that repeat a doc_id are decided each; a null doc_id stays null; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import remove, settle, workdir
from .textkit import _IS_WORD, U, fmix64, lowered, pieces, slices, utf8_bytes

N = 4
PROBES, BITS_PER_GRAM = 3, 12
_FOLD = np.where(_IS_WORD, np.arange(256), 32).astype(np.uint32)


def grams(texts):
    """For runs of texts: first text, last text, n-grams, text of each (from first). A long
    text comes in several runs."""
    tail, last = np.zeros(0, np.uint32), -1
    for i, j, part in pieces(texts):
        raw, offsets = utf8_bytes(lowered(part))
        x, ends = _FOLD[raw], offsets[1:]
        if i == last:  # goes on within a text: with the bytes that no window has begun at
            x, ends = np.concatenate([tail, x]), ends + len(tail)
        tail, last = x[-(N - 1) :], i if j == i + 1 else -1
        if len(x) >= N:
            code = (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
            space = (x == 32).astype(np.int8)
            ok = (space[:-3] + space[1:-2] + space[2:-1] + space[3:]) < 2
            for back in range(1, N):  # windows that run over the end of a text
                over = ends[:-1] - back
                ok[over[(over >= 0) & (over < len(ok))]] = False
            at = np.flatnonzero(ok)
            yield i, j, code[at], np.searchsorted(ends, at, side="right")


@dataclass
class LanguageFilter:
    """Slots of language bitmasks; ``wrong`` is the false-positive rate per language."""

    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    wrong: np.ndarray

    @classmethod
    def build(cls, sets: dict[str, np.ndarray]) -> LanguageFilter:
        """From the n-grams of each language."""
        languages = sorted(sets)
        size = cls.size_for(max((len(s) for s in sets.values()), default=1))
        slots = np.zeros((size, (max(1, len(languages)) + 63) // 64), dtype=U)
        for k, language in enumerate(languages):
            for at in cls._places(np.asarray(sets[language], dtype=np.uint32), size):
                slots[at, k // 64] |= U(1) << U(k % 64)
        return cls.of_slots(languages, slots)

    @classmethod
    def of_slots(cls, languages: list[str], slots: np.ndarray) -> LanguageFilter:
        fill = [((slots[:, k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(languages))]
        return cls(languages, slots, np.array(fill, dtype=float) ** PROBES)

    @staticmethod
    def size_for(most: int) -> int:
        """Slots for languages of up to ``most`` n-grams."""
        return 1 << max(10, (BITS_PER_GRAM * most - 1).bit_length())

    @staticmethod
    def _places(codes: np.ndarray, size: int):
        h = fmix64(codes.astype(U))
        step = (h >> U(32)) | U(1)
        for p in range(PROBES):
            yield ((h + U(p) * step) & U(size - 1)).astype(np.int64)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(n, words): the languages that contain each n-gram."""
        out = None
        for at in self._places(codes, len(self.slots)):
            found = self.slots[at]
            out = found if out is None else out & found
        return out

    def shares(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language (texts, languages), and n-grams per text."""
        texts_n = len(texts)
        hits = np.zeros((texts_n, len(self.languages)))
        total = np.zeros(texts_n, dtype=np.int64)
        for i, j, codes, text in grams(texts):
            total[i:j] += np.bincount(text, minlength=j - i)
            masks = self.masks(codes)
            has = np.flatnonzero(np.bincount(text, minlength=j - i))
            if not len(has):
                continue
            first = np.searchsorted(text, has, side="left")
            for k in range(len(self.languages)):
                bit = (masks[:, k // 64] >> U(k % 64)) & U(1)
                hits[i + has, k] += np.add.reduceat(bit.astype(np.int32), first)
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.wrong) / (1 - self.wrong), 0, 1), total


def train(docs: DataFrame, least_count: int = 5, least_share: float = 0.02, least_rate: float = 1e-6) -> LanguageFilter:
    """Filter over the documents' own ``lang``."""

    def count(batches):
        held: dict[str, list] = {}

        def flush():
            for language, parts in held.items():
                codes = np.concatenate([p[0] for p in parts])
                times = np.concatenate([p[1] for p in parts])
                u, inv = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(language), len(u)), pa.array(u.astype(np.int64)), pa.array(np.bincount(inv, weights=times).astype(np.int64))],
                    names=["lang", "code", "times"],
                )

        rows = 0
        for b in slices(batches):
            names = b["lang"].dictionary_encode()
            of = names.indices.to_numpy()
            for i, j, codes, text in grams(b["text"]):
                mine = of[i:j][text]
                for k in np.unique(mine).tolist():
                    u, c = np.unique(codes[mine == k], return_counts=True)
                    held.setdefault(names.dictionary[k].as_py(), []).append((u, c))
                    rows += len(u)
            if rows > 4_000_000:
                yield from flush()
                held.clear()
                rows = 0
        yield from flush()

    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, code bigint, times bigint")
    counts = counts.groupBy("lang", "code").agg(F.sum("times").alias("times"))
    spark = docs.sparkSession
    at = workdir(spark, "langmask")
    counts = settle(counts, f"{at}/counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("times").alias("n")).collect()}  # a row per language
    if not totals:
        return LanguageFilter.build({})
    languages = sorted(totals)
    total = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))])
    number = F.create_map(*[x for k, v in enumerate(languages) for x in (F.lit(v), F.lit(k))])
    rated = counts.withColumn("rate", F.col("times") / total[F.col("lang")])
    best = rated.groupBy("code").agg(F.max("rate").alias("best"))
    kept = rated.where((F.col("times") >= least_count) & (F.col("rate") >= least_rate)).join(best, "code").where(F.col("rate") >= least_share * F.col("best"))
    kept = settle(kept.select(number[F.col("lang")].alias("k"), "code"), f"{at}/kept")
    most = kept.groupBy("k").count().agg(F.max("count")).first()[0] or 1
    size = LanguageFilter.size_for(most)

    def places(batches):
        for b in batches:
            k, codes = b["k"].to_numpy(), b["code"].to_numpy().astype(np.uint32)
            for at in LanguageFilter._places(codes, size):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k // 64), pa.array((U(1) << (k % 64).astype(U)).view(np.int64))], names=["slot", "word", "mask"])

    set_ = kept.mapInArrow(places, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros((size, (len(languages) + 63) // 64), dtype=U)
    slots[set_["slot"].to_numpy(), set_["word"].to_numpy()] = set_["mask"].to_numpy().view(U)
    remove(spark, at)
    return LanguageFilter.of_slots(languages, slots)


def identify(docs: DataFrame, model: LanguageFilter, least_hit: float = 0.3) -> DataFrame:
    """(doc_id, lang_id, share, runner_up): the language, its share and the second one's."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for b in slices(batches):
            share, total = m.shares(b["text"])
            n = b.num_rows
            if not m.languages:
                share = np.zeros((n, 1))
            best = share.argmax(axis=1)
            top = share[np.arange(n), best]
            second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(n)
            known = (total > 0) & (top >= least_hit) & bool(m.languages)
            names = pa.array([m.languages[k] if ok else None for k, ok in zip(best.tolist(), known.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(arrow), names, pa.array(np.round(top, 6)), pa.array(np.round(second, 6))], names=["doc_id", "lang_id", "share", "runner_up"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind.simpleString()}, lang_id string, share double, runner_up double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
