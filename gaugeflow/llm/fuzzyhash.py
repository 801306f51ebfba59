"""SimHash near-dedup with keys from the binary Golay code.

A document's fingerprint has 128 bits: bit i is the majority of bit i of the hashes of
its distinct words. 115 of them are five segments of 23 bits. The (23, 12) Golay code is
perfect: every segment lies within 3 bits of exactly one codeword. A segment's keys are
the 12-bit index of its own codeword and of codewords that its neighbours at one bit
belong to; there are at most five of these, and two segments at most 2 bits apart have a
key in common, as all six are used (fewer ``probes`` take those first that the bits with
the least majority lead to). Two documents are candidates if keys of the same two
segments agree (24 bits): by pigeonhole certain up to 11 differing bits among the 115,
very likely beyond (README). Candidates are verified on all 128 bits.

Documents of equal word sets are one class, known by a 64-bit hash of the set, before any
key is made, so thousands of copies cost one document. A row for each key of a segment,
with the keys of the segments after it, is shuffled by the former and spread to key pairs
where it arrives. Candidates are compared within sorted shuffle partitions; of a bucket of
up to 64 classes all pairs within the distance are links, of a larger one a spanning
forest of them; groups are the connected components of all links. Keys that more than
``hot`` classes have are shuffled by pair of keys instead, and pairs that more have in
parts, any two of which meet in one task.

Defined cases: null texts and texts without a word are in no group; texts of fewer than
``least_words`` distinct words are grouped only with those of the same word set; ties of
a majority give 0; rows that share doc_id and text are one document, rows that share the
doc_id alone are documents of their own; rows without doc_id are left out (and kept by
``drop_near_copies``); an empty table gives no group; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import remove, settle, unused, workdir
from .textkit import U, fmix64, slices, words

SEGMENTS, BITS = 5, 128
PROBES, DISTANCE, LEAST_WORDS, HOT = 6, 20, 16, 1 << 17
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], dtype=np.int32)
    low = np.array([_remainder(i) for i in range(1 << 12)], dtype=np.int32)
    errors = np.zeros(1 << 11, dtype=np.int32)
    bits = range(23)
    for size in (1, 2, 3):
        for places in combinations(bits, size):
            e = sum(1 << b for b in places)
            errors[_remainder(e)] = e
    return high, low, errors


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit value."""
    high, low, errors = _tables()
    return (v ^ errors[high[v >> 12] ^ low[v & 0xFFF]]) >> 11


def segment_keys(v: np.ndarray, margin: np.ndarray, probes: int) -> np.ndarray:
    """(n, probes) codeword indices of 23-bit values, -1 where there are fewer. Column 0
    is the value's own; the others belong to values at one bit, least ``margin`` first."""
    own = decode(v)
    keys = np.full((len(v), probes), -1, dtype=np.int32)
    keys[:, 0] = own
    if probes > 1:
        order = np.argsort(margin, axis=1, kind="stable")
        near = decode((v[:, None] ^ (1 << order)).astype(np.int32))
        open_ = near != own[:, None]
        for p in range(1, probes):
            has = open_.any(axis=1)
            pick = near[np.arange(len(v)), open_.argmax(axis=1)]
            keys[has, p] = pick[has]
            open_ &= near != pick[:, None]
    return keys


def signatures(texts):
    """Per text: distinct words, hash of the word set, (n, 128) counts of one bits."""
    w = words(texts)
    n = len(w.counts)
    doc = w.text_of_word().astype(U)
    distinct, sets, ones = np.zeros(n, np.int64), np.zeros(n, U), np.zeros((n, BITS), np.int32)
    step = 1 << 18
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(w.offsets, w.offsets[start] + step, side="right")) - 1)
        a, b = w.offsets[start], w.offsets[end]
        # text number in the high 24 bits, so that one sort finds the distinct words of each
        key = np.unique(((doc[a:b] - U(start)) << U(40)) | (w.hashes[a:b] >> U(24)))
        text = (key >> U(40)).astype(np.int64)
        h = fmix64(key & U((1 << 40) - 1))
        size = np.bincount(text, minlength=end - start)
        distinct[start:end] = size
        has = np.flatnonzero(size)
        if len(has):
            first = (np.cumsum(size) - size)[has]
            sets[start + has] = np.add.reduceat(h, first)
            for lo in range(0, len(h), step):
                own, who = h[lo : lo + step], text[lo : lo + step]
                both = np.stack([fmix64(own ^ U(0x5851F42D4C957F2D)), fmix64(own + U(0x14057B7EF767814F))], axis=1)
                bits = np.unpackbits(both.view(np.uint8).reshape(len(own), 16), axis=1)
                each = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                ones[start + who[each]] += np.add.reduceat(bits, each, axis=0, dtype=np.int32)
        start = end
    return distinct, fmix64(sets + distinct.astype(U)), ones


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words, n, bits, margin): ``words`` is the hash of the word set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for b in slices(batches):
            distinct, sets, ones = signatures(b["text"])
            ok = np.flatnonzero(distinct)
            bits = 2 * ones[ok] > distinct[ok, None]
            margin = np.minimum(np.abs(2 * ones[ok] - distinct[ok, None]), 255).astype(np.uint8)
            prints = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].take(pa.array(ok)),
                    b["text_hash"].take(pa.array(ok)),
                    pa.array(sets[ok].view(np.int64)),
                    pa.array(distinct[ok].astype(np.int32)),
                    pa.array([p.tobytes() for p in prints], pa.binary()),
                    pa.array([m.tobytes() for m in margin], pa.binary()),
                ],
                names=["doc_id", "text_hash", "words", "n", "bits", "margin"],
            )

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        scan, f"doc_id {kind}, text_hash bigint, words bigint, n int, bits binary, margin binary"
    )


def _keyed(reps: DataFrame, probes: int) -> DataFrame:
    """A row per class, segment and key of it, with the keys of the segments after it."""

    def make(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b["bits"].to_pylist()), dtype=np.uint8).reshape(n, 16), axis=1)
            margin = np.frombuffer(b"".join(b["margin"].to_pylist()), dtype=np.uint8).reshape(n, BITS)
            prints = np.packbits(bits, axis=1).view(np.int64).reshape(n, 2)
            weights = (1 << np.arange(23)).astype(np.int32)
            each = [segment_keys(bits[:, 23 * s : 23 * s + 23] @ weights, margin[:, 23 * s : 23 * s + 23], probes) for s in range(SEGMENTS)]
            for i in range(SEGMENTS - 1):
                later = np.concatenate(each[i + 1 :], axis=1).astype(np.int16)
                row, p = np.nonzero(each[i] >= 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((i << 12) | each[i][row, p], pa.int64()),
                        b["words"].take(pa.array(row)),
                        pa.array(prints[row, 0]),
                        pa.array(prints[row, 1]),
                        pa.array([x.tobytes() for x in later], pa.binary()).take(pa.array(row)),
                    ],
                    names=["key", "words", "f1", "f2", "later"],
                )

    return reps.select("words", "bits", "margin").mapInArrow(make, "key bigint, words bigint, f1 bigint, f2 bigint, later binary")


def _spread(key: np.ndarray, later: list[bytes], probes: int):
    """Rows and their pair keys (segments, 12 bits each)."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(SEGMENTS - 1):
        own = np.flatnonzero(key >> 12 == i)
        if not len(own):
            continue
        others = np.frombuffer(b"".join(later[r] for r in own.tolist()), dtype=np.int16).reshape(len(own), -1)
        row, at = np.nonzero(others >= 0)
        number = i * SEGMENTS + i + 1 + at // probes
        rows.append(own[row])
        keys.append((number.astype(np.int64) << 24) | ((key[own[row]] & 0xFFF) << 12) | others[row, at])
    return np.concatenate(rows), np.concatenate(keys)


PAIR = 1 << 32  # added to the key of a row that stands for one pair of segments only


def _paired(keyed: DataFrame, probes: int) -> DataFrame:
    """A row for each pair of keys instead of one for each key."""

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                row, pair = _spread(part["key"].to_numpy(), part["later"].to_pylist(), probes)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(pair + PAIR), *[part[c].take(row) for c in ("words", "f1", "f2")], pa.nulls(len(row), pa.binary())], names=["key", "words", "f1", "f2", "later"])

    return keyed.mapInArrow(spread, "key bigint, words bigint, f1 bigint, f2 bigint, later binary")


def _blocked(keyed: DataFrame, probes: int, hot: int, at: str) -> DataFrame:
    """``keyed`` with a block number: rows of one (key, block) are compared, at most about
    2 ``hot`` of them. Keys with more than ``hot`` rows are split by their pairs; pairs with
    more are cut into parts by hash, and each two parts meet in a block."""
    many = [r["key"] for r in keyed.groupBy("key").count().where(F.col("count") > hot).select("key").collect()]  # of 4 * 4096 at most
    if not many:
        return keyed.withColumn("block", F.lit(0).cast("long"))
    pairs = settle(_paired(keyed.where(F.col("key").isin(many)), probes), f"{at}/pairs")
    parts = settle(pairs.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("long").alias("parts")), f"{at}/parts")
    n = F.coalesce("parts", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("words"), n)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda other: F.least(own, other) * n + F.greatest(own, other))
    pairs = pairs.join(parts, "key", "left").select(*keyed.columns, F.explode(meet).alias("block"))
    return keyed.where(~F.col("key").isin(many)).withColumn("block", F.lit(0).cast("long")).unionByName(pairs)


def _forest(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``distance``: each row is compared with those
    that no tree has reached, so that a crowd of near copies costs little more than a row."""
    left, right = [], []
    open_ = np.arange(len(x))
    while len(open_) > 1:
        reached, open_ = [int(open_[0])], open_[1:]
        while reached and len(open_):
            i = reached.pop()
            near = np.bitwise_count(x[open_] ^ x[i]) + np.bitwise_count(y[open_] ^ y[i]) <= distance
            if near.any():
                found, open_ = open_[near], open_[~near]
                left.append(np.full(len(found), i))
                right.append(found)
                reached += found.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_links(key: np.ndarray, f1: np.ndarray, f2: np.ndarray, distance: int, large: int = 64):
    """Pairs of rows (sorted by key) of one bucket within ``distance``: all of them in a
    bucket of up to ``large`` rows, else a spanning forest of them."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    end = np.repeat(first + size, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(size, size) <= large)
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        gap = np.bitwise_count(f1[at] ^ f1[at + step]) + np.bitwise_count(f2[at] ^ f2[at + step])
        ok = at[gap <= distance]
        left.append(ok)
        right.append(ok + step)
        step += 1
    for b in np.flatnonzero(size > large).tolist():
        lo, n = first[b], size[b]
        a, z = _forest(f1[lo : lo + n], f2[lo : lo + n], distance)
        left.append(lo + a)
        right.append(lo + z)
    return np.concatenate(left), np.concatenate(right)


def _links(rows: DataFrame, distance: int, probes: int) -> DataFrame:
    """(u, v): classes within ``distance`` that share a key, by the hash of their words."""

    def compare(batches):
        def found(t: pa.Table):
            key, block, words_ = (t[c].to_numpy() for c in ("key", "block", "words"))
            row, code = _spread(np.where(key < PAIR, key, -1), t["later"].to_pylist(), probes)
            own = np.flatnonzero(key >= PAIR)
            if len(own):  # these are in the order of their groups
                group = np.cumsum(np.concatenate([[0], (key[own][1:] != key[own][:-1]) | (block[own][1:] != block[own][:-1])]))
                row, code = np.concatenate([row, own]), np.concatenate([code, PAIR + group])
            if not len(row):
                return None
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            a, b = _bucket_links(code, t["f1"].to_numpy().view(U)[row], t["f2"].to_numpy().view(U)[row], distance)
            if not len(a):
                return None
            pairs = np.unique(np.stack([words_[row[a]], words_[row[b]]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 14:
                continue
            key, block = held["key"].to_numpy(), held["block"].to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))[-1])
            if cut:
                out = found(held.slice(0, cut))
                held = held.slice(cut)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out = found(held)
            if out is not None:
                yield out

    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(compare, "u bigint, v bigint")


def _grouped(docs: DataFrame, distance: int, probes: int, least_words: int, hot: int) -> DataFrame:
    """(doc_id, text_hash, kept, group_size) of the documents that have near copies;
    ``kept`` is the document (doc_id, text_hash) of the group to keep."""
    at = workdir(docs.sparkSession, "simhash")
    signed = settle(_signed(docs), f"{at}/signed")
    reps = settle(signed.groupBy("words").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("margin").alias("margin")), f"{at}/classes")
    keyed = _keyed(reps.where(F.col("n") >= least_words), probes)
    links = settle(_links(_blocked(keyed, probes, hot, at), distance, probes).distinct(), f"{at}/links")
    for part in ("classes", "pairs", "parts"):
        remove(docs.sparkSession, f"{at}/{part}")
    roots = components(links, at)
    members = signed.select("doc_id", "text_hash", "words").distinct().join(roots.withColumnRenamed("node", "words"), "words", "left").select("doc_id", "text_hash", F.coalesce("root", "words").alias("root"))
    groups = members.groupBy("root").agg(F.count("*").cast("int").alias("group_size"), F.min(F.struct("doc_id", "text_hash")).alias("kept")).where("group_size > 1")
    return members.join(groups, "root").drop("root")


def near_groups(docs: DataFrame, distance: int = DISTANCE, probes: int = PROBES, least_words: int = LEAST_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of the documents that have near copies.
    ``group_id`` is the least doc_id of the group, which is the document to keep."""
    own = F.struct("doc_id", "text_hash")
    return _grouped(docs, distance, probes, least_words, hot).select("doc_id", F.col("kept.doc_id").alias("group_id"), "group_size", (own == F.col("kept")).alias("keep"))


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE, probes: int = PROBES, least_words: int = LEAST_WORDS, hot: int = HOT) -> DataFrame:
    """``docs`` with one document, of the least doc_id, of each group; all columns as they
    are. Equal rows are one document, of which all stay if it is the one to keep."""
    found = _grouped(docs, distance, probes, least_words, hot).where(F.struct("doc_id", "text_hash") != F.col("kept"))
    doc, hash_ = unused(docs, "__gf_gone", "__gf_hash")
    gone = found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_))
    return docs.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
