"""Line dedup that can be undone: sharded cuckoo filters over exact count tables.

A *line* is what stands between two ``\\n``; its identity is 128 bits of hash over
the exact characters. Lines without a visible character are never counted. A *document*
is known by its doc_id and a hash of its text.

State, one folder per index, is a log of batches (see ``CommitLog``):

``docs``     the ids that an insertion brought
``lines``    one row per line occurrence of them (doc_id, text_hash, line_no, h1, h2)
``ids``      the ids that a deletion took out
``counts``   signed changes of the exact counts (h1, h2, refs), of either
``filters``  one cuckoo filter per shard over the keys whose counts sum to more than 0

An insertion asks the filter of a line's shard first: lines that it has not seen are new
and need no look-up; those it may have seen are looked up in the exact counts. A deletion
lowers counts; keys that fall to zero leave the filter, so that inserting and deleting a
batch restores the former state. Batches write rows in proportion to themselves, and the
filters, two bytes and a half a distinct line; every ``COMPACT`` batches the log is summed
up. The kept copy of a line is the least (doc_id, text_hash, line_no) among the live
documents, hence a document's deletion gives its lines back to the next holder.

Shards hold up to ``shard_keys`` lines; where there are more in all, the shards double and
the filters are built anew from the exact counts. Only hashes travel; the text of a
document is moved once, to join it with the numbers of the lines it loses. A hot line is
one row per map task in the counts (partial aggregation), and joins on lines have one row
a line on their other side, so that adaptive execution can split a hot one.

Defined cases: a null text stays null and loses nothing; an empty text stays; a
document whose every visible line is held elsewhere leaves the result if
``drop_emptied``; equal rows are one document, which both keep; rows that share a doc_id
alone are documents of their own, inserted and deleted together; inserting an id that the
index holds and deleting one that it doesn't changes nothing; rows with a null doc_id are
passed unchanged and not indexed; an empty table gives an empty result; other columns are
carried along whatever their names.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CommitLog, remove, settle, unused, workdir
from .textkit import U, fmix64, slices

SLOTS, SHARD_KEYS, COMPACT = 4, 1 << 18, 16
KEY = ["h1", "h2"]
_VISIBLE = re.compile(r"[^ \t\n\x0b\f\r]")


def filter_keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """What a filter knows of a line: both halves of its hash, mixed."""
    return fmix64(h1.view(U)) ^ (h2.view(U) * U(0x9E3779B97F4A7C15))


class CuckooFilter:
    """Fingerprints of 16 bits, four to a bucket, two buckets to a key; supports
    insertion, membership and deletion. ``stash`` holds the keys whose insertion found
    no room, so that membership never misses a key."""

    def __init__(self, buckets: int):
        self.buckets = 1 << max(2, (max(1, buckets) - 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.stash: list[tuple[int, int]] = []

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(int(n / SLOTS / 0.8) + 1)

    def has_room(self, n: int) -> bool:
        return int((self.table != 0).sum()) + len(self.stash) + n <= 0.9 * self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = fmix64(keys.astype(U))
        prints = (mixed >> U(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (mixed & U(self.buckets - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket, prints):
        step = (fmix64(np.asarray(prints).astype(U)) & U(self.buckets - 1)).astype(np.int64)
        return np.bitwise_xor(bucket, step)

    def _fill(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; the places of those left over."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        which = np.unique(b)
        held = self.table[which]
        self.table[which] = np.take_along_axis(held, np.argsort(held == 0, axis=1, kind="stable"), axis=1)
        slot = (self.table[b] != 0).sum(axis=1) + np.arange(len(b)) - np.searchsorted(b, b, side="left")
        fits = slot < SLOTS
        self.table[b[fits], slot[fits]] = prints[order[fits]]
        return order[~fits]

    def insert(self, keys: np.ndarray) -> None:
        """Keys must be absent; one that is given twice is held twice. Free slots are filled
        for all keys at once; what is left over moves other fingerprints, a bucket's one at
        a time but all buckets together."""
        if not len(keys):
            return
        prints, one, two = self._places(keys)
        left = self._fill(one, prints)
        left = left[self._fill(two[left], prints[left])]
        fp, bucket, rng = prints[left], two[left], np.random.default_rng(len(keys))
        for _ in range(500):
            if not len(fp):
                return
            b, first = np.unique(bucket, return_index=True)
            slot = rng.integers(SLOTS, size=len(b))
            out = self.table[b, slot].copy()
            self.table[b, slot] = fp[first]
            fp[first], bucket[first] = out, self._other(b, out)
            fp, bucket = fp[fp != 0], bucket[fp != 0]
            rest = self._fill(bucket, fp)
            fp, bucket = fp[rest], bucket[rest]
        self.stash += list(zip(fp.tolist(), bucket.tolist()))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        found = (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)
        for fp, bucket in self.stash:
            found |= (prints == fp) & ((one == bucket) | (two == bucket))
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Each key must have been inserted."""
        prints, one, two = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):
            while len(left):
                b = bucket[left]
                match = self.table[b] == prints[left, None]
                slot, has = match.argmax(axis=1), np.flatnonzero(match.any(axis=1))
                # of several keys that would clear one slot the first does, the others look again
                done = has[np.unique(b[has] * SLOTS + slot[has], return_index=True)[1]]
                if not len(done):
                    break
                self.table[b[done], slot[done]] = 0
                left = np.delete(left, done)
        for k in left.tolist():
            place = next((s for s in self.stash if s[0] == int(prints[k]) and s[1] in (int(one[k]), int(two[k]))), None)
            if place is not None:
                self.stash.remove(place)

    def to_bytes(self) -> bytes:
        head = np.array([self.buckets, len(self.stash)], dtype=np.int64)
        return head.tobytes() + np.array(self.stash, dtype=np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        buckets, stashed = np.frombuffer(blob[:16], dtype=np.int64).tolist()
        out = cls(buckets)
        out.stash = [tuple(x) for x in np.frombuffer(blob[16 : 16 + 16 * stashed], dtype=np.int64).reshape(-1, 2).tolist()]
        out.table = np.frombuffer(blob[16 + 16 * stashed :], dtype=np.uint16).reshape(buckets, SLOTS).copy()
        return out


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(text)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, h1, h2) of every visible line; hashes only."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit("second"), s).alias("h2"), F.rlike(s, F.lit(r"\S")).alias("seen")))
    return (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", text_hash().alias("text_hash"), lines.alias("lines"))  # once a document, not once a line
        .select("doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "k"))
        .where("k.seen")
        .select("doc_id", "text_hash", "line_no", "k.h1", "k.h2")
    )


def _keys_of(table: pa.Table) -> np.ndarray:
    return filter_keys(*[table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in KEY])


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select(F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), *KEY)


def _build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) over distinct keys."""

    def build(table: pa.Table) -> pa.Table:
        cuckoo = CuckooFilter.for_keys(table.num_rows)
        cuckoo.insert(_keys_of(table))
        return pa.table({"shard": table["shard"].slice(0, 1), "blob": pa.array([cuckoo.to_bytes()], pa.binary())})

    return _sharded(keys, shards).groupBy("shard").applyInArrow(build, "shard int, blob binary")


class LineIndex:
    """The index in ``path`` (a new folder of the session's shared one by default)."""

    def __init__(self, spark: SparkSession, path: str | None = None, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.shard_keys = spark, path or workdir(spark, "line-index"), shard_keys
        self.log = CommitLog(spark, self.path)

    def _read(self, entry: dict, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry['at']}/{part}")

    def _live(self, entries: list[dict], part: str) -> DataFrame:
        """Rows of ``docs`` or ``lines`` but those that a later deletion took out."""
        out = gone = None
        for e in entries:
            mine = self._read(e, "ids" if e["kind"] == "delete" else part).withColumn("__n", F.lit(e["number"]))
            if e["kind"] == "delete":
                gone = mine if gone is None else gone.unionByName(mine)
            else:
                out = mine if out is None else out.unionByName(mine)
        if gone is None:
            return out.drop("__n")
        last = gone.groupBy("doc_id").agg(F.max("__n").alias("__gone"))
        return out.join(last, "doc_id", "left").where("__gone IS NULL OR __n > __gone").select(*[c for c in out.columns if c != "__n"])

    def lines(self) -> DataFrame:
        return self._live(self.log.entries(), "lines")

    def _counts(self, entries: list[dict], keys: DataFrame | None = None) -> DataFrame:
        """(h1, h2, refs) of the lines that are held, or of those of ``keys`` that are."""
        out = None
        for e in entries:
            mine = self._read(e, "counts")
            mine = mine if keys is None else mine.join(keys, KEY, "left_semi")
            out = mine if out is None else out.unionByName(mine)
        return out.groupBy(*KEY).agg(F.sum("refs").alias("refs")).where("refs > 0")

    def refs(self) -> DataFrame:
        return self._counts(self.log.entries())

    def filters(self) -> DataFrame:
        return self._read(self.log.entries()[-1], "filters")

    def _committed(self, write) -> bool:
        """Let ``write`` (entries, folder) make a batch and commit it; again if another
        writer was first, as its state is then another one."""
        while True:
            entries = self.log.entries()
            number = entries[-1]["number"] + 1 if entries else 1
            at = f"{number}-{uuid.uuid4().hex}"
            entry = write(entries, f"{self.path}/{at}")
            if entry is None:
                return False
            if self.log.append(number, entry | {"at": at}):
                for e in entries[-2:-1]:
                    remove(self.spark, f"{self.path}/{e['at']}/filters")
                return True
            remove(self.spark, f"{self.path}/{at}")

    def insert(self, docs: DataFrame) -> None:
        """Add documents; ids already in the index are left as they are."""
        self._committed(lambda entries, at: self._insert(entries, docs, at))
        if len(self.log.entries()) > COMPACT:
            self.compact()

    def _insert(self, entries: list[dict], docs: DataFrame, at: str) -> dict:
        ids, fresh = docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), occurrences(docs.select("doc_id", "text"))
        if entries:
            again = settle(ids.join(self._live(entries, "docs"), "doc_id", "left_semi"), f"{at}/again")
            if not again.isEmpty():
                ids, fresh = ids.join(again, "doc_id", "left_anti"), fresh.join(again, "doc_id", "left_anti")
        settle(ids, f"{at}/docs")
        lines = settle(fresh, f"{at}/lines")
        added = settle(lines.groupBy(*KEY).agg(F.count("*").alias("refs")), f"{at}/counts")
        n, held, shards = added.count(), entries[-1]["keys"] if entries else 0, entries[-1]["shards"] if entries else 1
        known = None
        if entries:
            seen = self._ask(entries[-1], added, at)
            known = settle(self._counts(entries, seen.select(*KEY)).select(*KEY), f"{at}/known")
        keys = held + n - (known.count() if entries else 0)
        wanted = shards
        while keys > wanted * self.shard_keys:
            wanted *= 2
        if not entries or wanted != shards:
            every = added.select(*KEY) if not entries else self._counts(entries).select(*KEY).unionByName(added.select(*KEY)).distinct()
            settle(_build_filters(every, wanted), f"{at}/filters")
        else:
            self._grow(entries, added, seen, known, shards, at)
        for part in ("again", "asked", "known", "grown"):
            remove(self.spark, f"{at}/{part}")
        return {"kind": "insert", "keys": keys, "shards": wanted}

    def _ask(self, last: dict, added: DataFrame, at: str) -> DataFrame:
        """The keys of ``added`` that the filters may hold."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return left.slice(0, 0)
            return left.filter(pa.array(CuckooFilter.from_bytes(right["blob"][0].as_py()).contains(_keys_of(left))))

        asked = _sharded(added, last["shards"]).groupBy("shard").cogroup(self._read(last, "filters").groupBy("shard"))
        return settle(asked.applyInArrow(probe, "shard int, h1 bigint, h2 bigint"), f"{at}/asked")

    def _grow(self, entries, added, seen, known, shards, at) -> None:
        """Filters with the keys that are new: those that no filter had seen, and those
        seen by mistake."""
        mistaken = seen.join(known, KEY, "left_anti").select(*KEY)
        new = added.join(seen.select(*KEY), KEY, "left_anti").select(*KEY).unionByName(mistaken)
        now = self._changed(entries[-1], new, f"{at}/grown", lambda f, keys: f.insert(keys) if f.has_room(len(keys)) else None, True)
        full = now.where("blob IS NULL").select("shard")
        if full.isEmpty():
            settle(now, f"{at}/filters")
            return
        every = self._counts(entries).select(*KEY).unionByName(new)
        of_full = _sharded(every, shards).join(full, "shard", "left_semi")
        settle(now.where("blob IS NOT NULL").unionByName(_build_filters(of_full, shards)), f"{at}/filters")

    def _changed(self, last: dict, keys: DataFrame, at: str, change, may_fill: bool = False) -> DataFrame:
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            blob = right["blob"][0].as_py() if right.num_rows else None
            if left.num_rows:
                cuckoo, mine = CuckooFilter.from_bytes(blob) if blob else CuckooFilter.for_keys(left.num_rows), _keys_of(left)
                if may_fill and not cuckoo.has_room(len(mine)):
                    blob = None
                else:
                    change(cuckoo, mine)
                    blob = cuckoo.to_bytes()
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

        both = _sharded(keys, last["shards"]).groupBy("shard").cogroup(self._read(last, "filters").groupBy("shard"))
        return settle(both.applyInArrow(run, "shard int, blob binary"), at)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out; ids that the index doesn't hold are ignored."""
        self._committed(lambda entries, at: self._delete(entries, doc_ids, at) if entries else None)

    def _delete(self, entries: list[dict], doc_ids: DataFrame, at: str) -> dict | None:
        ids = settle(self._live(entries, "docs").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi"), f"{at}/ids")
        if ids.isEmpty():
            remove(self.spark, at)
            return None
        gone = self._live(entries, "lines").join(ids, "doc_id", "left_semi")
        less = settle(gone.groupBy(*KEY).agg((-F.count("*")).alias("refs")), f"{at}/counts")
        before = self._counts(entries, less.select(*KEY)).withColumnRenamed("refs", "had")
        dead = settle(less.join(before, KEY).where("had + refs <= 0").select(*KEY), f"{at}/dead")
        self._changed(entries[-1], dead, f"{at}/filters", lambda f, keys: f.delete(keys))
        keys = entries[-1]["keys"] - dead.count()
        remove(self.spark, f"{at}/dead")
        return {"kind": "delete", "keys": keys, "shards": entries[-1]["shards"]}

    def compact(self) -> None:
        """Sum up the log; folders of the batches before go."""
        old: list[dict] = []

        def write(entries, at):
            old[:] = entries
            settle(self._live(entries, "docs"), f"{at}/docs")
            settle(self._live(entries, "lines"), f"{at}/lines")
            settle(self._counts(entries), f"{at}/counts")
            settle(self._read(entries[-1], "filters"), f"{at}/filters")
            return {"kind": "insert", "base": True, "keys": entries[-1]["keys"], "shards": entries[-1]["shards"]}

        if self._committed(lambda entries, at: write(entries, at) if entries else None):
            for e in old:
                remove(self.spark, f"{self.path}/{e['at']}")

    def repeats(self) -> DataFrame:
        """(doc_id, text_hash, lines): the numbers of the lines that each live document loses."""
        entries = self.log.entries()
        shared = self._counts(entries).where("refs > 1").select(*KEY)
        again = settle(self._live(entries, "lines").join(shared, KEY, "left_semi"), f"{self.path}/again-{uuid.uuid4().hex}")
        place = F.struct("doc_id", "text_hash", "line_no")
        owners = again.groupBy(*KEY).agg(F.min(place).alias("owner"))
        lost = again.join(owners, KEY).where(F.col("owner") != place)
        return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines"))

    def apply(self, docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
        """``docs`` with only the lines that they keep; see ``dedup_lines``."""
        doc, hash_, gone = unused(docs, "__gf_doc", "__gf_hash", "__gf_lost")
        lost = self.repeats().select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.col("lines").alias(gone))
        joined = docs.join(lost.hint("shuffle_hash"), (F.col("doc_id") == F.col(doc)) & (text_hash() == F.col(hash_)), "left")
        at = docs.columns.index("text")
        size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

        def cut(batches):
            for b in slices(batches, b_name):
                lists = b.column(b.num_columns - 1)
                own = b.columns[:-1]
                losing = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                if len(losing):
                    texts, keep = own[at].to_pylist(), np.ones(b.num_rows, dtype=bool)
                    sizes = own[size].to_pylist() if size is not None else None
                    for r in losing.tolist():
                        drop = set(lists[r].values.to_pylist())
                        texts[r] = "\n".join(x for i, x in enumerate(texts[r].split("\n")) if i not in drop)
                        keep[r] = not drop_emptied or _VISIBLE.search(texts[r]) is not None
                        if sizes is not None:
                            sizes[r] = len(texts[r])
                    own[at] = pa.array(texts, own[at].type)
                    if size is not None:
                        own[size] = pa.array(sizes, own[size].type)
                    yield pa.RecordBatch.from_arrays(own, names=docs_names).filter(pa.array(keep))
                else:
                    yield pa.RecordBatch.from_arrays(own, names=docs_names)

        b_name, docs_names = docs.columns[at], docs.columns
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(cut, docs.schema)


def dedup_lines(docs: DataFrame, path: str | None = None, drop_emptied: bool = True, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with only the first copy of every line, in (doc_id, line_no) order.

    All columns are kept; ``text`` is what is left, and ``n_chars``, if it is there,
    its new length. A document that loses a line and has no visible one left is
    dropped if ``drop_emptied``.
    """
    index = LineIndex(docs.sparkSession, path, shard_keys)
    index.insert(docs)
    return index.apply(docs, drop_emptied)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines they repeat. The whole table comes in as two batches,
    the second asking the filters of the first; an eighth is then deleted and inserted
    again, after which the index holds what it would after one insertion."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index, eighth = LineIndex(spark), F.pmod(F.xxhash64("doc_id"), F.lit(8))
    index.insert(docs.where(eighth % 2 == 0))
    index.insert(docs.where(eighth % 2 == 1))
    index.delete(docs.where(eighth == 3).select("doc_id"))
    index.insert(docs.where(eighth == 3))
    return index.apply(docs)


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line, lang, source, n_chars
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents),
       LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), ranked AS (
  SELECT *, regexp_matches(line, '[^ \t\n\x0B\f\r]') AS seen,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS rn
  FROM lines
), docs AS (
  SELECT doc_id, lang, source, any_value(n_chars) AS n0,
         string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT seen OR rn = 1) AS kept,
         count(*) FILTER (WHERE seen AND rn > 1) AS lost,
         count(*) FILTER (WHERE seen AND rn = 1) AS visible
  FROM ranked GROUP BY doc_id, lang, source
)
SELECT doc_id, kept AS text, lang, source,
       CASE WHEN lost = 0 THEN n0 ELSE length(kept) END AS n_chars
FROM docs WHERE lost = 0 OR visible > 0
"""
