from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import fuzzyhash, linedup, substring, textkit
from gaugeflow.llm.components import components
from gaugeflow.llm.shared import workdir

from .helpers import prose, rows, words

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DDL)


def brute_spans(texts, least):
    places = {}
    for d, t in texts.items():
        w = words(t)
        for p in range(len(w) - least + 1):
            places.setdefault(tuple(w[p : p + least]), []).append((d, p))
    own = {}
    for where in places.values():
        if len(where) > 1:
            for d, p in where:
                own.setdefault(d, set()).add(p)
    out = set()
    for d, ps in own.items():
        start = end = None
        for p in sorted(ps):
            if end is None or p > end:
                if end is not None:
                    out.add((d, start, end))
                start = p
            end = p + least
        out.add((d, start, end))
    return out


def test_words_and_windows_match_plain_python():
    import pyarrow as pa

    texts = ["Ab c,d", None, "", "é É x", "c", "c d", "e" * 50]
    w = textkit.words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len({(a, int(h)) for a, h in zip(flat, w.hashes)}) == len(set(flat)) == len(set(w.hashes.tolist()))
    grams = textkit.windows(w.hashes, 2)
    assert len(grams) == len(flat) - 1 and (textkit.windows(w.hashes, 99) == grams[:0]).all()


def test_minimizers_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 15, 4)
        v = rng.integers(0, 50, sizes.sum()).astype(np.uint64)
        text, want, at = np.repeat(np.arange(4), sizes), set(), 0
        for n in sizes:
            own = v[at : at + n]
            for s in range(max(1, n - 4)):
                run = own[s : s + 5]
                want |= {at + s + i for i in range(len(run)) if run[i] == run.min()}
            at += n
        assert set(textkit.minimizers(v, text, 5).tolist()) == want


@pytest.mark.parametrize("seed", range(2))
def test_substring_spans_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    shared = [prose(rng, n) for n in (6, 9, 17, 40)]
    texts = {}
    for d in range(24):
        parts = [prose(rng, int(rng.integers(0, 12)))]
        for s in rng.choice(4, int(rng.integers(0, 3))):
            parts += [shared[s], prose(rng, int(rng.integers(0, 9)))]
        texts[d] = " ".join(parts)
    texts[30], texts[31], texts[32] = texts[3], texts[3], shared[3] + " " + shared[3]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = substring.repeated_spans(df, min_words=8).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == brute_spans(texts, 8)
    assert all(r["n_words"] == r["end_word"] - r["start_word"] >= r["level"] >= 8 for r in got)
    grams = Counter(tuple(words(t)[p : p + 8]) for t in texts.values() for p in range(len(words(t)) - 7))
    assert sum(r["n_first"] for r in got) == sum(n > 1 for n in grams.values())
    assert sum(r["n_windows"] for r in got) == sum(n for n in grams.values() if n > 1)


def test_substring_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c d", 1), (3, "a b c d", 1), (3, "a b c d", 1), (4, "x", 1)], "doc_id bigint, text string, h int")
    assert [tuple(r)[:4] for r in substring.repeated_spans(df, 4).collect()] == [(3, 0, 4, 4)]
    assert substring.repeated_spans(df.limit(0), 4).count() == 0
    one_id = spark.createDataFrame([(7, "a b c d e f g h"), (7, "a b c d x y z"), (8, "q a b c d e f")], "doc_id bigint, text string")
    assert {tuple(r)[:3] for r in substring.repeated_spans(one_id, 4).collect()} == {(7, 0, 6), (7, 0, 4), (8, 1, 7)}
    twice = spark.createDataFrame([(1, "a b c d"), (2, "A, b! c d"), (3, "y a b c d z")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["start_word"]) for r in substring.repeated_spans(twice, 4).collect()} == {(1, 0), (2, 0), (3, 1)}


def brute_lines(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        t = texts[d]
        if t is None:
            out[d] = None
            continue
        kept, lost = [], 0
        for line in t.split("\n"):
            if line.strip() and line in seen:
                lost += 1
            else:
                kept.append(line)
            if line.strip():
                seen.add(line)
        if not lost or any(x.strip() for x in kept):
            out[d] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = [prose(rng, 3, 30) for _ in range(25)] + ["", "  "]
    texts = {i: "\n".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(1, 9)))) for i in range(60)} | {70: None, 71: ""}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DDL)
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(df, shard_keys=8).collect()}
    assert got == brute_lines(texts)


def held_keys(index):
    """The keys of the exact counts, each of which its shard's filter must hold."""
    filters = {r["shard"]: linedup.CuckooFilter.from_bytes(bytes(r["blob"])) for r in index.filters().collect()}
    shards = index.log.entries()[-1]["shards"]
    refs = index.refs().collect()
    for r in refs:
        key = linedup.filter_keys(np.array([r["h1"]]), np.array([r["h2"]]))
        assert filters[r["h2"] % shards].contains(key)[0]
    held = sum(int((f.table != 0).sum()) + len(f.stash) for f in filters.values())
    assert held == len(refs) == index.log.entries()[-1]["keys"]
    return rows(index.refs().select("h1", "h2", "refs"))


def test_line_index_is_reversible_and_incremental(spark):
    rng = np.random.default_rng(2)
    pool = [prose(rng, 3, 30) for _ in range(40)]
    texts = {i: "\n".join(pool[j] for j in rng.integers(0, 40 if i >= 30 else 25, 5)) for i in range(50)}
    all_ = table(spark, [texts[i] for i in range(50)])
    first, second = all_.where("doc_id < 30"), all_.where("doc_id >= 30")
    index = linedup.LineIndex(spark, workdir(spark, "t"), 16)
    index.insert(first)
    before = held_keys(index)
    index.insert(second)
    index.insert(second)
    whole = linedup.LineIndex(spark, workdir(spark, "t"), 16)
    whole.insert(all_)
    assert held_keys(index) == held_keys(whole) and rows(index.lines()) == rows(whole.lines())
    assert {r["doc_id"]: r["text"] for r in index.apply(all_).collect()} == brute_lines(texts)
    index.delete(second.select("doc_id"))
    index.delete(spark.createDataFrame([(999,)], "doc_id bigint"))
    assert held_keys(index) == before
    index.compact()
    assert held_keys(index) == before and len(index.log.entries()) == 1
    index.delete(first.where("doc_id < 10").select("doc_id"))
    rest = linedup.LineIndex(spark, workdir(spark, "t"), 16)
    rest.insert(first.where("doc_id >= 10"))
    assert held_keys(index) == held_keys(rest)
    left = {i: t for i, t in texts.items() if 10 <= i < 30}
    assert {r["doc_id"]: r["text"] for r in index.apply(all_.where("doc_id BETWEEN 10 AND 29")).collect()} == brute_lines(left)


def test_line_index_of_two_writers(spark):
    index = linedup.LineIndex(spark, workdir(spark, "t"))
    one, two = table(spark, ["a\nb", "c"]), table(spark, ["b\nd"], 10)
    inner = index._insert

    def overtaken(entries, docs, at):
        index._insert = inner
        linedup.LineIndex(spark, index.path).insert(two)
        return inner(entries, docs, at)

    index._insert = overtaken
    index.insert(one)
    assert [e["number"] for e in index.log.entries()] == [1, 2]
    assert held_keys(index) and {r["doc_id"] for r in index.lines().collect()} == {0, 1, 10}


def test_line_dedup_defined_cases(spark):
    df = spark.createDataFrame([(None, "a", 1, 1), (1, "a\nb", 1, 3), (2, "a", 1, 1), (3, None, 1, None), (4, "", 1, 0)], "doc_id bigint, text string, __x int, n_chars bigint")
    out = linedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"] is not None) == [(0, "a"), (1, "a\nb"), (4, "")]
    assert linedup.dedup_lines(df.limit(0)).count() == 0
    assert out.where("doc_id = 3").count() == 1
    one_id = spark.createDataFrame([(7, "x\ny\nz"), (7, "p\nq\nonly here"), (7, "p\nq\nonly here"), (8, "z\nw")], "doc_id bigint, text string")
    got = sorted(r["text"] for r in linedup.dedup_lines(one_id).collect())
    assert got == ["p\nq\nonly here", "p\nq\nonly here", "w", "x\ny\nz"]


def test_line_dedup_of_many_repeated_lines_is_quick(spark):
    import time

    many = "\n".join(f"line {i % 100_000}" for i in range(200_000))
    began = time.time()
    got = linedup.dedup_lines(table(spark, [many, "line 7\nmore"])).collect()
    assert sorted(len(r["text"].split("\n")) for r in got) == [1, 100_000] and time.time() - began < 60


def test_cuckoo_filter_under_load():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    f = linedup.CuckooFilter.for_keys(len(keys))
    f.insert(keys[:2000])
    f.insert(keys[2000:])
    assert f.contains(keys).all()
    others = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.contains(others).mean() < 0.002
    again = linedup.CuckooFilter.from_bytes(f.to_bytes())
    twice = linedup.CuckooFilter.for_keys(64)
    twice.insert(np.repeat(keys[:1], 12))
    twice.delete(np.repeat(keys[:1], 11))
    assert twice.contains(keys[:1]).all()
    twice.delete(keys[:1])
    assert not twice.contains(keys[:1]).any() and not twice.table.any() and not twice.stash
    again.delete(keys[:1000])
    assert again.contains(keys[1000:]).all() and again.contains(keys[:1000]).mean() < 0.01


def test_golay_decoding_is_perfect():
    rng = np.random.default_rng(0)
    code = [(i << 11) | fuzzyhash._remainder(i << 11) for i in range(4096)]
    words_ = np.array(code, dtype=np.int32)
    assert min(int(c).bit_count() for c in code[1:]) == 7
    pick = rng.integers(0, 4096, 500)
    v = words_[pick].copy()
    for k in range(500):
        for b in rng.choice(23, int(rng.integers(0, 4)), replace=False):
            v[k] ^= 1 << int(b)
    assert (fuzzyhash.decode(v) == pick).all()


def test_two_segments_at_two_bits_share_a_key_with_all_probes():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 300).astype(np.int32)
    for distance in (0, 1, 2):
        u = v.copy()
        for k in range(len(v)):
            for b in rng.choice(23, distance, replace=False):
                u[k] ^= 1 << int(b)
        m = np.ones((len(v), 23))
        a, b = fuzzyhash.segment_keys(v, m, 24), fuzzyhash.segment_keys(u, m, 24)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))


def test_near_copies_are_grouped_and_clean_documents_left_alone(spark):
    rng = np.random.default_rng(3)
    base = [prose(rng, 200, 5000) for _ in range(40)]
    texts = list(base)
    for i in range(20):
        w = base[i].split()
        w[int(rng.integers(0, 200))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0], base[0], None, ""]
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in fuzzyhash.near_groups(table(spark, texts)).collect()}
    assert all(got[40 + i][0] == i for i in range(20)) and got[60] == got[61] == (0, False)
    assert set(got) == set(range(20)) | set(range(40, 62))
    kept = fuzzyhash.drop_near_copies(table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 62, 63]


def test_near_copies_in_groups_of_two_are_found_by_distance(spark):
    import pyarrow as pa

    rng = np.random.default_rng(11)
    texts = []
    for i in range(500):
        w = [f"p{i}x{j}" for j in range(200)]
        other = list(w)
        for j in range(2 + i % 30):
            other[j] = f"q{i}x{j}"
        rng.shuffle(other)
        texts += [" ".join(w), " ".join(other)]
    distinct, _, ones = fuzzyhash.signatures(pa.array(texts))
    bits = 2 * ones > distinct[:, None]
    apart = (bits[::2] != bits[1::2]).sum(axis=1)
    together = {tuple(sorted((r["doc_id"], r["group_id"]))) for r in fuzzyhash.near_groups(table(spark, texts)).where("NOT keep").collect()}
    found = np.array([(2 * i, 2 * i + 1) in together for i in range(500)])
    assert len(together) == found.sum()
    assert found[apart <= 11].all() and not found[apart > fuzzyhash.DISTANCE].any()
    far = (apart > 15) & (apart <= fuzzyhash.DISTANCE)
    assert far.sum() >= 80 and found[far].mean() >= 0.93


def test_simhash_links_equal_brute_force_within_buckets():
    rng = np.random.default_rng(5)
    key = np.repeat(np.arange(3), (5, 90, 1))
    f = rng.integers(0, 4, (len(key), 2)).astype(np.uint64)
    a, b = fuzzyhash._bucket_links(key, f[:, 0], f[:, 1], 1)

    def groups(pairs):
        root = list(range(len(key)))
        for x, y in pairs:
            rx, ry = root[x], root[y]
            root = [rx if r == ry else r for r in root]
        return [min(j for j in range(len(key)) if root[j] == r) for r in root]

    brute = [(i, j) for i in range(len(key)) for j in range(i) if key[i] == key[j] and sum(int(x).bit_count() for x in f[i] ^ f[j]) <= 1]
    assert groups(zip(a.tolist(), b.tolist())) == groups(brute)


def test_crowded_keys_are_split_without_losing_links(spark):
    rng = np.random.default_rng(8)
    w = prose(rng, 60, 5000).split()
    texts = []
    for _ in range(80):  # near copies of one text: they share their keys
        own = list(w)
        own[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 99999))}"
        texts.append(" ".join(own))
    texts += [prose(rng, 60, 5000) for _ in range(40)]
    df = table(spark, texts)
    plain, split = rows(fuzzyhash.near_groups(df)), rows(fuzzyhash.near_groups(df, hot=7))
    assert plain == split and len(plain) >= 78


def test_near_copies_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    one, other = prose(rng, 40, 5000), prose(rng, 40, 5000)
    df = table(spark, [one]).union(table(spark, [one + " tail", other], 1).withColumn("doc_id", F.lit(2).cast("bigint")))
    assert sorted(r["text"] for r in fuzzyhash.drop_near_copies(df).collect()) == sorted([one, other])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(200, 200), (5, 4)]
    got = dict(rows(components(spark.createDataFrame(edges, "u bigint, v bigint"), workdir(spark, "c")).select("node", "root")))
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 120)}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), workdir(spark, "c")).count() == 0


def test_simhash_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 1), (1, "a b", 1), (2, "b, a", 1), (3, None, 1)], "doc_id bigint, text string, words int")
    assert rows(fuzzyhash.near_groups(df).select("doc_id", "group_id", "group_size")) == [(1, 1, 2), (2, 1, 2)]
    assert fuzzyhash.near_groups(df.limit(0)).count() == 0
    assert fuzzyhash.drop_near_copies(df).select("words").where(F.col("words") == 1).count() == 4
