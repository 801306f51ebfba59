"""The registered queries over the smallest tables: against SQL, or brute force where SQL has no form."""

import html
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gaugeflow.llm import fuzzyhash, tokens
from gaugeflow.llm.queries import ORACLE_SQL, QUERIES

from .helpers import WORD, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_rollup_counts_every_document(spark, docs):
    want = Counter()
    for text, source, lang in zip(docs["text"].to_pylist(), docs["source"].to_pylist(), docs["lang"].to_pylist()):
        want[source, lang, "words_v1"] += len(words(text))
        want[source, lang, "byte_bpe_50k"] += len(tokens.encoder(tokens.BYTE_BPE).encode_ordinary(text or ""))
    got = QUERIES["op1_token_rollup"](spark, SF).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): r["tokens"] for r in got} == dict(want)
    assert sum(r["docs"] for r in got) == 2 * docs.num_rows


def test_html_of_every_page(spark):
    pages = pq.read_table(f"{SF}/pages.parquet")
    got = QUERIES["op3_html_extraction"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages["page_id"].to_pylist())
    assert all(r["wrapper"] is not None and r["text"] for r in got)
    source = dict(zip(pages["page_id"].to_pylist(), pages["html"].to_pylist()))
    for r in got:
        title = source[r["page_id"]].split("<title>")[1].split("</title>")[0]
        assert " ".join(html.unescape(title).split()) in r["text"]


def test_packing_places_every_token_once(spark, docs):
    want = {}
    for d, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        n = len(tokens.encoder(tokens.BYTE_BPE).encode_ordinary(t or ""))
        want[d] = n + 1 if n else 0
    got = Counter()
    for r in QUERIES["op4_packing"](spark, SF).collect():
        assert r["n_tokens"] <= 2048
        for p in r["pieces"]:
            got[p["doc_id"]] += p["places"]
    assert got == Counter({d: n for d, n in want.items() if n})


def test_near_groups_against_all_pairs(spark, docs):
    distinct, sets, ones = fuzzyhash.signatures(docs["text"].combine_chunks())
    ids = docs["doc_id"].to_pylist()
    bits = 2 * ones > distinct[:, None]
    gap = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    long = distinct >= fuzzyhash.LEAST_WORDS
    same = (sets[:, None] == sets[None, :]) & (distinct > 0)[:, None] & (distinct > 0)[None, :]
    near = np.triu(same | ((gap <= fuzzyhash.DISTANCE) & long[:, None] & long[None, :]), 1)
    group = {r["doc_id"]: r["group_id"] for r in QUERIES["op5_simhash_near_dedup"](spark, SF).collect()}
    pairs = list(zip(*np.nonzero(near)))
    found = [ids[i] in group and group[ids[i]] == group.get(ids[j]) for i, j in pairs]
    assert pairs and np.mean(found) >= 0.95
    root = list(range(len(ids)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    where = {d: root[i] for i, d in enumerate(ids)}
    assert all(where[d] == where[g] for d, g in group.items())


def test_neighbours_of_the_queries_among_all_vectors(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    x = np.array(table["embedding"].to_pylist(), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array(table["vec_id"].to_pylist())
    asked = np.flatnonzero(ids % 20 == 0)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    best = ids[np.argsort(-sims, axis=1)[:, :10]]
    got = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert set(got) == set(ids[asked].tolist()) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(b.tolist())) / 10 for i, b in zip(ids[asked].tolist(), best)]) >= 0.95


def test_quality_and_language_agree_with_what_is_known(spark, docs):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    keep = {r["doc_id"]: r["keep"] for r in QUERIES["op6_quality"](spark, SF).collect()}
    assert len(keep) == docs.num_rows and np.mean([keep[r["doc_id"]] == (r["quality"] == 1 and not r["toxic"]) for r in labels]) > 0.9
    lang = {r["doc_id"]: r["lang_id"] for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert np.mean([lang[d] == k for d, k in zip(docs["doc_id"].to_pylist(), docs["lang"].to_pylist())]) > 0.97


def test_languages_of_the_query_against_sets_of_grams(spark, docs):
    def grams(text):
        raw = bytes(c if WORD.fullmatch(bytes([c])) else 32 for c in (text or "").lower().encode())
        return [g for g in (raw[i : i + 4] for i in range(len(raw) - 3)) if g.count(32) < 2]

    table = docs.select(["doc_id", "text", "lang"]).to_pylist()
    each = {r["doc_id"]: grams(r["text"]) for r in table}
    counts: dict[str, Counter] = {}
    for r in table:
        if r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(each[r["doc_id"]])
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    best: dict[bytes, float] = {}
    for rate in rates.values():
        for g, x in rate.items():
            best[g] = max(x, best.get(g, 0))
    sets = {k: {g for g, x in rate.items() if counts[k][g] >= 5 and x >= 1e-6 and x >= 0.02 * best[g]} for k, rate in rates.items()}
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert set(got) == set(each)
    for d, g in each.items():
        if not g:
            assert got[d]["lang_id"] is None and got[d]["share"] == 0
            continue
        share = sorted(((sum(x in s for x in g) / len(g), k) for k, s in sets.items()), reverse=True)
        noise = 0.02 + 0.2 / len(g) ** 0.5  # of the filter's wrong answers
        assert abs(got[d]["share"] - share[0][0]) <= noise
        if share[0][0] - share[1][0] > noise and share[0][0] - 0.3 > noise:
            assert got[d]["lang_id"] == share[0][1]


def test_pipeline_against_brute_force(spark, docs):
    """Its windows against plain loops over the documents that the classifier keeps."""
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    good = {r["doc_id"] for r in QUERIES["op6_quality"](spark, SF).where("keep").collect()}
    visible = re.compile(r"[^ \t\n\x0b\f\r]").search
    held, left = set(), {}
    for d, text in sorted(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist())):
        if d in good:
            lines, lost = [], False
            for line in text.split("\n"):
                if visible(line) and line in held:
                    lost = True
                else:
                    lines.append(line)
                    held.add(line)
            if not lost or visible("\n".join(lines)):
                left[d] = "\n".join(lines)
    ids = list(left)
    distinct, sets, ones = fuzzyhash.signatures(pa.array(left.values(), pa.string()))
    bits = 2 * ones > distinct[:, None]
    root = {d: d for d in ids}  # in ascending order, so the least of a group stays
    for i, d in enumerate(ids):
        for j in range(i):
            both_long = min(distinct[i], distinct[j]) >= fuzzyhash.LEAST_WORDS
            if distinct[i] and distinct[j] and (sets[i] == sets[j] or (both_long and (bits[i] != bits[j]).sum() <= fuzzyhash.DISTANCE)):
                a, b = sorted((root[d], root[ids[j]]))
                root = {k: a if r == b else r for k, r in root.items()}

    def runs(text):
        w = words(text)
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    leaked = set().union(*(runs(t) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()))
    encode = tokens.encoder(tokens.BYTE_BPE).encode_ordinary
    places = {d: len(encode(t)) + 1 for d, t in left.items() if t and not runs(t) & leaked}
    want = {d for d in places if root[d] == d}
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["n_tokens"] == sum(p["places"] for p in r["pieces"]) <= 2048
        for p in r["pieces"]:
            got[p["doc_id"]] += p["places"]
    # keys may miss a pair of copies, which then both stay
    assert want <= set(got) and len(set(got) - want) <= 0.01 * len(want)
    assert want and all(n == places[d] for d, n in got.items())
