import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugeflow.llm import cotrain, crosspoly, langmask, packing, textkit, tokens, token_rollup, winnow, wrappers
from gaugeflow.llm.shared import CommitLog, workdir

from .helpers import prose, rows, words

TOKENIZER = tokens.BYTE_BPE


# token counts


def brute_totals(state):
    out = {}
    for text, source, lang in state.values():
        n = len(words(text))
        d, t = out.get((source, lang), (0, 0))
        out[source, lang] = d + 1, t + n
    return {k: v for k, v in out.items()}


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    rng = np.random.default_rng(0)
    roll = token_rollup.TokenRollup(spark, {"words": tokens.WORDS}, workdir(spark, "t"))
    state = {}
    ddl = "doc_id bigint, op string, seq bigint, text string, source string, lang string"
    for k in range(4):
        batch = []
        for _ in range(25):
            d, op = int(rng.integers(0, 20)), ["insert", "revise", "delete"][int(rng.integers(0, 3))]
            batch.append((d, op, len(batch), None if rng.random() < 0.1 else prose(rng, int(rng.integers(0, 9))), [None, "a", "b"][int(rng.integers(0, 3))], "x"))
        for d, op, _, text, source, lang in batch:
            if op == "delete":
                state.pop(d, None)
            else:
                state[d] = (text, source, lang)
        df = spark.createDataFrame(batch, ddl)
        assert roll.apply(f"b{k}", df) and not roll.apply(f"b{k}", df)
        assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in roll.totals().collect()} == brute_totals(state)


def test_rollup_defined_cases(spark):
    roll = token_rollup.TokenRollup(spark, {"words": tokens.WORDS}, workdir(spark, "t"))
    assert roll.totals().count() == 0
    df = spark.createDataFrame([(None, "insert", "a b", None, None, 1), (None, "insert", None, None, None, 1), (1, "delete", "x", "s", "l", 1)], "doc_id bigint, op string, text string, source string, lang string, tokens int")
    assert roll.apply("x", df.limit(0)) and roll.totals().count() == 0
    roll.apply("y", df)
    assert rows(roll.totals().select("docs", "tokens")) == [(2, 2)]


ROLL = "doc_id bigint, op string, text string, source string, lang string"


def test_rollup_takes_back_every_version_that_counted(spark):
    at = workdir(spark, "t")
    one = token_rollup.TokenRollup(spark, {"words_v1": tokens.WORDS}, at)
    one.apply("a", spark.createDataFrame([(1, "insert", "a b c", "s", "l"), (2, "insert", "d", "s", "l"), (3, None, "e f", "s", "l")], ROLL))
    two = token_rollup.TokenRollup(spark, {"words_v2": tokens.WORDS}, at)
    two.apply("b", spark.createDataFrame([(1, "delete", None, None, None), (2, "revise", "g h", "s", "l")], ROLL))
    assert rows(two.totals().select("tokenizer", "docs", "tokens")) == [("words_v1", 1, 2), ("words_v2", 1, 2)]


def test_rollup_compacts_and_keeps_batches_apart(spark):
    roll = token_rollup.TokenRollup(spark, {"w": tokens.WORDS}, workdir(spark, "t"))
    for k in range(4):
        roll.apply(f"b{k}", spark.createDataFrame([(k, "insert", "a " * (k + 1), "s", "l"), (None, "insert", "x", "s", "l")], ROLL))
    before = rows(roll.totals())
    roll.compact()
    assert rows(roll.totals()) == before == [("s", "l", "w", 8, 14)] and len(roll.log.entries()) == 1 and roll.committed() == ["b0", "b1", "b2", "b3"]
    assert not roll.apply("b2", spark.createDataFrame([(9, "insert", "z", "s", "l")], ROLL))
    roll.apply("c", spark.createDataFrame([(3, "delete", None, None, None)], ROLL))
    assert rows(roll.totals()) == [("s", "l", "w", 7, 10)]


def test_one_batch_sent_twice_at_the_same_time(spark):
    roll, batch = token_rollup.TokenRollup(spark, {"w": tokens.WORDS}, workdir(spark, "t")), spark.createDataFrame([(1, "insert", "a b", "s", "l")], ROLL)
    inner = roll._signed

    def overtaken(entries, changes):
        roll._signed = inner
        assert token_rollup.TokenRollup(spark, {"w": tokens.WORDS}, roll.path).apply("same", batch)
        return inner(entries, changes)

    roll._signed = overtaken
    assert roll.apply("same", batch) is False and rows(roll.totals()) == [("s", "l", "w", 1, 2)]


def test_commits_are_made_once(tmp_path, spark):
    from concurrent.futures import ThreadPoolExecutor

    log = CommitLog(spark, f"file://{tmp_path}/log")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: log.append(1, {"writer": k}), range(8)))
    assert sum(made) == 1 and log.entries() == [{"writer": made.index(True), "number": 1}]
    log._local = lambda: None  # by the file system's own rename
    assert log.append(2, {"base": True}) and not log.append(2, {}) and log.entries() == [{"base": True, "number": 2}]


def test_very_long_texts_are_worked_through_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["short One", None, "", " ".join(prose(rng, 900, 5000).split()) + " Ünïcode ÉTÉ.", "x" * 5000, "a b", "-" * 3000 + " end"]
    whole = textkit.words(pa.array(texts), prefix=4)
    grams = lambda: [np.concatenate([c[t == k - i] for i, j, c, t in langmask.grams(pa.array(texts)) if i <= k < j] or [np.zeros(0)]).tolist() for k in range(len(texts))]
    want, meta = grams(), cotrain.metadata_view(pa.array(texts), pa.array(["s"] * 7), pa.array(["l"] * 7))
    counts = tokens.token_counts(pa.array(texts), TOKENIZER)
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 64)
    monkeypatch.setattr(tokens, "PART", 50)
    parts = textkit.words(pa.array(texts), prefix=4)
    assert (parts.hashes == whole.hashes).all() and (parts.prefixes == whole.prefixes).all() and (parts.offsets == whole.offsets).all()
    assert grams() == want and tokens.token_counts(pa.array(texts), TOKENIZER).tolist() == counts.tolist()
    again = cotrain.metadata_view(pa.array(texts), pa.array(["s"] * 7), pa.array(["l"] * 7))
    assert again.index.tolist() == meta.index.tolist()
    values, text = rng.integers(0, 60, 3000).astype(np.uint64), np.sort(rng.integers(0, 40, 3000))
    chosen = textkit.minimizers(values, text, 7)
    monkeypatch.setattr(textkit, "BLOCK", 100)
    assert textkit.minimizers(values, text, 7).tolist() == chosen.tolist()


def test_token_counts_equal_a_second_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["Hello  world's 12 cafés\n\n x", "<|endoftext|>", "", "naïve — 東京"]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert tokens.token_counts(pa.array(texts), TOKENIZER).tolist() == want


# html


def site(rng, i):
    items = "".join(f'<li><a href="/{j}">link {int(rng.integers(0, 99))}</a></li>' for j in range(int(rng.integers(1, 6))))
    ad = f'<div class="ad">buy {i}</div>' if rng.random() < 0.5 else ""
    body = "".join(f"<p>text {i} {j} &amp; more</p>" for j in range(int(rng.integers(1, 5))))
    page = f'<html><head><title>Title {i}</title><script>x="</p>"</script></head><body><ul>{items}</ul><!-- c -->{ad}<h1>Title {i}</h1>{body}<footer>All rights reserved</footer></body></html>'
    slots = re.findall(r"<title>(.*?)</title>|>(link \d+)<|(buy \d+)|<h1>(.*?)</h1>|<p>(.*?)</p>(?!\")", page)
    return page, [next(x for x in m if x).replace("&amp;", "&") for m in slots]


def test_wrappers_extract_the_slots_of_a_template(spark):
    rng = np.random.default_rng(0)
    pages = [site(rng, i) for i in range(60)]
    df = spark.createDataFrame([(i, "https://Example.com/x", p) for i, (p, _) in enumerate(pages)], "page_id bigint, url string, html string").repartition(4)
    found = wrappers.infer(df)
    assert found.count() == 1 and found.first()["pages"] == 60
    got = {r["page_id"]: r for r in wrappers.extract(df, found).collect()}
    for i, (_, slots) in enumerate(pages):
        assert got[i]["host"] == "example.com" and got[i]["wrapper"] == 0
        assert [x for x in got[i]["text"].split("\n")] == slots
    again = {r["page_id"]: r["text"] for r in wrappers.extract(df, found, broadcast_limit=0).collect()}
    assert again == {i: r["text"] for i, r in got.items()}


def test_wrapper_shape_has_groups_and_optionals():
    rng = np.random.default_rng(1)
    w = wrappers.Wrappers()
    for i in range(40):
        w.learn(wrappers.tokens(site(rng, i)[0]))
    shapes = [s for s, _, _ in w.items[0]]
    assert "(<li <a T </a </li)+" in shapes and "(<p T </p)+" in shapes
    assert {s for s, _, o in w.items[0] if o} == {"<div.ad", "T", "</div"}
    assert ("T", wrappers.MANY + "All rights reserved", 0) in [tuple(i) for i in w.items[0]]


def as_regex(items):
    """A wrapper as a pattern of the standard library over one character per tag."""

    def one(item, names):
        shape, body, _ = item
        if isinstance(body, tuple):
            return "(?:" + "".join(one(i, names) for i in body) + ")+"
        return names.setdefault(shape, chr(0x100 + len(names)))

    names, out, at = {}, "", 0
    while at < len(items):
        end = at + 1
        while items[at][2] and end < len(items) and items[end][2] == items[at][2]:
            end += 1
        part = "".join(one(i, names) for i in items[at:end])
        out += f"(?:{part})?" if items[at][2] else part
        at = end
    return re.compile(out), names


@pytest.mark.parametrize("seed", range(6))
def test_every_page_is_accepted_and_the_automaton_agrees_with_a_regex(seed):
    rng = np.random.default_rng(seed)
    streams = []
    for _ in range(25):
        tags = [["<a", "</a", "<b", "</b", "<c"][int(k)] for k in rng.integers(0, 5, int(rng.integers(1, 14)))]
        streams.append([(t, None) for t in tags])
    w, half = wrappers.Wrappers(), wrappers.Wrappers()
    for s in streams[:12]:
        w.learn(s)
    for s in streams[12:]:
        half.learn(s)
    w.join(wrappers.Wrappers.from_json(half.to_json()))
    assert all(w.accepts(s) is not None for s in streams)
    for k, items in enumerate(w.items):
        pattern, names = as_regex(items)
        for s in streams + [s[:-1] for s in streams] + [s + s for s in streams]:
            text = "".join(names.get(t, "\x01") for t, _ in s)
            assert (w.automaton(k).run(s) is not None) == (pattern.fullmatch(text) is not None)


@pytest.mark.parametrize("pages", [2, 3])
def test_text_that_one_page_alone_has_is_extracted(spark, pages):
    make = lambda i, note="": f"<html><h1>Title {i}</h1><p>body {i}</p>{note}<footer>Same on all</footer></html>"
    html = [make(0), make(1, "<div class=note>Only here</div><table><tr><td>once</td></tr></table>"), make(2, "<ul><li>also alone</li></ul>")][:pages]
    df = spark.createDataFrame([(i, "http://few/x", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in wrappers.extract(df, wrappers.infer(df)).collect()}
    assert got[0] == ["Title 0", "body 0"] and got[1] == ["Title 1", "body 1", "Only here", "once"]
    assert pages == 2 or got[2] == ["Title 2", "body 2", "also alone"]


def test_a_constant_that_a_second_page_repeats_is_template():
    w = wrappers.Wrappers()
    page = lambda i, note: wrappers.tokens(f"<p>t{i}</p>" + (f"<b>{note}</b>" if note else "") + "<i>all</i>")
    for i, note in enumerate(["", "note", "note", ""]):
        w.learn(page(i, note))
    assert w.extract(page(9, "note"))[2] == ["t9"]


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_longest_common_subsequences(monkeypatch):
    rng = np.random.default_rng(3)
    cases = [tuple([f"<{k}" for k in rng.integers(0, 6, int(rng.integers(0, 70)))] for _ in "ab") for _ in range(40)]
    for bits in (1 << 30, 50):
        monkeypatch.setattr(wrappers, "TABLE_BITS", bits)
        for a, b in cases:
            got = wrappers._matches(a, b)
            assert len(got) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))


def test_broken_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<a " * 400_000, "<a \"" * 300_000, "<a '\"" * 200_000, "<" * 1_000_000, "<!-- " * 200_000, "<script>" * 100_000, "<p x='" + "<b>" * 200_000, "</" * 500_000):
        assert len(wrappers.tokens(page)) <= 400_001
    assert time.time() - began < 30
    assert wrappers.tokens("<p>a</p><b \"x>c</b>")[:4] == [("<p", None), ("T", "a"), ("</p", None), ("<b", None)]
    assert wrappers.tokens("x <a <b>y</b>") == [("T", "x"), ("<a", None), ("T", "y"), ("</b", None)]


def test_html_ties_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "http://h/x", "<p>a</p>"), (1, "http://h/x", "<p>a</p>"), (1, "http://h/x", "<p>b</p>"), (2, "http://h/x", "<p>b</p>")], "page_id bigint, url string, html string")
    assert rows(wrappers.extract(df, wrappers.infer(df)).select("page_id", "text")) == [(1, "a"), (1, "a"), (1, "b"), (2, "b")]


def test_html_defined_cases(spark):
    df = spark.createDataFrame(
        [(1, None, "<p>a</p>", 1), (2, "http://h/x", None, 1), (3, "http://h/y", "", 1), (None, "http://h/z", "<p>b</p><p", 1), (5, "nonsense", "x < y", 1), (6, "http://h/x", "<p>c &lt; d</p>", 1)],
        "page_id bigint, url string, html string, host int",
    )
    got = {r["page_id"]: (r["host"], r["text"]) for r in wrappers.extract(df, wrappers.infer(df)).collect()}
    assert len(got) == 6 and got[2] == ("h", None) and got[3] == ("h", "") and got[1][0] == got[5][0] == ""
    assert wrappers.infer(df.limit(0)).count() == 0 and wrappers.extract(df.limit(0), wrappers.infer(df.limit(0))).count() == 0
    long = wrappers.tokens("<div>" * 3000 + "x" * 100_000 + '<a title="1 > 0" class=k>' + "</div>" * 3000)
    assert len(long) == 6002 and ("<a.k", None) in long


# packing


def test_packing_is_a_partition_of_all_places(spark):
    rng = np.random.default_rng(0)
    texts = [prose(rng, int(n)) for n in rng.integers(0, 60, 200)] + [prose(rng, 900), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    out = packing.pack(df, window=128, open_windows=4, tokenizer_path=tokens.WORDS).collect()
    assert len({r["window_id"] for r in out}) == len(out)
    pieces = sorted((p["doc_id"], p["start"], p["places"]) for r in out for p in r["pieces"])
    want = sorted((i, s, min(128, len(words(t)) + 1 - s)) for i, t in enumerate(texts) if words(t) for s in range(0, len(words(t)) + 1, 128))
    assert pieces == want
    assert all(r["n_tokens"] == sum(p["places"] for p in r["pieces"]) <= 128 for r in out)
    assert sum(r["n_tokens"] for r in out) > 0.93 * 128 * len(out)
    assert packing.pack(df.limit(0), window=8).count() == 0


def test_packing_defined_cases(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "c", 1), (2, None, 1), (3, "", 1), (4, "d " * 40, 1)], "doc_id bigint, text string, n_tokens int")
    out = packing.pack(df, window=16, open_windows=2, tokenizer_path=tokens.WORDS).collect()
    places = Counter()
    for r in out:
        at = Counter((p["doc_id"], p["start"]) for p in r["pieces"])
        places += at
    assert places == Counter({(1, 0): 2, (None, 0): 1, (4, 0): 1, (4, 16): 1, (4, 32): 1})


def test_best_fit_emits_the_fullest():
    w = packing.OpenWindows(10, 2)
    assert w.place(6, ["a"]) is None and w.place(7, ["b"]) is None
    assert w.place(3, ["c"]) == (10, ["b", "c"])
    assert w.place(8, ["d"]) is None
    assert w.place(9, ["e"]) == (8, ["d"])
    assert sorted(w.rest()) == [(6, ["a"]), (9, ["e"])]


# classifier


def corpus(rng, n, start=0):
    good = ["river", "stone", "reason", "method", "history", "garden"]
    bad = ["click", "buy", "casino", "win", "cheap", "now"]
    out, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.5)
        own = good if y else bad
        text = " ".join(str(rng.choice(own)) if rng.random() < 0.4 else f"w{int(rng.integers(0, 300))}" for _ in range(40))
        out.append((start + i, (text.capitalize() + ".") if y else text.upper() + "!!!", "en", "web" if y else "ads", 40))
        labels.append(y)
    return out, labels


def test_cotraining_scores_held_out_documents(spark):
    rng = np.random.default_rng(0)
    docs, y = corpus(rng, 900)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, y[i], int(not y[i] and i % 2)) for i in range(250)], "doc_id bigint, quality int, toxic int")
    model = cotrain.train(df, labels)
    got = {r["doc_id"]: r for r in cotrain.score_all(df, model).collect()}
    assert np.mean([got[i]["keep"] == bool(y[i]) for i in range(250, 900)]) > 0.97
    kept = cotrain.drop_rejected(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_cotraining_learns_from_every_unlabelled_document(spark):
    docs, y = corpus(np.random.default_rng(1), 12_000)
    rare = ["gadfly", "hornet", "locust", "mosquito", "termite", "weevil"]
    bad = [i for i in range(250, 12_000) if not y[i]][:: 12_000 // 50][: 3 * len(rare)]
    for k, i in enumerate(bad):
        docs[i] = (i, f"{rare[k // 3]} {docs[i][1]}", *docs[i][2:])
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    labels = spark.createDataFrame([(i, y[i], 0) for i in range(250)], "doc_id bigint, quality int, toxic int")
    model = cotrain.train(df, labels)
    places = textkit.words(pa.array(rare)).hashes & np.uint64((1 << cotrain.TEXT_BITS) - 1)
    assert (model.text[places.astype(np.int64)] < 0).all()


def test_labels_that_are_joined_by_shuffle_give_the_same_model(spark):
    docs, y = corpus(np.random.default_rng(3), 300)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    strangers = [(i, 1, 0) for i in range(10_000, 10_500)]
    labels = spark.createDataFrame([(i, y[i], 0) for i in range(120)] + strangers, "doc_id bigint, quality int, toxic int")
    one, two = (rows(cotrain.classify(df, labels, broadcast_labels=n).select("doc_id", "p_good")) for n in (10**6, 0))
    scored = rows(cotrain.score_all(df, cotrain.train(df, labels)).select("doc_id", "p_good"))
    assert one == two == scored and len(one) == 300
    twice = df.union(df.limit(3)).union(spark.createDataFrame([(5000, "river " * 100_000, "en", "web", 1), (5000, "river " * 100_000, "en", "web", 1)], df.schema))
    got = rows(cotrain.classify(twice, labels).select("doc_id", "p_good"))
    assert len(got) == 305 and len({p for d, p in got if d == 5000}) == 1


def test_classifier_defined_cases(spark):
    ddl = "doc_id bigint, text string, lang string, source string, p_good int"
    df = spark.createDataFrame([(1, None, None, None, 1), (None, "a", "en", "s", 1), (1, "", "en", "s", 1)], ddl)
    none = spark.createDataFrame([(1, 1, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert cotrain.train(df, none) is None
    assert [r["keep"] for r in cotrain.score_all(df, None).collect()] == [True] * 3
    assert cotrain.score_all(df.limit(0), None).count() == 0 and cotrain.drop_rejected(df, None).count() == 3


# decontamination


def brute_shared(doc, item, least):
    a, b, out = words(doc), words(item), set()
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


@pytest.mark.parametrize("limit", [10**9, 0])
def test_winnowing_finds_every_shared_span(spark, limit):
    rng = np.random.default_rng(4)
    items = [prose(rng, 30, 60) for _ in range(5)]
    docs = []
    for i in range(25):
        w = items[i % 5].split()
        s, n = int(rng.integers(0, 12)), int(rng.integers(4, 18))
        docs.append(" ".join([prose(rng, 6, 60), *w[s : s + n], prose(rng, 5, 60)]))
    d = spark.createDataFrame([*enumerate(docs), (90, None), (91, "")], "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = set(rows(winnow.contaminated_spans(d, b, 4, 5, limit)))
    want = {(x, y, *s) for x, doc in enumerate(docs) for y, item in enumerate(items) for s in brute_shared(doc, item, 8)}
    assert got == want and want
    bad = {x for x, *_ in want}
    assert {r["doc_id"] for r in winnow.decontaminate(d, b, 4, 5, limit).collect()} == set(range(25)) - bad | {90, 91}
    assert winnow.decontaminate(d, b.limit(0), 4, 5, limit).count() == 27 and winnow.contaminated_spans(d.limit(0), b, 4, 5, limit).count() == 0


@pytest.mark.parametrize("limit", [10**9, 0])
def test_winnowing_knows_rows_without_an_id_or_with_a_repeated_one(spark, limit):
    rng = np.random.default_rng(6)
    first, second, clean = prose(rng, 12, 9000), prose(rng, 12, 9000), prose(rng, 12, 9000)
    docs = [(None, first), (None, clean), (1, second), (1, clean), (1, None), (2, first), (2, first)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(None, first), (7, second), (7, first), (8, None)], "item_id bigint, text string")
    got = Counter(tuple(r) for r in winnow.contaminated_spans(d, b, 4, 5, limit).collect())
    want = [(None, None), (None, 7), (1, 7), (2, None), (2, None), (2, 7), (2, 7)]
    assert got == Counter((x, y, 0, 0, 12) for x, y in want)
    kept = winnow.decontaminate(d, b, 4, 5, limit)
    assert kept.columns == d.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(None, clean), (1, clean), (1, None)])


# neighbours


def test_hadamard_is_the_matrix_product():
    h = np.array([[1]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(7, 16))
    assert np.allclose(crosspoly.hadamard(x), x @ h)


def recall_of(got, x, k=10):
    """Share of the true neighbours found, of the rows in ``got`` {row: {neighbour: cosine}}."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    who = sorted(got)
    sims = unit[who] @ unit.T
    sims[np.arange(len(who)), who] = -2
    best = np.argsort(-sims, axis=1)[:, :k]
    assert all(abs(sims[i, j] - c) < 1e-5 for i, w in enumerate(who) for j, c in got[w].items())
    return np.mean([len(set(b.tolist()) & set(got[w])) / k for w, b in zip(who, best)])


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["neighbour_id"]] = r["cosine"]
    return got


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


def test_neighbours_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 900)] + 0.7 * rng.normal(size=(900, 64))).astype(np.float32)
    got = found(crosspoly.neighbours(vectors(spark, x), least=64))
    assert len(got) == 900 and recall_of(got, x) > 0.9
    some = found(crosspoly.neighbours(vectors(spark, x), queries="vec_id % 20 = 0", least=64, block=100))
    assert set(some) == set(range(0, 900, 20)) and recall_of(some, x) > 0.9


def test_a_fit_takes_more_axes_where_neighbours_are_near(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(400, 32)), 12, axis=0) + 0.05 * rng.normal(size=(4800, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    asked = np.arange(0, 4800, 100)
    near = [x[np.argsort(-(x @ x[i]))[1:11]] for i in asked]
    axes, tables, probes = crosspoly.fitted(x[asked], near, 100_000_000, 0.05, 1 << 14, 0.95)
    assert axes > 1
    met = np.zeros((len(asked), 10), dtype=bool)
    for t in range(tables):
        probed = crosspoly.buckets(x[asked], t, axes, probes)
        met |= np.stack([(crosspoly.buckets(v, t, axes, 1)[:, :1] == p).any(axis=1) for v, p in zip(near, probed)])
    assert met.mean() >= 0.95
    loose = rng.normal(size=(300, 32)).astype(np.float32)
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    assert crosspoly.fitted(loose[:30], [loose[np.argsort(-(loose @ v))[1:11]] for v in loose[:30]], 300, 0.05, 1 << 14, 0.95)[0] == 1
    got = found(crosspoly.neighbours(vectors(spark, x), queries="vec_id % 100 = 0", index=(2, 4, 16), least=1))
    assert set(got) == set(asked.tolist()) and all(len(v) == 10 for v in got.values()) and recall_of(got, x) > 0.9


def test_copies_of_a_vector_and_crowded_buckets(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:200] = x[0]
    x[200:] = x[1] + 0.01 * x[200:]
    got = found(crosspoly.neighbours(vectors(spark, x), k=5, block=16, index=(1, 3, 8), least=1))
    assert set(got[0]) == {100, 101, 102, 103, 104} and set(got[100]) == {0, 101, 102, 103, 104} and set(got[150]) == {0, 100, 101, 102, 103}
    assert all(len(v) == 5 for v in got.values())
    crowd = {i: got[i] for i in range(200, 300)}
    assert recall_of(crowd, x, 5) > 0.97


def test_neighbours_defined_cases(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, e, 0), (2, e, 0), (3, None, 0), (4, [], 0), (5, [0.0] * 4, 0), (6, [float("nan")] * 4, 0), (7, [1.0], 0), (None, e, 0), (1, e, 0)], "vec_id bigint, embedding array<float>, rank int")
    assert rows(crosspoly.neighbours(df)) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    assert crosspoly.neighbours(df.limit(0)).count() == 0 and crosspoly.neighbours(df, queries="vec_id > 99").count() == 0
    ties = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("b", [0.0, -1.0]), ("d", [-2.0, -0.0])], "vec_id string, embedding array<float>")
    assert rows(crosspoly.neighbours(ties, k=2, queries="vec_id IN ('a', 'd')")) == [("a", "b", 1, 0.0), ("a", "c", 2, 0.0), ("d", "b", 1, 0.0), ("d", "c", 2, 0.0)]


# languages


def test_filter_says_what_sets_say():
    rng = np.random.default_rng(0)
    sets = {f"l{k:02d}": rng.integers(0, 2**32, 700).astype(np.uint32) for k in range(70)}
    f = langmask.LanguageFilter.build(sets)
    probe = rng.integers(0, 2**32, 5000).astype(np.uint32)
    for k, (_, s) in enumerate(sorted(sets.items())):
        bit = lambda codes: (f.masks(codes)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)  # noqa: B023, E731
        assert bit(s).all() and abs(bit(probe).mean() - f.wrong[k]) < 0.01


def test_languages_of_held_out_documents(spark):
    rng = np.random.default_rng(0)
    stems = {"aa": ["karo", "mili", "tasu"], "bb": ["xven", "grod", "plim"], "cc": ["øren", "åsta", "ünde"]}
    make = lambda k: " ".join(str(rng.choice(stems[k])) + str(rng.choice(stems[k])) for _ in range(15))
    truth = [("aa", "bb", "cc")[i % 3] for i in range(240)]
    docs = [(i, make(k), k if i < 150 else None) for i, k in enumerate(truth)]
    df = spark.createDataFrame(docs + [(900, None, None), (901, "", "aa"), (902, "12 .. 77", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langmask.identify(df, langmask.train(df)).collect()}
    assert all(got[i]["lang_id"] == truth[i] for i in range(240))
    assert got[900]["lang_id"] is None and got[901]["lang_id"] is None and got[901]["share"] == 0
    empty = df.limit(0)
    assert langmask.identify(df, langmask.train(empty)).where("lang_id IS NOT NULL").count() == 0 and langmask.identify(empty, langmask.train(df)).count() == 0


def test_language_defined_cases(spark):
    text = {"aa": "karo mili tasu karomi litasu ", "bb": "xven grod plim grodxven plimgrod "}
    ddl = "doc_id bigint, text string, lang string, share int"
    df = spark.createDataFrame([(i, t * 5, k, 1) for i, (k, t) in enumerate(text.items())] + [(7, text["aa"] * 60_000, "aa", 1), (8, text["bb"], None, 1), (8, text["bb"], None, 1), (None, text["aa"], None, 1)], ddl)
    got = rows(langmask.identify(df, langmask.train(df)).select("doc_id", "lang_id").where("doc_id IS NOT NULL"))
    assert got == [(0, "aa"), (1, "bb"), (7, "aa"), (8, "bb"), (8, "bb")]
    same = langmask.LanguageFilter.build({"x": np.array([5], np.uint32), "y": np.array([5], np.uint32)})
    assert same.masks(np.array([5], np.uint32))[0, 0] == 3
    tie = spark.createDataFrame([(1, "abcd efgh", None)], "doc_id bigint, text string, lang string")
    both = langmask.train(spark.createDataFrame([(1, "abcd efgh " * 9, "zz"), (2, "abcd efgh " * 9, "yy")], "doc_id bigint, text string, lang string"))
    assert langmask.identify(tie, both).first()["lang_id"] == "yy"


def test_languages_by_popcounts_of_sets(spark):
    """The trained filter against plain sets of n-grams by the same rule."""
    rng = np.random.default_rng(1)
    docs = [(i, " ".join("".join("abcdefgh"[k] for k in rng.integers(0, 3 + 2 * (i % 3), 5)) for _ in range(30)), "xyz"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    counts = {k: Counter() for k in "xyz"}
    split = lambda t: [t[p : p + 4] for p in range(len(t) - 3) if t[p : p + 4].count(" ") < 2]
    for _, t, k in docs:
        counts[k].update(split(t))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    sets = {k: {g for g, n in counts[k].items() if n >= 5 and rate[k][g] >= 0.02 * best[g]} for k in counts}
    model = langmask.train(df)
    got = {r["doc_id"]: r["lang_id"] for r in langmask.identify(df, model).collect()}
    for d, t, _ in docs:
        share = {k: sum(g in s for g in split(t)) / len(split(t)) for k, s in sets.items()}
        top = max(share.values())
        assert share[got[d]] >= top - 0.03 if top >= 0.33 else got[d] is None or share[got[d]] >= 0.27


# whole chain


def test_pipeline_is_its_stages_in_order(spark, tmp_path):
    import corpus_pipeline as C

    rng = np.random.default_rng(7)
    docs, y = corpus(rng, 300)
    near = docs[0][1] if y[0] else next(d[1] for d, k in zip(docs, y) if k)
    item = " ".join(f"bench{i}" for i in range(30))
    extra = [(1000, near + " tail", "en", "web", 40), (1001, "River stone reason method history garden. " + item, "en", "web", 40)]
    spark.createDataFrame(docs + extra, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y[i], 0) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r["doc_id"] for r in table.collect()}]
    for _, stage in C.STAGES[:-1]:
        path = f"{tmp_path}/s{len(seen)}"
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(path)
        table = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in table.collect()})
        assert seen[-1] <= seen[-2]
    assert 1000 in seen[1] and 1000 not in seen[3] and 1001 in seen[3] and 1001 not in seen[4]
    packed = {p["doc_id"] for r in C.run(spark, str(tmp_path)).collect() for p in r["pieces"]}
    assert packed == seen[-1] and len(packed & {i for i in range(300) if y[i]}) > 0.95 * sum(y)


def test_pipeline_defined_cases(spark, tmp_path):
    import corpus_pipeline as C

    rng = np.random.default_rng(9)
    docs, y = corpus(rng, 120)
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, __gf_lost int"
    good = next(t for (_, t, *_), k in zip(docs, y) if k)
    odd = [(None, good, "en", "web", 40), (500, None, None, None, None), (501, "", "en", "web", 0), (502, good, "en", "web", 40), (502, good, "en", "web", 40)]
    table = spark.createDataFrame([(*d, "w", 1) for d in docs + odd], ddl)
    spark.createDataFrame([(i, y[i], 0) for i in range(100)] + [(None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bench " * 20), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, table, str(tmp_path))
        empty = stage(spark, table.limit(0), str(tmp_path))
        assert empty.columns == out.columns and empty.count() == 0
        if name != "packing":
            assert out.columns == table.columns
            assert out.where("doc_id IS NULL").count() == 1 and {500, 501} >= {r["doc_id"] for r in out.where("doc_id IN (500, 501)").collect()}
    packed = [p["doc_id"] for r in out.collect() for p in r["pieces"]]
    assert packed.count(502) == 2 and packed.count(None) == 1 and not {500, 501} & set(packed)
