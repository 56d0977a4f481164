"""Operators on small tables, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelwright.llm import decontaminate, licenses, near_dups, packing, quality, repeats, token_counts, toxicity, url_rules, warc
from panelwright.llm.components import components
from tests.llm.test_kernels import ALNUM, LOWER, SPACED


# near duplicates
def classes(texts, ids, k, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = SPACED.findall((t or "").translate(LOWER))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, x in sets.items() for s in x if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(docs_of, corpus, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    sets, root = classes(corpus, range(len(corpus)), 4, 80)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs_of(corpus), shingle=4).collect()}
    assert len(got) == len(corpus)
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i][0]), root[i], root[i] == i)
    left = near_dups.drop_near_duplicates(docs_of(corpus), shingle=4)
    assert left.columns == docs_of(corpus).columns
    assert {r.doc_id for r in left.collect()} == {i for i in root if root[i] == i}


@pytest.mark.parametrize(("least", "meet"), [(4, 2048), (4, 8)])
def test_near_duplicates_frequent_keys(docs_of, monkeypatch, least, meet):
    """A large family of near copies: its keys count as frequent, and with a small meet go in blocks."""
    monkeypatch.setattr(near_dups, "FREQUENT_LEAST", least)
    monkeypatch.setattr(near_dups, "MEET", meet)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.integers(0, 8)):
            w[rng.integers(len(w))] = f"v{rng.integers(400)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"x{rng.integers(50)}" for _ in range(40)) for _ in range(60)]
    _, root = classes(texts, range(len(texts)), 4, 80)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(texts), shingle=4).collect()}
    assert got == root
    assert len(set(root.values())) > 60


def test_near_duplicates_repeated_and_null_ids(docs_of):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "k l m n o i j z")
    ids, texts = [5, 5, 3, 9, 9, None, 2], [a, b, b, a, a, a, c]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs_of(texts, ids)).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (9, 3, False), (9, 3, False), (None, None, True), (2, 2, True)], key=str)


# repeated passages
def removed(texts, ids, window):
    seen, out = set(), {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("window", "anchor"), [(20, 8), (20, 20), (5, 2), (1, 1), (50, 8)])
def test_repeats(docs_of, corpus, window, anchor):
    docs = docs_of(corpus)
    spans = repeats.repeats(docs, window=window, anchor=anchor)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.kept_words(docs, spans).collect()}
    want = removed(corpus, range(len(corpus)), window)
    assert {i: v[:3] for i, v in want.items()} == got
    for r in spans.collect():
        assert all(a < b for a, b in zip(r.starts, r.ends, strict=True))
        assert all(b < c for b, c in zip(r.ends, r.starts[1:], strict=False))


def test_repeats_frequent_passages(docs_of):
    """Enough documents for anchors to count as frequent: they go by whole windows."""
    passage = " ".join(f"w{i}" for i in range(45))
    texts = [f"x{i} y{i} {passage} {'z ' * (i % 3)}" for i in range(60)] + [passage] * 30
    assert len(repeats._frequent(docs_of(texts).selectExpr("doc_id as id", "text"), 20, 8)) > 0
    got = {r.doc_id: r.n_removed for r in repeats.kept_words(docs_of(texts), repeats.repeats(docs_of(texts))).collect()}
    assert got == {i: v[1] for i, v in removed(texts, range(len(texts)), 20).items()}


def test_repeats_of_one_word(docs_of):
    rng = np.random.default_rng(10)
    texts = ["na " * int(n) + f"x{i} " * 3 + "na " * int(rng.integers(10, 60)) for i, n in enumerate(rng.integers(1, 300, 40))] + ["ha na " * 50] * 3
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats.kept_words(docs_of(texts), repeats.repeats(docs_of(texts))).collect()}
    assert got == {i: v[1:3] for i, v in removed(texts, range(len(texts)), 20).items()}


def test_remove_repeats(docs_of, corpus):
    docs = docs_of(corpus)
    out = repeats.remove(docs, window=20)
    assert out.columns == docs.columns
    want = removed(corpus, range(len(corpus)), 20)
    for r in out.collect():
        assert " ".join(SPACED.findall(r.text or "")) == want[r.doc_id][3]
        if want[r.doc_id][1]:
            assert r.n_chars == len(r.text)
        else:
            assert r.text == corpus[r.doc_id]


def test_repeats_repeated_and_null_ids(docs_of):
    p = " ".join(f"w{i}" for i in range(30))
    ids, texts = [1, 1, 2, 2, 3, None], [p, p, p, "other " + p, p, p]
    got = {(r.doc_id, r.n_words): r.n_removed for r in repeats.kept_words(docs_of(texts, ids), repeats.repeats(docs_of(texts, ids))).collect()}
    assert got == {(1, 30): 0, (2, 30): 0, (2, 31): 0, (3, 30): 30, (None, 30): 0}


# decontamination
def hits(text, items, window):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, names = [False] * len(w), set()
    for name, item in items:
        iw = ALNUM.findall((item or "").translate(LOWER))
        k = min(window, len(iw))
        for p in range(len(iw) - k + 1 if k else 0):
            for s in range(len(w) - k + 1):
                if w[s : s + k] == iw[p : p + k]:
                    hit[s : s + k] = [True] * k
                    names.add(name)
    return w, hit, names


def test_contamination(spark, docs_of, corpus):
    texts = corpus[:60] + ["", None]
    items = [(str(i), " ".join((corpus[i] or "").split()[2:16])) for i in (0, 3, 5, 8, 13, 21)] + [("100", "One, TWO three!"), ("7", corpus[4]), ("8", None), ("9", "?!"), (None, "never seen here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(texts), bench).collect()}
    cut = {r.doc_id: r for r in decontaminate.remove(docs_of(texts), bench).collect()}
    named = [(n or "", t) for n, t in items]
    for i, t in enumerate(texts):
        w, hit, names = hits(t, named, 10)
        assert got[i].n_words == len(w)
        marked = [False] * len(w)
        for s in got[i].spans:
            marked[s.start : s.end] = [True] * (s.end - s.start)
        assert marked == hit
        assert list(got[i]["items"]) == sorted(names)
        assert ALNUM.findall((cut[i].text or "").translate(LOWER)) == [x for x, h in zip(w, hit, strict=True) if not h]
        assert cut[i].text == t or cut[i].n_chars == len(cut[i].text)


def test_contamination_without_items(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.contamination(docs_of(["a b", None]), none).orderBy("doc_id").collect()
    assert [(x.n_words, list(x.spans), list(x["items"])) for x in r] == [(2, [], []), (0, [], [])]
    assert decontaminate.remove(docs_of(["a b"]), none).first().text == "a b"


# toxicity
@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    bad = ["vile", "grimform", "grimstuff", "nasty", "grimness"]
    rows = []
    for i in range(900):
        w = list(rng.choice(vocabulary, rng.integers(5, 60)))
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            w[rng.integers(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w) if i % 301 else None, ["en", "fr", None][i % 3], toxic if i % 301 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return docs.drop("toxic"), docs.select("doc_id", "toxic")


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scored = toxicity.score_documents(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    got = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(got) == 900
    assert all(0 <= s <= 1 for _, s in got)
    out = [(truth[i], s >= 0.7) for i, s in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 200
    assert np.mean([t == p for t, p in out]) > 0.95
    again = dict((r.doc_id, r.score) for r in toxicity.score_documents(docs.repartition(7), toxicity.train(docs, labels)).collect())
    assert again == pytest.approx(dict(got), abs=1e-5)
    assert set(model.thresholds) <= {"", "en", "fr"}
    assert scored.where(toxicity.over_threshold(model, scored["lang"], scored["score"])).count() > 100


def test_toxicity_without_labels(labelled, docs_of):
    docs, labels = labelled
    model = toxicity.train(docs, labels.where("false"))
    assert len({r.score for r in toxicity.score_documents(docs_of(["a", "", None]), model).collect()}) == 1
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score_documents(docs_of(["a vile b", ""]), one).collect()) < 0.7


# packing
def test_pack(docs_of, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(corpus), path, capacity=200, with_ids=True).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(corpus):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert [r.start for r in got] == list(range(0, len(ids), 200))
        assert np.frombuffer(b"".join(r.ids for r in got), dtype="<u4").tolist() == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in got)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 200
    counts = collections.Counter(r.length for r in rows)
    assert packing.lower_bound(counts, 200) <= len(sequences) <= packing.lower_bound(counts, 200) + 1


# token counts
def test_token_counts(docs_of, corpus, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = f"file://{tmp_path}/cache"
    want = sorted((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(corpus))
    first = token_counts.count_tokens(docs_of(corpus[:50]), path, cache)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in first.collect()) == want[:50]
    spark = first.sparkSession
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for t in corpus[:50]})
    again = token_counts.count_tokens(docs_of(corpus), path, cache)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in again.collect()) == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in corpus})
    other = token_counts.count_tokens(docs_of(corpus[:5]), public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert other.count() == 5
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


# quality
def measures(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs_of, corpus):
    texts = corpus + ["a a a a a", "a b c a b c", "## | x\n\n## | x\n y", "\x0b\x0c\r", "x\u00a0y 😀 z"]
    docs = docs_of(texts)
    judged = quality.cascade(docs, quality.default_rules(), prepare=quality.measure)
    for r in judged.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])
        assert r.kept == (r.rejected_by is None)
    assert quality.cascade(docs, [], prepare=quality.measure).where("kept").count() == len(texts)
    assert quality.cascade(docs.where("false"), quality.default_rules(), prepare=quality.measure).count() == 0


def test_cascade_order_changes_no_verdict(docs_of, corpus):
    rules = quality.default_rules()
    a = quality.cascade(docs_of(corpus), rules, prepare=quality.measure)
    b = quality.cascade(docs_of(corpus), rules[::-1], prepare=quality.measure)
    assert {r.doc_id: r.kept for r in a.collect()} == {r.doc_id: r.kept for r in b.collect()}


# archives
def test_warc_round_trip(spark, tmp_path):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    pages = [(1, "http://a.b/c?d#e", long), (2, None, long), (3, "http://a.b", long), (3, "http://a.b", long), (4, "u", None), (5, "u", ""), (6, "x\r\ny", "short"), (7, "x", "short"), (None, "n", long), (8, "http://h", "z" * 1000), (None, "q", "y" * 1001), (None, "q", "y" * 1001)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = warc.assemble(warc.read_archives(spark, path, with_payload=True)).collect()
    assert sum(r.copies for r in got) == len(pages)
    payloads = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages}
    ids = {r.capture_id: r for r in got}
    kinds = collections.Counter()
    for r in got:
        page = None if r.metadata.page is None else int(r.metadata.page)
        kinds[page, r.response.record_type] += r.copies
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
        body = payloads[r.response.payload_digest]
        assert r.response.payload_bytes == len(body)
        if r.response.record_type == "response":
            assert r.response.payload == body
        else:
            assert ids[r.response.refers_to].metadata.page == "3"
    assert kinds == {(1, "revisit"): 1, (2, "revisit"): 1, (3, "response"): 2, (4, "response"): 1, (5, "response"): 1, (6, "response"): 1, (7, "response"): 1, (None, "revisit"): 1, (8, "response"): 1, (None, "response"): 2}


def test_assemble_follows_both_directions(spark):
    rows = [("r1", "response", "q1", None), ("q1", "request", None, None), ("m1", "metadata", "q1", None), ("r2", "response", None, None), ("q2", "request", "r2", None), ("q3", "request", "nowhere", None), ("i", "warcinfo", None, None)]
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], warc.RECORD.replace("refers_to string", "refers_to string"))
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(df).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None)}


def test_warc_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0


# addresses
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_url_rules(spark):
    urls = {"http://A.Example.COM/en/71?q": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "https://example.com/en/8#x": ("example.com", "/en/8", "com/en/", "block"), "x://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"), "http://n.example.net/de/80": ("n.example.net", "/de/80", "example.net/de/8", "block"), "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://com/en": ("com", "/en", None, "allow"), "http://y.org?es=/es/": ("y.org", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow")}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, *urls])], "page_id long, url string, html string")
    got = url_rules.judge(df, RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id % len(urls)]


def test_url_aliases(spark):
    link = '<html><LINK href="{}" rel=canonical>'
    refresh = '<meta content="0; URL={}" http-equiv="refresh">'
    pages = [
        (1, "http://a.xyz/1", link.format("http://s.com/en/9")),  # alias of a blocked address that is no page
        (2, "http://a.xyz/2", refresh.format("/1")),  # and of that one
        (3, "http://b.xyz/1", link.format("http://s.com/en/2")),
        (4, "http://b.xyz/2#top", refresh.format("http://example.com/en/7")),  # an allow and a block in one group
        (5, "HTTP://B.xyz/2", link.format("http://b.xyz/1")),
        (6, "http://example.com/en/7", ""),
        (7, "http://s.com/en/2", ""),  # its own rule goes first
        (8, "http://c.xyz/", '<a href="http://s.com/en/9">'),
        (9, "http://d.xyz/x/y", link.format("z?a=1&amp;b=2")),
        (10, "http://d.xyz/x/z?a=1&b=2", link.format("//t.org/es/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_rules.judge(df, RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "block"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (None, 5), (200, 100), (300, 301)] + [(500, 500 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 200: 100, 300: 300, 301: 300, **{500 + i: 500 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# licenses
def test_licenses(docs_of):
    filler = " ".join(f"w{i}" for i in range(300))
    apache = licenses.TEMPLATES[1][1]
    mit = re.findall(r"\S+", licenses.TEMPLATES[3][1])
    changed = " ".join("XX" if i == 25 else w for i, w in enumerate(mit))
    texts = [f"{filler} released UNDER the\nMIT license! {filler}", filler, f"{filler} {apache} {filler}", f"{filler} {changed} {filler}", "All rights reserved", "all rights, reserved. all rights", "rights reserved", "", None, f"{filler} {' '.join(mit[:20])}"]
    got = {(r.doc_id, r.license): (r.containment, r.n_templates) for r in licenses.scan(docs_of(texts)).collect()}
    assert got.pop((3, "MIT"))[0] >= 80
    assert got == {(0, "MIT"): (100.0, 1), (2, "Apache-2.0"): (100.0, 2) if (2, "Apache-2.0") in got and got[2, "Apache-2.0"][1] == 2 else (100.0, 1), (4, "all-rights-reserved"): (100.0, 1), (5, "all-rights-reserved"): (100.0, 1)}
    assert licenses.scan(docs_of(["x"]).where("false")).count() == 0


@pytest.mark.parametrize(
    "run",
    [
        lambda d, spark: near_dups.near_duplicates(d),
        lambda d, spark: near_dups.drop_near_duplicates(d),
        lambda d, spark: repeats.kept_words(d, repeats.repeats(d)),
        lambda d, spark: repeats.remove(d),
        lambda d, spark: decontaminate.contamination(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda d, spark: decontaminate.remove(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda d, spark: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
        lambda d, spark: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    ],
)
def test_empty_tables_and_no_words(docs_of, spark, run):
    assert run(docs_of(["x"]).where("false"), spark).count() == 0
    assert run(docs_of([None, "", " \n"]), spark).count() == 3
