"""Suffix trees and prefixes of several lengths, against brute force."""

import numpy as np
import pytest

from panelwright.llm import repeats
from tests.llm.test_operators import removed


def test_tree_against_all_pairs():
    rng = np.random.default_rng(21)
    for _ in range(20):
        sizes = rng.integers(1, 14, 12)
        text, places = [], []
        for i, n in enumerate(sizes):
            places += range(len(text), len(text) + n)
            text += [*rng.integers(0, 2, n), 100 + i]
        text = np.array(text)
        tree = repeats.SuffixTree(text, np.array(places), int(sizes.max()))

        def common(a, b):
            n = 0
            while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n

        assert tree.lcp.tolist() == [common(a, b) for a, b in zip(tree.places[:-1], tree.places[1:], strict=True)]
        for depth in (1, 2, 4, 7):
            first, deep = tree.nodes(depth)
            got = {frozenset(x.tolist()): d for x, d in zip(np.split(tree.places, first[1:]), deep.tolist(), strict=True) if len(x) > 1}
            want = {}
            for a in places:
                mine = frozenset(b for b in places if b == a or common(a, b) >= depth)
                if len(mine) > 1:
                    want[mine] = min(common(x, y) for x in mine for y in mine if x != y)
            assert got == want


def texts_of(seed):
    """Passages in many documents, whole, cut short, and with a word changed; repeated words; copies."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(150):
        p = list(passage[rng.integers(0, 12) : 60 - rng.integers(0, 12)])
        if i % 3 == 0:
            p[rng.integers(len(p))] = f"q{rng.integers(3)}"
        out.append(" ".join([f"a{rng.integers(9)}" for _ in range(rng.integers(0, 15))] + p + [f"b{rng.integers(9)}" for _ in range(rng.integers(0, 15))]))
    return out + ["na " * int(n) for n in rng.integers(1, 90, 20)] + [out[4]] * 20


@pytest.mark.parametrize(("window", "anchor"), [(20, 8), (13, 5), (20, 20), (4, 1)])
@pytest.mark.parametrize(("most", "held"), [(8, 300_000), (40, 100), (1, 300_000)])
def test_prefixes_of_all_lengths(docs_of, monkeypatch, window, anchor, most, held):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    monkeypatch.setattr(repeats, "HELD", held)
    texts = texts_of(window)
    source = docs_of(texts).selectExpr("doc_id as doc", "text")
    crowded = repeats._crowded(source, window, anchor, most)
    if anchor < window:
        assert len(crowded[0]) > 0
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats.kept_words(docs_of(texts), repeats.repeats(docs_of(texts), window=window, anchor=anchor)).collect()}
    assert got == {i: v[1:3] for i, v in removed(texts, range(len(texts)), window).items()}


def test_each_text_of_an_id(spark, docs_of):
    """Several texts of an id are documents of their own; the smaller hash comes first."""
    p = " ".join(f"w{i}" for i in range(30))
    ids, texts = [1, 1, 2, 2, 3, None, -4, -4], [p, p, p, "other " + p, p, p, "x y", "x z"]
    docs = docs_of(texts, ids)
    spans = repeats.repeats(docs, each_text=True)
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in repeats.kept_words(docs, spans).collect())
    assert got == [(-4, 2, 0), (-4, 2, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (2, 31, 30), (3, 30, 30), (99, 30, 0)]
    left = sorted((r.doc_id if r.doc_id is not None else 99, r.text) for r in repeats.remove(docs).collect())
    assert left == sorted([(-4, "x y"), (-4, "x z"), (1, p), (1, p), (2, ""), (2, "other "), (3, ""), (99, p)])
    with pytest.raises(ValueError):
        repeats.repeats(docs_of([p, "a", "b"], [2**62, 5, 5]), each_text=True)


def test_names_that_clash(docs_of):
    p = " ".join(f"w{i}" for i in range(30))
    docs = docs_of([p, p + " z"])
    for name in ("starts", "ends", "changed", "key", "of", "_starts", "_ends", "_changed", "doc", "records", "text_hash"):
        docs = docs.selectExpr("*", f"doc_id * 7 as {name}")
    out = repeats.remove(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.starts, r.changed, r.text_hash) for r in out.collect()} == {(0, p, 0, 0, 0), (1, "z", 7, 7, 7)}


def test_ids_that_are_no_numbers(docs_of):
    with pytest.raises(TypeError, match="doc_id"):
        repeats.repeats(docs_of(["a"]).selectExpr("cast(doc_id as string) as doc_id", "text"))
