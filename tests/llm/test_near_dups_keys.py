"""Sets that meet under one key and are not alike."""

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import near_dups


@pytest.fixture(scope="module")
def winners():
    """A vocabulary, and for each minhash the word of it that wins over all others."""
    vocabulary = [f"w{i}" for i in range(20_000)]
    whole = near_dups.sketch(*near_dups.shingle_sets(pa.array([" ".join(vocabulary)]), 1))[0]
    each = near_dups.sketch(*near_dups.shingle_sets(pa.array(vocabulary), 1))
    return np.array(vocabulary), (each == whole).argmax(axis=0)


@pytest.mark.parametrize("n", [65, 600, 2500])
@pytest.mark.parametrize("minhashes", [[0, 1, 2], [0, 1, 2, 36, 37, 38]], ids=["key", "pair of keys"])
def test_unlike_sets_under_one_key(docs_of, winners, n, minhashes):
    """They share a key of U, or of U and V, and nothing else: no links, whatever way they meet; the last two are alike."""
    vocabulary, best = winners
    rng = np.random.default_rng(12)
    rest = np.delete(vocabulary, best)
    texts = [" ".join([*vocabulary[best[minhashes]], *rng.choice(rest, 40, replace=False)]) for _ in range(n)]
    texts.append(texts[-1] + " one more")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(texts), shingle=1).collect()}
    assert got == {i: min(i, n - 1) for i in range(n + 1)}


@pytest.mark.parametrize(("least", "meet", "block"), [(2, 4, 512), (2, 4, 3), (10_000, 10_000, 3)])
def test_families_of_several_classes(docs_of, monkeypatch, least, meet, block):
    """Texts that drift word by word, so that links chain and a centre is like some of its family only."""
    from tests.llm.test_operators import classes

    for name, value in (("FREQUENT_LEAST", least), ("MEET", meet), ("BLOCK", block)):
        monkeypatch.setattr(near_dups, name, value)
    rng = np.random.default_rng(30 + block)
    texts = []
    for family in range(3):
        w = [f"f{family}w{i}" for i in range(60)]
        for n in range(40):
            for _ in range(rng.integers(1, 6)):
                w[rng.integers(len(w))] = f"v{rng.integers(1000)}"
            texts.append(" ".join(w))
            if n % 20 == 19:
                w = [f"f{family}w{i}" for i in range(60)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    _, root = classes(texts, range(len(texts)), 2, 80)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(texts), shingle=2).collect()}
    assert 3 < len(set(root.values())) < 100
    assert got == root
