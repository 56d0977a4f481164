import numpy as np
import pytest

from panelwright.llm import near_dups


@pytest.mark.parametrize("similarity", [50, 60, 70])
def test_pairs_at_a_lower_similarity_are_found(docs_of, similarity):
    """Pairs of sets of single words that share just the part asked for."""
    both = 2 * similarity  # words that the two share; 200 - both are in one of them
    texts = []
    for i in range(80):
        w = [f"p{i}w{j}" for j in range(200)]
        texts += [" ".join(w[: both + (200 - both) // 2]), " ".join(w[:both] + w[both + (200 - both) // 2 :])]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(texts), shingle=1, similarity=similarity).collect()}
    assert got == {i: i - i % 2 for i in range(160)}


def test_tables_follow_the_similarity():
    assert near_dups.tables_for(near_dups.SIMILARITY) == near_dups.Tables(12, 3, 40)
    for similarity in np.arange(20, 101):
        t, s = near_dups.tables_for(similarity), similarity / 100
        assert 2 * t.bands * t.rows == near_dups.N
        assert (1 - (1 - s**t.rows) ** t.bands) ** 2 >= 0.999
    with pytest.raises(ValueError, match="similarity"):
        near_dups.tables_for(10)
