import numpy as np
import pytest

from panelwright.llm import toxicity


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(300):
        w = list(rng.choice([f"w{j}" for j in range(80)], rng.integers(5, 40)))
        toxic = i % 3 == 0
        if toxic:
            w[rng.integers(len(w))] = "vile"
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_a_long_text_does_not_end_the_training_set(spark, rows):
    docs = spark.createDataFrame([(-1, " " * 15_000_000 + "w1 w2", 0), *rows], "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    held = docs.where(toxicity.held_out(docs["doc_id"]) & (docs["doc_id"] >= 0))
    got = toxicity.score_documents(held, model).collect()
    assert len(got) > 50
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in got]) > 0.95


def test_texts_in_pieces_give_the_same_model(rows, monkeypatch):
    texts, labels = [text.encode() for _, text, _ in rows] + [b"", b" "], np.array([y for _, _, y in rows] + [0, 0])
    whole = toxicity.fit(texts, labels, ["en"] * len(texts))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 20)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 5)
    cut = toxicity.fit(texts, labels, ["en"] * len(texts))
    assert (whole.keys == cut.keys).all() and whole.thresholds.keys() == cut.thresholds.keys() == {"en"}
    np.testing.assert_allclose(whole.vectors, cut.vectors, atol=1e-4)
    np.testing.assert_allclose(whole.out, cut.out, atol=1e-4)


def test_a_small_part_of_many_labels_is_sampled(spark, monkeypatch):
    many = spark.range(10_000_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, langs: len(labels))
    docs = many.selectExpr("doc_id", "'a' as text")
    assert 1 <= toxicity.train(docs, many, lang_col=None, rows=5) <= 15
