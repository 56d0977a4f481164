"""Extra columns whose names operators might use, ids that are no numbers, other tokenizers, and very long texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from panelwright.llm import decontaminate, near_dups, packing, quality, store, toxicity

NAMES = ["_score", "score", "_changed", "changed", "starts", "ends", "key", "of", "label", "rep", "bucket", "tree", "sequence_id"]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(docs_of):
    p = " ".join(f"w{i}" for i in range(70))
    docs = docs_of([p + " one", p + " two three four five six seven " * 9, p, None, "", p])
    return docs.selectExpr("*", *[f"doc_id + {i} as {n}" for i, n in enumerate(NAMES)])


def test_free_names():
    assert store.free_names(["A", "b_", "b"], "a", "b", "c") == ["a_", "b__", "c"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_other_columns(spark, odd, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd, DIR)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert [r[n] for n in NAMES] == [r.doc_id + i for i in range(len(NAMES))]
    assert {3, 4} <= {r.doc_id for r in rows}


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), DIR).count() == 0


def test_ids_that_are_no_numbers(docs_of):
    with pytest.raises(TypeError, match="doc_id"):
        near_dups.near_duplicates(docs_of(["a"]).selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_a_benchmark_that_makes_too_much(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BUILT_BYTES", 100)
    with pytest.raises(ValueError, match="in parts"):
        decontaminate.contamination(docs_of(["a"]), spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string"))


@pytest.mark.parametrize(("name", "by_piece"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_of_any_tokenizer(corpus, name, by_piece):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, ours = Tokenizer.from_file(path), packing.Encoder(path)
    assert ours.by_piece == by_piece
    ids, ptr = ours(pa.array(corpus[:60]))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in corpus[:60]]
    assert [x.tolist() for x in ours(pa.array([], type=pa.string()))] == [[], [0]]


def test_very_long_texts(spark, docs_of):
    rng = np.random.default_rng(40)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 300_000))
    docs = docs_of([long, "a b c", long + " z"])
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    bench = spark.createDataFrame([(1, " ".join(long.split(" ")[150_000:150_012]))], "item_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.contamination(docs, bench).collect()}
    assert spans == {0: [(150_000, 150_012)], 1: [], 2: [(150_000, 150_012)]}
    assert {r.doc_id: r.n_words for r in quality.measure(docs).collect()} == {0: 300_000, 1: 3, 2: 300_001}


def test_score_against_a_plain_loop(corpus):
    """The convolution, its pooling and the logistic unit, word by word."""
    rng = np.random.default_rng(41)
    texts = pa.array(corpus[:40])
    hashes, ptr = toxicity.features(texts)
    keys = np.unique(hashes)[::2]
    vectors = rng.standard_normal((len(keys) + 1, 5)).astype(np.float32)
    filters = [rng.standard_normal((w, 5, 3)).astype(np.float32) for w in (1, 2, 4)]
    m = toxicity.Model(keys, vectors, filters, [rng.standard_normal(3).astype(np.float32) for _ in filters], rng.standard_normal(9).astype(np.float32), 0.3)
    find = toxicity._Lookup(keys)
    at = find(hashes)
    assert ((at > 0) <= np.isin(hashes, keys)).all()
    got = toxicity.score(m, find, texts)
    for d in range(len(texts)):
        x = [sum(vectors[at[k, i]].astype(float) for k in range(len(hashes))) / len(hashes) for i in range(ptr[d], ptr[d + 1])]
        z, n = m.out_bias, 0
        for f, b in zip(m.filters, m.biases, strict=True):
            for e in range(3):
                best = max((b[e] + sum(float(x[i + k] @ f[k, :, e]) for k in range(len(f)) if i + k < len(x)) for i in range(len(x))), default=0.0)
                z += max(best, 0.0) * m.out[n]
                n += 1
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)
