"""The order of a cascade, and what goes into a rule's cost."""

import pytest
from pyspark.sql import functions as F

from panelwright.llm import quality
from tests.llm.test_operators import measures


def test_order_is_by_rejection_per_cost(spark):
    rule = lambda name: quality.Rule(name, F.lit(False))
    given = [quality.Estimate(rule(n), c, s) for n, c, s in (("dear", 10.0, 0.5), ("idle", 0.1, 0.0), ("cheap", 0.1, 0.1), ("same", 0.1, 0.1), ("best", 1.0, 0.9), ("dear idle", 10.0, 0.0))]
    assert [e.rule.name for e in quality.order(given)] == ["cheap", "same", "best", "dear", "idle", "dear idle"]


def test_inputs_are_part_of_the_cost(docs_of):
    """A comparison is cheap; the repeated words that one rule compares are not, so it goes last."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(800)) + "#" * (200 if i % 2 else 0) for i in range(200)]
    rules = [quality.Rule("repeated", F.col("n_repeat_words") > 10**9, ("n_repeat_words",)), quality.Rule("symbols", F.col("n_symbols") > 100, ("n_symbols",))]
    got = {e.rule.name: e for e in quality.estimate(docs_of(texts), rules)}
    assert got["repeated"].cost > 2 * got["symbols"].cost
    assert got["symbols"].selectivity == pytest.approx(0.5)
    judged = quality.cascade(docs_of(texts), rules)
    told = judged.schema["rejected_by"].metadata["order"]
    assert [x["rule"] for x in told] == ["symbols", "repeated"]
    assert judged.where("rejected_by = 'symbols'").count() == 100
    assert judged.where("kept").count() == 100


def test_a_given_order_is_kept(docs_of):
    rules = quality.default_rules()
    ranked = [quality.Estimate(r, 1.0 + i, 0.5) for i, r in enumerate(rules[::-1])]
    judged = quality.cascade(docs_of(["a b c", None, "x " * 60]), rules, ranked=ranked)
    assert [x["rule"] for x in judged.schema["rejected_by"].metadata["order"]] == [r.name for r in rules[::-1]]
    assert {r.doc_id: r.rejected_by for r in judged.collect()} == {0: "short_words", 1: "few_words", 2: "short_words"}


def test_names_that_clash_and_long_texts(docs_of):
    texts = ["a\nb\na", "x y z " * 100_000, None, ""]
    docs = docs_of(texts).selectExpr("*", "doc_id as words", "doc_id as lines", "doc_id as _words", "1 as n_words", "doc_id as words_")
    got = quality.cascade(docs, quality.default_rules(), prepare=quality.measure).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])
        assert r.words == r.lines == r._words == r.words_ == r.doc_id
