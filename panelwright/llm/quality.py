"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

SAMPLE_ROWS = 2000  # rows, about, on which cost and selectivity of the rules are estimated
REPEATS = 3  # timed runs of each rule
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject: a boolean column that is true for a document to be dropped; null counts as false.

    needs: names of the measures that reject reads; what they cost is the rule's cost too.
    """

    name: str
    reject: Column
    needs: tuple[str, ...] = ()


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), "")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first included.

    Windows are sorted by a 64-bit hash and position; those that meet an equal
    hash beside them are compared word by word.  The words are bound once, so
    that a filter which is pushed below them does not split the text again for
    each window.
    """

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
        grams = F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))

        def repeated(s: Column) -> Column:
            def twin(x: Column, y: Column) -> Column:
                p, q = x["p"], y["p"]
                same = (x["h"] == y["h"]) & (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
                return F.coalesce(same, F.lit(False))

            return F.transform(F.filter(s, lambda x, j: twin(x, F.get(s, j - 1)) | twin(x, F.get(s, j + 1))), lambda x: x["p"])

        positions = F.sort_array(_let(grams, repeated))
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        covered = F.aggregate(positions, begin, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"]).cast("long")).alias("total")), lambda a: a["total"])
        return F.when(F.size(w) >= 3, covered).otherwise(F.lit(0).cast("long"))

    return _let(words, of)


#: What each measure is made from; _words and _lines are arrays.
PARTS = {"n_words": ("words",), "word_chars": (), "n_symbols": (), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("words", "n_words")}


def measure(docs: DataFrame, text_col: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long; only some of them if asked.

    Null and empty texts have no words and no lines with a word.  Repeated rows
    each get their own measures.  Columns of these names are replaced, all
    others stay, whatever their names.
    """
    wanted = tuple(PARTS) if only is None else tuple(n for n in PARTS if n in only or any(n in PARTS[m] for m in only))
    words, lines = store.free_names([*docs.columns, *PARTS], "words", "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = lambda x: F.char_length(x).cast("long")
    made = {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: length(F.translate(text, BLANKS, "")),
        "n_symbols": lambda: length(text) - length(F.translate(text, SYMBOLS, "")),
        "n_lines": lambda: F.size(lines).cast("long"),
        "n_dup_lines": lambda: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    arrays = {words: words_of(F.col(text_col)), lines: F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")}
    arrays = {n: c for n, c in arrays.items() if any((n.rstrip("_")) in PARTS[m] for m in wanted)}
    out = docs.withColumns(arrays) if arrays else docs
    if some := {n: make() for n, make in made.items() if n in wanted}:
        out = out.withColumns(some)
    if "n_repeat_words" in wanted:
        out = out.withColumn("n_repeat_words", repeat_words(F.col(words)))
    return out.drop(*arrays)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def base_rules() -> list[Rule]:
    """The two rules that base_failed() joins."""
    return [
        Rule("few_words", F.col("n_words") < 50, ("n_words",)),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_words", "n_repeat_words")),
    ]


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over the columns of measure() and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]", ""))
    bangs = F.char_length(text) - F.char_length(F.translate(text, "!", ""))
    return [
        *base_rules(),
        Rule("symbols", 100 * F.col("n_symbols") > 10 * F.col("n_words"), ("n_symbols", "n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words"), ("word_chars", "n_words")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words"), ("word_chars", "n_words")),
        Rule("exclamations", 100 * bangs > 30 * F.col("n_words"), ("n_words",)),
        Rule("capitals", 100 * upper > 40 * F.col("word_chars"), ("word_chars",)),
    ]


@dataclass(frozen=True)
class Estimate:
    """Of a rule, on the sample: seconds with its inputs above those of reading the text, and the part of rows rejected."""

    rule: Rule
    cost: float
    selectivity: float

    @property
    def worth(self) -> float:
        return self.selectivity / self.cost


def estimate(docs: DataFrame, rules: list[Rule], prepare=None, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[Estimate]:
    """An estimate of each rule: the median of several timed runs over a sample of about sample_rows rows.

    A run works out the measures that the rule needs from the text, and then the
    rule; what a run takes that does neither is subtracted.  prepare, where
    given, makes the columns that rules read in place of measure().
    """
    total = docs.count()
    if not total or not rules:
        return [Estimate(r, 1.0, 0.0) for r in rules]
    sample = docs.sample(fraction=min(1.0, sample_rows / total), seed=11).cache()

    def run(rule: Rule | None) -> float:
        rows = sample if rule is None else prepare(sample) if prepare else measure(sample, text_col, rule.needs)
        # without a rule the text is read, no more
        reject = F.octet_length(F.col(text_col)) < 0 if rule is None else rule.reject
        return rows.agg(F.avg(F.coalesce(reject, F.lit(False)).cast("double"))).first()[0] or 0.0

    def timed(rule: Rule | None) -> float:
        began = time.perf_counter()
        run(rule)
        return time.perf_counter() - began

    try:
        parts = [run(r) for r in (None, *rules)]  # also compiles the plans and fills the cache
        seconds = [median(timed(r) for _ in range(repeats)) for r in (None, *rules)]
        return [Estimate(r, max(s - seconds[0], 1e-3), p) for r, s, p in zip(rules, seconds[1:], parts[1:], strict=True)]
    finally:
        sample.unpersist()


def order(estimates: list[Estimate]) -> list[Estimate]:
    """By rejection per cost, the most first; of equal ones the cheaper, then by name."""
    return sorted(estimates, key=lambda e: (-e.worth, e.cost, e.rule.name))


def cascade(docs: DataFrame, rules: list[Rule], *, prepare=None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, ranked: list[Estimate] | None = None) -> DataFrame:
    """docs, with the columns that rules read, and rejected_by (name of the first rule that rejects, else null) and kept.

    Rules run in order of rejection per cost, as estimated on a sample of about
    sample_rows rows (or as ranked, from an earlier estimate); a CASE stops at the
    first that rejects, and what only later rules need is not worked out for the
    row.  The order decides which rule is named and how long it takes, never what
    is kept; it is kept in the metadata of the column rejected_by, each rule with
    its cost and selectivity.

    prepare, where given, adds the columns that rules read, such as those of
    measure().  Without rules everything is kept.  Null and empty texts are
    judged as texts without words; repeated rows each get their verdict; an
    empty table gives no rows.  Columns named rejected_by and kept are replaced.
    """
    ranked = order(estimate(docs, rules, prepare, text_col=text_col, sample_rows=sample_rows) if ranked is None else ranked)
    chain = None
    for e in ranked:
        chain = F.when(e.rule.reject, e.rule.name) if chain is None else chain.when(e.rule.reject, e.rule.name)
    first = F.lit(None).cast("string") if chain is None else chain.otherwise(F.lit(None).cast("string"))
    needs = tuple(n for n in PARTS if any(n in r.needs for r in rules))
    rows = prepare(docs) if prepare else measure(docs, text_col, needs) if needs else docs
    told = {"order": [{"rule": e.rule.name, "cost": e.cost, "selectivity": e.selectivity} for e in ranked]}
    rows = rows.withColumn("rejected_by", first).withMetadata("rejected_by", told)
    return rows.withColumn("kept", F.col("rejected_by").isNull())
