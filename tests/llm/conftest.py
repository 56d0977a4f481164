import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with the columns of documents and others whose names operators use within."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, digest string").repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies, shared passages, short and empty ones, odd white space and a null."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "Di", "fo", "gÜ", "ha", "jé", "ko") for b in ("la", "ne", "ri", "so", "tu", "", ",", ".")]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))

    texts = [text(rng.randint(30, 160)) for _ in range(40)]
    passage, short_passage = text(60), text(21)
    for i in range(24):
        texts.append(text(rng.randint(1, 40)) + passage + text(rng.randint(1, 40)))
    for i in range(20):
        texts.append(text(rng.randint(1, 30)) + short_passage + text(25))
    texts += [texts[0]] * 5 + [texts[3] + " tail"] * 2
    for i in range(30):
        w = texts[1].split(" ")
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += ["", None, " \n", "one", "one two three", "ONE two three", "one  two\nthree", text(30) + "<|endoftext|> it's <s>" + text(5), (text(30) + " ") * 3, text(4000)]
    rng.shuffle(texts)
    return texts
