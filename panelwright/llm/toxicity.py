"""A convolutional text classifier for toxicity, trained and run in numpy.

A word is the sum of embeddings found by hash: of the word and of its beginnings
of several lengths, which carry over to inflected and compound forms.  Filters of several widths run
over the words, each filter's largest response is kept, and a logistic unit
reads those.  Embeddings begin with how far the labels of a word's texts are
from the rate, all else at random.  Only the text goes into a score; the language is used after that,
to choose the threshold.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, words

TRAIN_ROWS = 4000  # labelled rows, at most about, that the classifier is fitted on
PIECE_BYTES = 1 << 20  # of text whose words' hashes are held at once in training, about; longer texts are cut at a space
PIECE_WORDS = 1 << 16  # words whose responses are held at once in training
PREFIXES = (4, 5, 6, 7)  # bytes of a word that have an embedding of their own
SLOTS = 1 << 22


@dataclass
class Model:
    keys: np.ndarray  # hashes that have an embedding; row i + 1 of vectors is of keys[i], row 0 of all others
    vectors: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, size, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.7


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and its beginnings, a row for each kind, the word's again where it is no longer than that; and the word at which each text begins."""
    w = words.split(texts, words.ALNUM, lower=True)
    out = np.tile(w.hashes(), (1 + len(PREFIXES), 1))
    for i, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(w.ends - w.starts > n)
        out[i, long] = words.mix(words.Words(w.data, w.starts[long], w.starts[long] + n, w.ptr, w.offsets).hashes() + np.uint64(n))
    return out, w.ptr


def _padded(ptr: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words go if each text has pad blanks after it: each word's place, each text's first place, blanks."""
    n = np.diff(ptr)
    first = ptr[:-1] + pad * np.arange(len(n))
    place = np.arange(int(ptr[-1])) + pad * np.repeat(np.arange(len(n)), n)
    blank = np.ones(int(ptr[-1]) + pad * len(n), dtype=bool)
    blank[place] = False
    return place, first, blank


class _Lookup:
    """Rows of hashes: a table of the low bits, then a comparison of the whole hash."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, dtype=np.uint64), keys])
        self.table = np.zeros(SLOTS, dtype=np.int32)
        self.table[(keys & np.uint64(SLOTS - 1)).astype(np.int64)] = np.arange(1, len(keys) + 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.table[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where(self.keys[rows] == hashes, rows, 0)


class _Texts:
    """Texts in a scratch file, read one at a time and any number of times."""

    def __init__(self):
        self.file, self.at = tempfile.TemporaryFile(), []

    def add(self, text: bytes) -> None:
        self.at.append((self.file.tell(), len(text)))
        self.file.write(text)

    def __iter__(self) -> Iterator[bytes]:
        for start, n in self.at:
            self.file.seek(start)
            yield self.file.read(n)


class _Rows:
    """Embedding rows of the words of all texts in a scratch file, a row of it for each word; ptr is where each text begins."""

    def __init__(self, kinds: int):
        self.file, self.kinds = tempfile.TemporaryFile(), kinds
        self.ptr = np.zeros(1, dtype=np.int64)

    def add(self, rows: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(rows.T, dtype=np.int32).tobytes())

    def read(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(4 * self.kinds * int(start))
        return np.frombuffer(self.file.read(4 * self.kinds * int(stop - start)), dtype=np.int32).reshape(-1, self.kinds).T


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """All texts, about PIECE_BYTES at a time and cut at spaces only, and which text each piece is of."""
    which, out, held = [], [], 0
    for i, text in enumerate(texts):
        a = 0
        while a == 0 or a < len(text):
            b = text.find(b" ", a + PIECE_BYTES)
            b = max(1, len(text)) if b < 0 else b
            which.append(i)
            out.append(text[a:b])
            held, a = held + b - a, b
            if held >= PIECE_BYTES:
                yield np.array(which), pa.array(out, type=pa.large_binary()).view(pa.large_string())
                which, out, held = [], [], 0
    if which:
        yield np.array(which), pa.array(out, type=pa.large_binary()).view(pa.large_string())


def _frequent(texts: Iterable[bytes], more_than: float) -> np.ndarray:
    """Hashes, but 0, that more than so many texts have as one kind; a text counts once however many pieces it has."""
    kinds = 1 + len(PREFIXES)
    found = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))] * kinds
    new: list[list] = [[] for _ in range(kinds)]
    last, seen = -1, [np.empty(0, dtype=np.uint64)] * kinds

    def merge() -> None:
        for i in range(kinds):
            h, n = (np.concatenate(x) for x in zip(found[i], *new[i], strict=True))
            keys, at = np.unique(h, return_inverse=True)
            found[i], new[i] = (keys, np.bincount(at.reshape(-1), weights=n, minlength=len(keys)).astype(np.int64)), []

    for which, pieces in _pieces(texts):
        hashes, ptr = features(pieces)
        doc = np.repeat(which, np.diff(ptr))
        for i, h in enumerate(hashes):
            keys, at = np.unique(h, return_inverse=True)
            pairs = words.distinct(at.reshape(-1).astype(np.int64) * (which[-1] + 1) + doc)
            of, keys = pairs % (which[-1] + 1), keys[pairs // (which[-1] + 1)]
            fresh = (of != last) | ~np.isin(keys, seen[i])
            new[i].append(words.distinct_counts(keys[fresh]))
            mine = keys[of == which[-1]]
            seen[i] = np.union1d(seen[i], mine) if which[-1] == last else mine
        last = which[-1]
        if sum(len(h) for x in new for h, _ in x) > sum(len(h) for h, _ in found):
            merge()
    merge()
    return np.unique(np.concatenate([h[(n > more_than) & (h != 0)] for h, n in found]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: Iterable[bytes], labels: np.ndarray, langs: list | None = None, *, size: int = 12, filters: int = 8, widths: tuple = (1, 2, 3), epochs: int = 5, least_part: float = 0.0025, seed: int = 5, **more) -> Model:
    """Train on labelled texts, which are read twice; a fifth of them sets the thresholds of the languages.

    Hashes that fewer than 3 of the texts have, or a smaller part of them than
    least_part, are left to the common row of unknown words.  One class only, or no texts, gives a model whose
    scores are near that class's rate.  All of every text is learned from:
    words' rows go to a scratch file, and memory holds a piece of it at a time
    beside the distinct hashes.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    keys = _frequent(texts, max(2, least_part * (len(y) + 1)))
    find, known, n_words = _Lookup(keys), _Rows(1 + len(PREFIXES)), np.zeros(len(y), dtype=np.int64)
    for which, pieces in _pieces(texts):
        hashes, ptr = features(pieces)
        known.add(np.stack([find(h) for h in hashes]))
        np.add.at(n_words, which, np.diff(ptr))
    known.ptr = np.concatenate([known.ptr, np.cumsum(n_words)])
    vectors = (rng.standard_normal((len(keys) + 1, size)) * 0.1).astype(np.float32)
    vectors[0] = 0
    m = Model(keys, vectors, [(rng.standard_normal((w, size, filters)) * 0.3).astype(np.float32) for w in widths], [np.zeros(filters, dtype=np.float32) for _ in widths], (rng.standard_normal(len(widths) * filters) * 0.3).astype(np.float32), 0.0)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m.out_bias = float(np.log(rate / (1 - rate)))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    _begin(m, known, y, used)
    if 0 < y[used].sum() < len(used):
        _descend(m, known, y, used, epochs, rng, **more)
    _calibrate(m, known, y, langs, held)
    return m


def _begin(m: Model, known: _Rows, y: np.ndarray, used: np.ndarray) -> None:
    """First coordinate of an embedding: how far its texts' labels are from the rate, in standard deviations; filters begin by reading it."""
    rate = float(y[used].mean()) if len(used) else 0.0
    n, hits = np.zeros(len(m.vectors), dtype=np.int64), np.zeros(len(m.vectors))
    for d in used:
        has = np.zeros(len(m.vectors), dtype=bool)
        for a in range(known.ptr[d], known.ptr[d + 1], PIECE_WORDS):
            has[known.read(a, min(a + PIECE_WORDS, known.ptr[d + 1]))] = True
        n += has
        hits += has * y[d]
    m.vectors[:, 0] = (hits - n * rate) / np.sqrt(n * rate * (1 - rate) + 1) / 10
    m.vectors[0] = 0
    for f in m.filters:
        f[:, 0] = np.abs(f[:, 0]) * 3 / len(f)
    m.out[:] = np.abs(m.out)


def _stretches(ptr: np.ndarray, docs: np.ndarray) -> Iterator[np.ndarray]:
    """Columns (place in docs, first word, end) of stretches of the docs, PIECE_WORDS at a time at most; those of one doc come apart."""
    out, held = [], 0
    for i, d in enumerate(docs):
        for a in range(ptr[d], max(ptr[d] + 1, ptr[d + 1]), PIECE_WORDS):
            b = min(a + PIECE_WORDS, ptr[d + 1])
            if out and (held + b - a > PIECE_WORDS or out[-1][0] == i):
                yield np.array(out).T
                out, held = [], 0
            out.append((i, a, b))
            held += b - a
    if out:
        yield np.array(out).T


def _pooled(m: Model, known: _Rows, docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of each filter over each of docs, 0 at least; for each width the rows (kind, word of the filter, doc, filter) that it came from."""
    pad, n_filters = max(len(f) for f in m.filters), m.filters[0].shape[2]
    pooled = np.full((len(docs), m.out.size), -1e30, dtype=np.float32)
    under = [np.zeros((known.kinds, len(f), len(docs), n_filters), dtype=np.int32) for f in m.filters]
    for of, start, stop in _stretches(known.ptr, docs):
        # filters that begin in a stretch reach into the words after it
        reach = np.minimum(stop + pad - 1, known.ptr[docs[of] + 1])
        place, first, blank = _padded(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(reach - start)]), pad)
        row = np.zeros((known.kinds, len(blank)), dtype=np.int32)
        row[:, place] = np.concatenate([known.read(a, b) for a, b in zip(start, reach, strict=True)], axis=1)
        for a, b in zip(first + stop - start, first + reach - start, strict=True):
            blank[a:b] = True
        x = m.vectors[row].mean(axis=0)
        ends = np.append(first[1:], len(blank))
        for i, (f, bias) in enumerate(zip(m.filters, m.biases, strict=True)):
            r = _responses(x, f, bias, blank)
            top = np.stack([s + r[s:e].argmax(0) for s, e in zip(first, ends, strict=True)])
            value = r[top, np.arange(n_filters)]
            d, e = np.nonzero(value > pooled[of, i * n_filters : (i + 1) * n_filters])
            pooled[of[d], i * n_filters + e] = value[d, e]
            for k in range(len(f)):
                under[i][:, k, of[d], e] = row[:, top[d, e] + k]
    return np.maximum(pooled, 0), under


def _descend(m: Model, known: _Rows, y, used, epochs, rng, batch: int = 32, least_steps: int = 500, rate: float = 0.15, power: float = 0.5) -> None:
    """Adagrad over small batches; only the largest response of a filter passes a gradient back."""
    widths, size = [len(f) for f in m.filters], m.vectors.shape[1]
    n_filters = m.filters[0].shape[2]
    sums = {"v": np.full(m.vectors.shape, 1e-2, dtype=np.float32), "o": np.full(m.out.shape, 1e-2, dtype=np.float32), "f": [np.full(f.shape, 1e-2, dtype=np.float32) for f in m.filters], "b": [np.full(x.shape, 1e-2, dtype=np.float32) for x in m.biases]}
    bias_sum, weight = 1e-2, min(10.0, float((1 - y[used]).sum() / max(1.0, y[used].sum())) ** power)
    for _ in range(max(epochs, least_steps * batch // max(1, len(used)))):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            docs = np.sort(used[at : at + batch])
            pooled, under = _pooled(m, known, docs)
            p = _sigmoid(pooled @ m.out + m.out_bias)
            g = ((p - y[docs]) * np.where(y[docs] > 0, weight, 1.0) / len(docs)).astype(np.float32)
            d_out = pooled.T @ g + 1e-4 * m.out
            d_pool = np.where(pooled > 0, g[:, None] * m.out, 0).astype(np.float32)
            d_x, rows = [], []
            for i, w in enumerate(widths):
                d = d_pool[:, i * n_filters : (i + 1) * n_filters]
                d_f = np.zeros_like(m.filters[i])
                for k in range(w):
                    d_f[k] = np.einsum("df,dfe->ef", d, m.vectors[under[i][:, k]].mean(axis=0))
                    d_x.append((d[:, :, None] * m.filters[i][k].T[None]).reshape(-1, size))
                    rows.append(under[i][:, k].reshape(known.kinds, -1))
                sums["f"][i] += d_f**2
                m.filters[i] -= rate * d_f / np.sqrt(sums["f"][i])
                d_b = d.sum(0)
                sums["b"][i] += d_b**2
                m.biases[i] -= rate * d_b / np.sqrt(sums["b"][i])
            d_x, rows = np.concatenate(d_x), np.concatenate(rows, axis=1)
            touched, inverse = np.unique(rows, return_inverse=True)
            d_v = np.zeros((len(touched), size), dtype=np.float32)
            np.add.at(d_v, inverse.reshape(-1), np.tile(d_x / known.kinds, (known.kinds, 1)))
            d_v[touched == 0] = 0
            sums["v"][touched] += d_v**2
            m.vectors[touched] -= rate * d_v / np.sqrt(sums["v"][touched])
            sums["o"] += d_out**2
            m.out -= rate * d_out / np.sqrt(sums["o"])
            bias_sum += float(g.sum()) ** 2
            m.out_bias -= rate * float(g.sum()) / bias_sum**0.5


def _responses(x: np.ndarray, f: np.ndarray, bias: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Response of every filter at every place; blanks come after a text's words, and none of its own counts but the first."""
    r = x @ f[0]
    for k in range(1, len(f)):
        r[:-k] += x[k:] @ f[k]
    r += bias
    r[blank] = -1e30
    return r


def score(m: Model, find: _Lookup, texts) -> np.ndarray:
    """Score between 0 and 1 of each text."""
    hashes, ptr = features(texts)
    pad = max(len(f) for f in m.filters)
    place, first, blank = _padded(ptr, pad)
    out = np.full(len(first), m.out_bias, dtype=np.float64)
    if len(first):
        x = np.zeros((len(blank), m.vectors.shape[1]), dtype=np.float32)
        x[place] = sum(m.vectors[find(h)] for h in hashes) / len(hashes)
        n = 0
        for f, bias in zip(m.filters, m.biases, strict=True):
            top = np.maximum.reduceat(_responses(x, f, bias, blank), first, axis=0)
            out += np.maximum(top, 0) @ m.out[n : n + f.shape[2]]
            n += f.shape[2]
    return _sigmoid(out)


def _calibrate(m: Model, known: _Rows, y, langs, held) -> None:
    """The threshold of each language with 10 held texts or more of either class: between its classes' scores where they are apart, else where most are right."""
    if langs is None or not len(held):
        return
    s = _sigmoid(np.concatenate([_pooled(m, known, held[i : i + 200])[0] for i in range(0, len(held), 200)]).astype(np.float64) @ m.out + m.out_bias)
    of = np.asarray([x or "" for x in langs], dtype=object)[held]
    for lang in sorted(set(of)):
        mine = of == lang
        pos, neg = np.sort(s[mine & (y[held] > 0)]), np.sort(s[mine & (y[held] == 0)])
        if len(pos) < 10 or len(neg) < 10:
            continue
        cuts = np.unique(np.concatenate([pos, neg]))
        cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [0.7]])
        right = np.searchsorted(neg, cuts, side="left") / len(neg) + (len(pos) - np.searchsorted(pos, cuts, side="left")) / len(pos)
        best = cuts[right >= right.max() - 1e-12]
        m.thresholds[lang] = float(best[np.argmin(abs(best - 0.7))])


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about rows labelled documents, chosen by a hash of the id, none of them held out.

    The hash alone chooses, whatever a text's length, and all of a chosen text
    is learned from.  The rows come partition by partition into a scratch file
    of the driver's, which takes their text and 20 bytes for each word of it.
    Labels that are null, and ids without a document, are left out; of repeated
    ids one row counts.  No labels at all give a model that scores everything
    the same.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    total = known.count()
    part = min(1.0, rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 62)) < int(part * (1 << 62))).dropDuplicates(["id"])
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), lang.alias("lang"))
    texts, got = _Texts(), []
    for r in chosen.join(wanted, "id").dropDuplicates(["id"]).toLocalIterator():
        texts.add(bytes(r["text"]))
        got.append((r["id"], r["y"], r["lang"]))
    order = sorted(range(len(got)), key=lambda i: got[i][0])
    texts.at = [texts.at[i] for i in order]
    return fit(texts, np.array([got[i][1] for i in order], dtype=np.float32), [got[i][2] for i in order] if lang_col else None)


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 of each whole text.

    A null text counts as empty, and an empty one gets the score of no response.
    All rows and columns stay; a column named out_col is replaced.
    """
    store.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    at = kept.index(text_col)
    schema = docs.select(*kept).withColumn(out_col, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the rows it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, find = shared.value, None
        for batch in batches:
            find = find or _Lookup(m.keys)
            for part in words.blocks(batch, batch.schema.names[at], 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(m, find, part.column(at)))], names=[*part.schema.names, out_col])

    return docs.select(*kept).mapInArrow(run, schema)


def over_threshold(model: Model, lang: Column | None, score_col: Column) -> Column:
    """Whether a score reaches the threshold of its language; others get the default."""
    limit = F.lit(model.default_threshold)
    if lang is not None:
        for name, value in sorted(model.thresholds.items()):
            limit = F.when(lang == name, F.lit(value)).otherwise(limit)
    return score_col >= limit
