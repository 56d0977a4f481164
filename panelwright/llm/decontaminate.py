"""Benchmark decontamination by an FM-index of each training shard.

A shard is a block of whole documents.  Its text, over the alphabet of words that
the benchmark has, is indexed: suffix order, Burrows-Wheeler transform, a wavelet
matrix for ranks, and sampled suffix positions.  Every window of every benchmark
item is looked up by backward search, all of them at once, and what is found is
located and merged into spans to remove.

Words that no benchmark item has can be part of no occurrence.  They end a run;
runs shorter than the shortest window are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, words

PHRASE_BYTES = 64 << 20  # text of benchmark items, at most, that the driver reads
BUILT_BYTES = 128 << 20  # and of the windows made of it, which are sent to the executors
SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 16


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit at a time from the highest."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.ones, self.zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol is among the first i."""
        start = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(bit, zeros + ones[i], i - ones[i])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return i - start

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ones[i + 1] - ones[i]
            out = 2 * out + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is an end of its own, so suffixes differ at their end at the latest."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = np.flatnonzero(text == 0)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    k = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, dtype=np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if int(step.sum()) == n - 1 or k >= n:
            return order


class FMIndex:
    """Counts and places of phrases in a text of symbols; symbol 0 ends a run and is in no phrase."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        order = suffix_order(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(symbols - 1).bit_length()))
        self.before = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.before[1:])
        # a run's first place is sampled too, so no walk goes back over a 0
        sampled = (order % every == 0) | (text[order - 1] == 0) | (order == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many phrases of one length: the suffix range of each."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.bwt.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
            gone = lo[live] >= hi[live]
            hi[live[gone]] = lo[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back to the next sampled suffix."""
        rows, out, steps = rows.copy(), np.empty(len(rows), dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows[live]]
            done = live[hit]
            out[done] = self.positions[self.sample_rank[rows[done]]] + steps
            live = live[~hit]
            c = self.bwt.at(rows[live])
            rows[live] = self.before[c] + self.bwt.rank(c, rows[live])
            steps += 1
        return out


@dataclass
class Phrases:
    """Benchmark windows: words by their hash, windows of each length, and the items of each window."""

    words: np.ndarray  # sorted hashes; symbol i + 1 is words[i]
    windows: list[np.ndarray]  # symbols, a row for each distinct window of one length
    first: list[np.ndarray]  # for each window, where its items begin in items
    items: list[np.ndarray]
    names: list[str]

    @property
    def shortest(self) -> int:
        return min(w.shape[1] for w in self.windows)


def phrases_of(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> Phrases | None:
    """The windows of a benchmark; None if no item has a word.

    The items must have PHRASE_BYTES of text at most and make BUILT_BYTES of
    windows at most, as those are sent to every executor; a larger benchmark is
    an error, to be looked up in several parts.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > PHRASE_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, over {PHRASE_BYTES}: look it up in parts")
    got = rows.dropDuplicates().toArrow()
    w = words.split(got.column("text"), words.ALNUM, lower=True)
    if not len(w.starts):
        return None
    built = 4 * int((np.minimum(w.counts, window) * np.maximum(w.counts - window + 1, 1)).sum())
    if built > BUILT_BYTES:
        raise ValueError(f"the benchmark makes {built} bytes of windows, over {BUILT_BYTES}: look it up in parts")
    vocabulary, symbols = np.unique(w.hashes(), return_inverse=True)
    symbols = symbols.reshape(-1).astype(np.int32) + 1
    by_length: dict[int, list] = {}
    for i, (a, b) in enumerate(zip(w.ptr[:-1], w.ptr[1:], strict=True)):
        if k := min(window, b - a):
            starts = np.arange(a, b - k + 1)
            by_length.setdefault(int(k), []).append((symbols[starts[:, None] + np.arange(k)], np.full(len(starts), i)))
    out = Phrases(vocabulary, [], [], [], got.column("item").to_pylist())
    for _, parts in sorted(by_length.items()):
        rows_, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        distinct, which = np.unique(rows_, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), item], axis=1), axis=0)
        out.windows.append(distinct)
        out.first.append(np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)))
        out.items.append(pairs[:, 1])
    return out


@dataclass
class Found:
    """For each text of a shard: words, spans of hit words (text, from, to), and (text, item) pairs."""

    words: words.Words
    spans: np.ndarray
    pairs: np.ndarray


def search_shard(texts, p: Phrases) -> Found:
    """Index the texts and look up all phrases in them."""
    w = words.split(texts, words.ALNUM, lower=True)
    h = w.hashes()
    at = np.minimum(np.searchsorted(p.words, h), len(p.words) - 1)
    symbol = np.where(p.words[at] == h, at + 1, 0)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    # runs of words of the alphabet, within one text
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
    start = np.flatnonzero(begins)
    ends = known.copy()
    ends[:-1] &= ~(known[1:] & (doc[1:] == doc[:-1]))
    stop = np.flatnonzero(ends) + 1
    long = stop - start >= p.shortest
    start, n = start[long], (stop - start)[long]
    none = np.empty((0, 3), dtype=np.int64)
    if not len(start):
        return Found(w, none, none[:, :2])
    own = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n)])
    source = np.arange(own[-1]) + np.repeat(start - own[:-1], n)
    place = np.arange(own[-1]) + np.repeat(np.arange(len(n)), n)
    text = np.zeros(own[-1] + len(n), dtype=np.int64)
    text[place] = symbol[source]
    back = np.full(len(text), -1, dtype=np.int64)
    back[place] = source
    index = FMIndex(text, len(p.words) + 1)
    cover = np.zeros(len(symbol) + 1, dtype=np.int64)
    pairs = []
    for windows, first, items in zip(p.windows, p.first, p.items, strict=True):
        lo, hi = index.search(windows)
        hit = np.flatnonzero(hi > lo)
        times = (hi - lo)[hit]
        rows = np.arange(times.sum()) + np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(hit) else np.empty(0, dtype=np.int64)
        found = back[index.locate(rows)]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + windows.shape[1], -1)
        seen = np.unique(np.stack([doc[found], np.repeat(hit, times)], axis=1), axis=0)
        many = (first[1:] - first[:-1])[seen[:, 1]]
        which = np.arange(many.sum()) + np.repeat(first[seen[:, 1]] - np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(many)[:-1]]), many) if len(seen) else np.empty(0, dtype=np.int64)
        pairs.append(np.stack([np.repeat(seen[:, 0], many), items[which]], axis=1))
    covered = np.cumsum(cover[:-1]) > 0
    a = covered.copy()
    a[1:] &= ~(covered[:-1] & (doc[1:] == doc[:-1]))
    b = covered.copy()
    b[:-1] &= ~(covered[1:] & (doc[1:] == doc[:-1]))
    a, b = np.flatnonzero(a), np.flatnonzero(b) + 1
    spans = np.stack([doc[a], a, b], axis=1) if len(a) else none
    return Found(w, spans, np.unique(np.concatenate(pairs), axis=0))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, n_words, spans, items) for each row of docs.

    spans: the merged runs of words, [start, end), that lie in an occurrence of
    window consecutive words of an item, or of a whole shorter item.  items: ids
    of the items that have an occurrence, as sorted strings.  Words are those of
    the class ALNUM with A-Z lower-cased.

    Null and empty texts have no words; items without words occur nowhere; a
    null item id reads as an empty string.  Repeated rows each give their row.
    """
    spark = docs.sparkSession
    store.ship(spark)
    p = phrases_of(benchmark, id_col=item_col, text_col=item_text_col, window=window)
    shared = spark.sparkContext.broadcast(p)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = shared.value
        for batch in batches:
            for part in words.blocks(batch, "text", SHARD_BYTES):
                n = part.num_rows
                if ph is None:
                    counts, spans, pairs = words.split(part.column(1), words.ALNUM).counts, np.empty((0, 3), dtype=np.int64), np.empty((0, 2), dtype=np.int64)
                    base = np.zeros(n, dtype=np.int64)
                else:
                    f = search_shard(part.column(1), ph)
                    counts, spans, pairs, base = f.words.counts, f.spans, f.pairs, f.words.ptr[:-1]
                at = np.searchsorted(spans[:, 0], np.arange(n + 1)).astype(np.int32)
                shift = base[spans[:, 0]] if len(spans) else base[:0]
                inner = pa.StructArray.from_arrays([pa.array(spans[:, 1] - shift), pa.array(spans[:, 2] - shift)], names=["start", "end"])
                names = [[] for _ in range(n)]
                for d, i in pairs.tolist():
                    names[d].append(ph.names[i])
                items = pa.array([sorted(set(x)) for x in names], type=pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), inner), items], names=[id_col, "n_words", "spans", "items"])

    return source.mapInArrow(run, schema)


def remove(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", item_text_col: str = "text", item_col: str = "item_id", window: int = 10) -> DataFrame:
    """docs with the spans of contamination() cut out of their texts; all rows and columns stay.

    A span is cut from its first word's first byte to its last word's last one;
    a text without a span, null ones too, is unchanged.  length_col, if docs has
    it, becomes the new text's length where the text changed.  Repeated rows are
    cut alike; other columns may have any names.
    """
    spark = docs.sparkSession
    store.ship(spark)
    p = phrases_of(benchmark, id_col=item_col, text_col=item_text_col, window=window)
    if p is None:
        return docs
    shared = spark.sparkContext.broadcast(p)
    at = docs.columns.index(text_col)
    (flag,) = store.free_names(docs.columns, "changed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, batch.schema.names[at], SHARD_BYTES):
                f = search_shard(part.column(at), shared.value)
                changed = np.zeros(part.num_rows, dtype=bool)
                column = part.column(at)
                if len(f.spans):
                    column, changed = cut(part.column(at), f)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], column, *part.columns[at + 1 :], pa.array(changed)], names=[*part.schema.names, flag])

    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
    out = docs.mapInArrow(run, schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(flag), F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def cut(column, f: Found) -> tuple[pa.Array, np.ndarray]:
    """The texts without the bytes of their spans, and which of them changed."""
    data, offsets = words.buffers(column)
    texts, changed = column.to_pylist(), np.zeros(len(column), dtype=bool)
    for d in np.unique(f.spans[:, 0]):
        mine = f.spans[f.spans[:, 0] == d]
        at, parts = int(offsets[d]), []
        for _, a, b in mine.tolist():
            parts.append(data[at : f.words.starts[a]].tobytes())
            at = int(f.words.ends[b - 1])
        parts.append(data[at : offsets[d + 1]].tobytes())
        texts[d], changed[d] = b"".join(parts).decode("utf-8"), True
    return pa.array(texts, type=column.type), changed
