"""Repeated passages by prefix-partitioned suffix trees.

A suffix begins at a word.  Two that share their first WINDOW words lie under one
internal node of the corpus's suffix tree that is WINDOW words deep or more, and
all suffixes of such a node but the first mark a repeat.  Consecutive marked
suffixes of a document are one maximal repeat.

The tree is built in parts, each under a prefix, and prefixes are as long as it
takes for a part to fit in memory.  Of the ANCHOR-word sequences in a window, the
one with the smallest hash is its prefix; equal windows have equal ones at the
same place, so neighbouring suffixes mostly share it, and are sent together as one
passage.  Passages are counted exactly.  Where more than GROUP_MOST share a
prefix, each of their windows takes its prefix from its longer sequences, and
again, LENGTHS times, up to the whole window, where equal suffixes are a single node
and count once in each task.

Prefixes that occur once in the corpus head no deep node; an exchange of hashes
finds them, and only the others' text is sent.  In each part the suffixes are put
in order by prefix doubling, neighbours' common lengths (LCP) follow from the
doubled names, and runs of neighbours with WINDOW words in common are its deep
internal nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs, store, words

WINDOW = 20
ANCHOR = 8
LENGTHS = 4  # of a prefix: an anchor's, and evenly more up to the window's
GROUP_MOST = 4096  # passages under a prefix, at most; it decides how suffixes are split, not what is found
GROUP_BYTES = 1 << 20
TREE_BYTES = GROUP_BYTES // 4  # of the input for each group of prefixes; tasks that get many small groups get about as much each
HELD = 300_000  # windows, each its own prefix, that a task holds before it sends them on

MARKED = 255  # kind of a record of windows that are known to be repeats; those of a prefix have its place among the lengths
PREFIX = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("many", "<u2"), ("kind", "u1")])
MARK = np.dtype([("doc", "<i8"), ("at", "<u4"), ("many", "<u4")])


def anchors(h: np.ndarray, ptr: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchor-word sequences, all window starts within one text, and the place of each one's anchor, the first of equal ones."""
    g = words.windows(h, anchor)
    starts = np.flatnonzero(words.inside(ptr, window))
    best = np.arange(len(g))
    reach = window - anchor + 1
    span = 1
    while span < reach:
        step = min(span, reach - span)
        other = best[step:]
        best = best[: len(other)]
        best = np.where(g[other] < g[best], other, best)
        span += step
    return g, starts, best[starts] if len(starts) else starts


def _runs(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of at, at + 1, ... with the same other values begin."""
    if not len(at):
        return np.empty(0, dtype=np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def lengths(window: int, anchor: int) -> list[int]:
    """Words of a prefix: an anchor's, then more and more, the whole window at last."""
    return sorted({anchor + (window - anchor) * i // (LENGTHS - 1) for i in range(LENGTHS)})


def prefixes_of(h: np.ndarray, ptr: np.ndarray, window: int, anchor: int, crowded: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window its prefix's hash, place and length's place in lengths(), and the windows' starts.

    crowded: for each length but the last, the prefixes (Members) that head too
    many passages; a length beyond those given ends the search for a longer one.
    """
    g, starts, best = anchors(h, ptr, window, anchor)
    key, place, nth = g[best], best.copy(), np.zeros(len(starts), dtype=np.uint8)
    left = np.arange(len(starts))
    for i, n in enumerate(lengths(window, anchor)[1:], 1):
        if i > len(crowded):
            break
        left = left[crowded[i - 1](key[left])]
        if not len(left):
            break
        if n == window:
            key[left], place[left] = words.windows(h, window, salt=1)[starts[left]], starts[left]
        else:
            g, _, best = anchors(h, ptr, window, n)
            key[left], place[left] = g[best[left]], best[left]
        nth[left] = i
    return key, place, nth, starts


class _Held:
    """Windows that are their own prefix, of one task: the first of each, and marks for the others.  All are sent on when there are HELD."""

    def __init__(self, kind: int, buckets: int):
        self.kind, self.buckets = kind, buckets
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, h1, h2, doc, at) -> Iterator[pa.RecordBatch]:
        self.parts.append((h1, h2, doc, at))
        self.size += len(h1)
        if self.size > HELD:
            yield from self.merge()
            if self.size > HELD // 2:
                yield from self.flush()

    def merge(self) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((at, doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        first = np.ones(len(h1), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h1) else np.empty(0, dtype=np.int64)
        later = (doc != doc[head]) | (at != at[head])
        yield from _send_marks(_marks(doc[later], at[later]), self.buckets)
        self.parts, self.size = [(h1[first], h2[first], doc[first], at[first])], int(first.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        yield from self.merge()
        h1, _, doc, at = self.parts[0]
        out = np.empty(len(h1), dtype=PREFIX)
        out["h"], out["doc"], out["at"], out["many"], out["kind"] = h1, doc, at, 1, self.kind
        yield from blobs.send((out["h"] % np.uint64(self.buckets)).astype(np.int64), out)
        self.parts, self.size = [], 0


def _marks(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marked window starts as runs."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    doc, at = doc[keep], at[keep]
    first = _runs(at, doc)
    out = np.empty(len(first), dtype=MARK)
    out["doc"], out["at"], out["many"] = doc[first], at[first], np.diff(np.append(first, len(doc)))
    return out


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of some windows start after an equal one."""
    order = np.lexsort((at, doc, h2, h1))
    same = np.zeros(len(order), dtype=bool)
    x, y = h1[order], h2[order]
    same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order] = same
    return out


def _send_marks(marks: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks among the prefixes, by document; long runs in parts."""
    many = -(-marks["many"].astype(np.int64) // 60_000)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    m = np.repeat(np.arange(len(marks)), many)
    out = np.empty(len(m), dtype=PREFIX)
    out["h"], out["doc"], out["at"], out["many"], out["kind"] = 0, marks["doc"][m], marks["at"][m] + nth * 60_000, np.minimum(marks["many"][m] - nth * 60_000, 60_000), MARKED
    yield from blobs.send((words.mix(out["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), out)


def _counted(window: int, anchor: int, crowded, upto: int, buckets: int):
    """How many passages each prefix heads, for the windows whose shorter prefixes are crowded: of the next length, or of all up to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = crowded.value
        counts = [blobs.Counts(buckets) for _ in range(len(known), upto)]
        for batch in batches:
            for part in words.blocks(batch, "text", 2 << 20):
                w = words.split(part.column(1))
                h = w.hashes()
                key, place, nth, starts = prefixes_of(h, w.ptr, window, anchor, known)
                mine = np.flatnonzero(nth == len(known))
                row = np.repeat(np.arange(part.num_rows), w.counts)[starts] if len(starts) else starts
                for i, c in enumerate(counts):
                    if i:
                        if not len(mine):
                            break
                        g, _, best = anchors(h, w.ptr, window, lengths(window, anchor)[len(known) + i])
                        key, place = g[best], best
                    first = _runs(starts[mine], place[mine], row[mine])
                    yield from _tagged(c.add(key[mine[first]]), len(known) + i)
        for i, c in enumerate(counts):
            yield from _tagged(c.flush(), len(known) + i)

    return run


def _tagged(batches: Iterator[pa.RecordBatch], nth: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, nth, dtype=np.int32))], names=[*b.schema.names, "nth"])


def _crowded(docs: DataFrame, window: int, anchor: int, most: int) -> list[blobs.Members]:
    """For each length of a prefix but the last, the prefixes that head more than most passages.

    Anchors are counted first; of the windows under crowded ones the prefixes of
    all other lengths are counted at once, which is their number at most.
    """
    spark, n = docs.sparkSession, len(lengths(window, anchor)) - 1
    buckets = store.buckets_for(docs.select("text"), 4 * GROUP_BYTES)
    out: list[blobs.Members] = []
    while len(out) < n:
        begin, upto = len(out), 1 if not out else n
        counted = docs.mapInArrow(_counted(window, anchor, spark.sparkContext.broadcast(list(out)), upto, buckets), blobs.SCHEMA + ", nth int")
        found = store.materialise(blobs.more_than(store.dealt(counted, "bucket", docs.select("text")), most, by="nth"), "crowded")
        out += [blobs.members(found.where(F.col("nth") == i), "h") for i in range(begin, upto)]
        if not len(out[-1]) and upto == 1:
            break
    return out


def _frequent(docs: DataFrame, window: int, anchor: int, most: int = 16) -> blobs.Members:
    """The anchors that head more than most passages of the table (id, text)."""
    counted = docs.mapInArrow(_counted(window, anchor, docs.sparkSession.sparkContext.broadcast([]), 1, 64), blobs.SCHEMA + ", nth int")
    return blobs.members(blobs.more_than(counted, most, by="nth"), "h")


def _prefixes(window: int, anchor: int, crowded, buckets: int):
    """A record for each prefix of each text's suffixes."""
    last = len(lengths(window, anchor)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = crowded.value, _Held(last, buckets)
        for batch in batches:
            for part in words.blocks(batch, "text", 2 << 20):
                w = words.split(part.column(1))
                h = w.hashes()
                key, place, nth, starts = prefixes_of(h, w.ptr, window, anchor, known)
                row = np.repeat(np.arange(part.num_rows), w.counts)[starts] if len(starts) else starts
                ids = part.column(0).to_numpy()
                within = starts - w.ptr[row]
                own = (nth == last) & (last > 0)
                some = np.flatnonzero(~own)
                first = _runs(within[some], place[some], nth[some], row[some])
                out = np.empty(len(first), dtype=PREFIX)
                at = some[first]
                out["h"], out["doc"], out["at"], out["many"], out["kind"] = key[at], ids[row[at]], within[at], np.diff(np.append(first, len(some))), nth[at]
                # a word repeated on and on gives a passage for each window: equal ones of the block count once
                single = np.flatnonzero(out["many"] == 1)
                at = starts[at[single]]
                later = _later(words.windows(h, window, salt=1)[at], words.windows(h, window, salt=2)[at], out["doc"][single], out["at"][single])
                gone = single[later]
                if len(gone):
                    yield from _send_marks(_marks(out["doc"][gone], out["at"][gone]), buckets)
                    out = np.delete(out, gone)
                yield from blobs.send((out["h"] % np.uint64(buckets)).astype(np.int64), out)
                if own.any():
                    at = starts[own]
                    yield from held.add(key[own], words.windows(h, window, salt=2)[at], ids[row[own]], within[own])
        yield from held.flush()

    return run


def _repeated(buckets: int):
    """Prefixes that occur twice or more, and marks, by document."""

    def work(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.lexsort((records["h"], records["kind"]))]
        same = np.zeros(len(records), dtype=bool)
        same[1:] = (records["h"][1:] == records["h"][:-1]) & (records["kind"][1:] == records["kind"][:-1])
        again = same.copy()
        again[:-1] |= same[1:]
        out = records[again & (records["kind"] != MARKED) | (records["kind"] == MARKED)]
        yield from blobs.send((words.mix(out["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), out)

    return work


def _by_document():
    """A row for each document that has prefixes."""

    def work(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[records["kind"] != MARKED]
        records = records[np.argsort(records["doc"], kind="stable")]
        doc = records["doc"]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, dtype=np.int64)
        ends = np.append(first, len(doc))[1:]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array([records[a:b].tobytes() for a, b in zip(first, ends, strict=True)], type=pa.binary())], names=["doc", "records"])

    return work


def _passages(window: int, buckets: int):
    """The text under each repeated prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, "text", 1 << 20):
                w = words.split(part.column(1))
                raw = w.data.tobytes()
                records = [np.frombuffer(x.as_buffer(), dtype=PREFIX) for x in part.column(2)]
                base = np.repeat(w.ptr[:-1], [len(x) for x in records])
                r = np.concatenate(records)
                a = base + r["at"].astype(np.int64)
                b = a + r["many"].astype(np.int64) + window - 1
                text = [raw[s:e] for s, e in zip(w.starts[a].tolist(), w.ends[b - 1].tolist(), strict=True)]
                for c in range(0, len(r), 20_000):
                    x = r[c : c + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array((x["h"] % np.uint64(buckets)).astype(np.int64)), pa.array(x["doc"]), pa.array(x["at"].astype(np.int64)), pa.array(x["many"].astype(np.int32)), pa.array(text[c : c + 20_000], type=pa.binary())], names=["bucket", "doc", "at", "many", "text"])

    return run


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each distinct pair, in the pairs' order."""
    key = left * (int(right.max(initial=0)) + 1) + right
    order = np.argsort(key, kind="stable")
    out = np.empty(len(key), dtype=np.int64)
    step = np.zeros(len(key), dtype=np.int64)
    step[1:] = key[order[1:]] != key[order[:-1]]
    out[order] = np.cumsum(step)
    return out


def nodes_at(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place the tree's node at this depth on the path of its suffix; the last depth - 1 places have none of their own."""
    name, span = symbols, 1
    while span < depth:
        step = min(span, depth - span)
        # names of span words, at a place and step further, cover span + step words
        name = _names(name[: len(name) - step], name[step:])
        span += step
    return name


class SuffixTree:
    """The suffixes at some places of a text, in order, and the internal nodes above them.

    text: words as numbers; an end of its own after each passage keeps suffixes
    apart there.  longest: words of the longest passage.
    """

    def __init__(self, text: np.ndarray, places: np.ndarray, longest: int):
        # ends beyond the text's, so that a name of any length begins at every place
        beyond = int(text.max(initial=0)) + 1 + np.arange(2 * longest + 2)
        self.names, span = [np.concatenate([text, beyond])], 1
        while span < longest:
            name = self.names[-1]
            self.names.append(_names(name[: len(name) - span], name[span:]))
            span *= 2
        self.places = places[np.argsort(self.names[-1][places], kind="stable")]
        a, b = self.places[:-1], self.places[1:]
        self.lcp = np.zeros(max(0, len(places) - 1), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            self.lcp += np.where(name[a + self.lcp] == name[b + self.lcp], 1 << k, 0)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the topmost internal nodes of that depth or more begin among the ordered suffixes, leaves of none as nodes of one; and how deep each is."""
        first = np.flatnonzero(np.concatenate([[True], self.lcp < depth])) if len(self.places) else np.empty(0, dtype=np.int64)
        deep = np.full(len(first), -1, dtype=np.int64)
        many = np.diff(np.append(first, len(self.places))) > 1
        if many.any():
            # the least common length of the neighbours within a node
            inner = np.append(self.lcp, 0)
            inner[np.append(first[1:], len(self.places)) - 1] = np.iinfo(np.int64).max
            deep[many] = np.minimum.reduceat(inner, first)[many]
        return first, deep


def _trees(window: int, buckets: int):
    """Marks for the suffixes of a part that share a deep node with an earlier one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        code = table.column("text").combine_chunks().dictionary_encode()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        which = code.indices.to_numpy()
        doc, at, many = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "at", "many"))
        order = np.lexsort((at, doc, which))
        which, doc, at, many = which[order], doc[order], at[order], many[order]
        first = np.ones(len(which), dtype=bool)
        first[1:] = which[1:] != which[:-1]
        head = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        # passages equal to an earlier one are leaves of its nodes: all of them repeats
        later = (doc != doc[head][of]) | (at != at[head][of])
        found = [(doc[later], at[later], many[later])]
        # the distinct passages, in the dictionary's order
        w = words.split(code.dictionary.cast(pa.string()) if len(code.dictionary) else pa.array([], type=pa.string()))
        if len(w.starts) >= window:
            _, symbols = np.unique(w.hashes(), return_inverse=True)
            n_words, nth = w.counts, np.arange(len(w.counts))
            text = np.empty(len(symbols) + len(n_words), dtype=np.int64)
            text[w.ptr[1:] + nth] = int(symbols.max()) + 1 + nth
            text[np.arange(len(symbols)) + np.repeat(nth, n_words)] = symbols.reshape(-1)
            n = many[head]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(w.ptr[which[head]] + which[head], n) + step
            tree = SuffixTree(text, start, int(n_words.max()))
            top, deep = tree.nodes(window)
            # whose suffix each is
            back = np.argsort(start, kind="stable")
            mine = back[np.searchsorted(start[back], tree.places)]
            d, s = np.repeat(doc[head], n)[mine], (np.repeat(at[head], n) + step)[mine]
            node = np.repeat(np.arange(len(top)), np.diff(np.append(top, len(mine))))
            order = np.lexsort((s, d, node))
            node, d, s = node[order], d[order], s[order]
            later = (deep[node] >= window) & ((d != d[top][node]) | (s != s[top][node]))
            m = _marks(d[later], s[later])
            found.append((m["doc"], m["at"].astype(np.int64), m["many"].astype(np.int64)))
        out = np.empty(sum(len(x[0]) for x in found), dtype=MARK)
        for i, c in enumerate(("doc", "at", "many")):
            out[c] = np.concatenate([x[i] for x in found])
        made = list(blobs.send((words.mix(out["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), out))
        return pa.Table.from_batches(made) if made else pa.table({"bucket": pa.array([], type=pa.int64()), "block": pa.array([], type=pa.binary())})

    return run


def _spans(window: int):
    """The maximal repeats of each document: its marked windows, merged."""

    def work(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.lexsort((records["at"], records["doc"]))]
        doc, a = records["doc"], records["at"].astype(np.int64)
        b = a + records["many"].astype(np.int64) + window - 1
        ids, starts, ends = [], [], []
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, dtype=np.int64)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            x, y = a[i:j], np.maximum.accumulate(b[i:j])
            new = np.concatenate([[True], x[1:] > y[:-1]])
            ids.append(int(doc[i]))
            starts.append(x[new].tolist())
            ends.append(y[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(starts, type=pa.list_(pa.int64())), pa.array(ends, type=pa.list_(pa.int64()))], names=["doc", "starts", "ends"])

    return work


def _numbered(source: DataFrame, each_text: bool) -> tuple[DataFrame, int, DataFrame | None]:
    """source (id, text) with doc, a number for each document; how many numbers an id takes; and (id, part, text_hash) of ids with several texts."""
    texts = source.groupBy("id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y"), F.count("*").alias("n"))
    several = store.materialise(texts.where("n > 1").select("id", (F.col("x") != F.col("y")).alias("unclear")), "repeated-ids")
    source = source.withColumn("doc", F.col("id"))
    if several.isEmpty():
        return source, 1, None
    unclear = several.where("unclear")
    if not each_text or unclear.isEmpty():
        return source.join(unclear, "id", "left_anti").dropDuplicates(["id"]), 1, None
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    parts = hashed.join(unclear, "id", "left_semi").select("id", "text_hash").distinct()
    parts = store.materialise(parts.withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy("text_hash")).cast("long") - 1), "texts-of-ids")
    many = parts.agg(F.max("part")).first()[0] + 1
    widest = max(abs(x) for x in source.agg(F.min("id"), F.max("id")).first())
    if widest >= (1 << 62) // many:
        raise ValueError(f"ids up to {widest} with up to {many} texts each do not fit 64 bits")
    joined = hashed.join(parts, ["id", "text_hash"], "left").withColumn("doc", F.col("id") * many + F.coalesce("part", F.lit(0)))
    return joined.dropDuplicates(["doc"]).select("id", "text", "doc"), many, parts


def repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", each_text: bool = False) -> DataFrame:
    """(id, starts, ends): for each document with repeats, the runs of words [start, end) that they cover.

    A window is so many consecutive words, runs of other characters than space
    and U+0009 to U+000D.  It is a repeat if its words also start earlier: in a
    document of a smaller id, or before it in its own.  Windows are judged on
    the texts as given.

    Null, empty and short texts have no window.  Rows of a null id take no part.
    Rows that repeat an id and a text are one document.  Where an id has several
    texts, each is a document of its own with each_text, in the order of their
    hashes, and text_hash, null elsewhere, tells whose the runs are (xxhash64 of
    the text); without it runs could not be told apart, and such rows take no
    part.  Ids are whole numbers, else a TypeError.  Other columns are ignored,
    whatever their names.  An empty table gives no rows.
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be from 1 to window")
    store.whole_number_ids(docs, id_col)
    spark = docs.sparkSession
    store.ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    source, many, parts = _numbered(source, each_text)
    source = source.select("doc", "text")
    buckets = store.buckets_for(docs.select(F.col(text_col)), GROUP_BYTES)
    crowded = spark.sparkContext.broadcast(_crowded(source, window, anchor, GROUP_MOST))  # tables of bits of a bounded size
    prefixes = source.mapInArrow(_prefixes(window, anchor, crowded, buckets), blobs.SCHEMA)
    size = docs.select(F.col(text_col))
    again = store.materialise(blobs.each_bucket(store.dealt(prefixes, "bucket", size), _repeated(buckets), PREFIX, blobs.SCHEMA), "prefixes")

    wanted = store.materialise(blobs.each_bucket(store.dealt(again, "bucket", size), _by_document(), PREFIX, "doc long, records binary"), "wanted")
    passages = store.dealt(source, "doc", size).join(store.dealt(wanted, "doc", size).hint("merge"), "doc").select("doc", "text", "records").mapInArrow(_passages(window, store.buckets_for(size, TREE_BYTES)), "bucket long, doc long, at long, many int, text binary")
    marks = store.dealt(passages, "bucket", size).groupBy("bucket").applyInArrow(_trees(window, buckets), blobs.SCHEMA)
    marks = store.materialise(marks, "marks")

    # marks that tasks made of equal suffixes of their own
    def local(table: pa.Table) -> pa.Table:
        r = blobs.unpack(table, PREFIX)
        r = r[r["kind"] == MARKED]
        out = np.empty(len(r), dtype=MARK)
        out["doc"], out["at"], out["many"] = r["doc"], r["at"], r["many"]
        made = list(blobs.send((words.mix(out["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), out))
        return pa.Table.from_batches(made) if made else blobs._empty(blobs.SCHEMA)

    own = store.dealt(again, "bucket", size).groupBy("bucket").applyInArrow(local, blobs.SCHEMA)
    spans = store.materialise(blobs.each_bucket(store.dealt(marks.unionByName(own), "bucket", size), _spans(window), MARK, "doc long, starts array<long>, ends array<long>"), "repeats")
    part = F.pmod("doc", F.lit(many))
    whose = spans.select(F.expr(f"(doc - pmod(doc, {many}L)) div {many}L").alias("id"), part.alias("part"), "starts", "ends")
    hashes = F.lit(None).cast("long").alias("text_hash")
    whose = whose.join(parts, ["id", "part"], "left") if parts is not None else whose.select("*", hashes)
    columns = [F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "starts", "ends", *(["text_hash"] if each_text else [])]
    return whose.select(*columns)


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, starts: str, ends: str) -> DataFrame:
    """docs with the runs of each row's text, null for none."""
    key, of = store.free_names([*docs.columns, starts, ends], "key", "of")
    known = F.col("text_hash") if "text_hash" in spans.columns else F.lit(None).cast("long")
    found = spans.select(F.col(id_col).alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends), known.alias(of))
    mine = F.col(of).isNull() | (F.col(of) == F.xxhash64(F.col(text_col)))
    size = docs.select(F.col(text_col))
    left, right = store.dealt(docs, id_col, size), store.dealt(found, key, size)
    return left.join(right.hint("merge"), (F.col(id_col) == F.col(key)) & mine, "left").select(*docs.columns, starts, ends)


def kept_words(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of docs: what spans leave, joined by one space."""
    store.ship(docs.sparkSession)
    joined = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), spans.withColumnRenamed(id_col, "id"), "id", "text", "starts", "ends")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, "text", 1 << 20):
                w = words.split(part.column(1))
                raw, place = w.spaced()
                gone, digest = [], []
                for i, (starts, ends) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    a, b = int(w.ptr[i]), int(w.ptr[i + 1])
                    h, at, begun = hashlib.sha256(), a, False
                    for s, e in [*zip(starts or (), ends or (), strict=True), (b - a, b - a)]:
                        if a + s > at:
                            h.update((b" " if begun else b"") + raw[place[at] : place[a + s] - 1])
                            begun = True
                        at = a + e
                    gone.append(sum(ends or ()) - sum(starts or ()))
                    digest.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts.astype(np.int64)), pa.array(gone, type=pa.int64()), pa.array(digest)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, schema)


def remove(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the words that repeats() covers; all rows and columns stay.

    A run is cut up to the next kept word, so what is left keeps its white space.
    Texts without repeats, null ones too, stay as they are; length_col, if docs
    has it, becomes the new text's length where the text changed.  Where an id
    has several texts, each is a document of its own; rows that repeat an id and
    a text are cut alike, and rows of a null id stay.  Other columns may have
    any names.
    """
    spans = repeats(docs, window=window, anchor=anchor, id_col=id_col, text_col=text_col, each_text=True)
    columns, at = docs.columns, docs.columns.index(text_col)
    starts_name, ends_name, flag = store.free_names(columns, "starts", "ends", "changed")
    joined = _with_spans(docs, spans, id_col, text_col, starts_name, ends_name)
    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, batch.schema.names[at], 2 << 20):
                column = part.column(at)
                all_starts, all_ends = (part.column(len(columns) + i).to_pylist() for i in range(2))
                hit = [i for i, x in enumerate(all_starts) if x]
                changed = np.zeros(part.num_rows, dtype=bool)
                if hit:
                    w = words.split(column)
                    texts, raw = column.to_pylist(), w.data.tobytes()
                    for i in hit:
                        base, end = int(w.ptr[i]), int(w.offsets[i + 1])
                        pos, parts = int(w.offsets[i]), []
                        for s, e in zip(all_starts[i], all_ends[i], strict=True):
                            parts.append(raw[pos : w.starts[base + s]])
                            pos = int(w.starts[base + e]) if base + e < w.ptr[i + 1] else end
                        parts.append(raw[pos:end])
                        texts[i], changed[i] = b"".join(parts).decode("utf-8"), True
                    column = pa.array(texts, type=column.type)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], column, *part.columns[at + 1 : len(columns)], pa.array(changed)], names=[*columns, flag])

    out = joined.mapInArrow(run, schema)
    if length_col and length_col in columns:
        out = out.withColumn(length_col, F.when(F.col(flag), F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*columns)
