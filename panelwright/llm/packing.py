"""Packing documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so any corpus is a histogram of at
most that many counts.  The driver packs the histogram: sequences with the same
filling are one pattern with a count.  The patterns' slots then go out to the
pieces, each of which knows its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, words

FILL_STEPS = 4000  # fillings looked at for one sequence before the best found is taken
SEARCH_NODES = 2000  # sequences tried by branch and bound on what the patterns leave
CACHE_WORDS = 1_000_000  # some 30 MB
ENCODED_AT_ONCE = 4096  # the library holds about a kB for each

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that are needed at least: by total length, and by lengths over a limit that cannot share (the L2 bound)."""
    best = -(-sum(n * k for n, k in counts.items()) // capacity)
    small = [n for n in sorted(counts) if 2 * n <= capacity]
    for limit in [0, *small[:: max(1, len(small) // 32)]]:
        alone = sum(k for n, k in counts.items() if n > capacity - limit)
        half = [(n, k) for n, k in counts.items() if 2 * n > capacity and n <= capacity - limit]
        free = sum((capacity - n) * k for n, k in half)
        rest = sum(n * k for n, k in counts.items() if limit <= n and 2 * n <= capacity)
        best = max(best, alone + sum(k for _, k in half) + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], room: int, top: int) -> Filling:
    """Longest piece that fits, again and again: the first incumbent for a sequence with room left beside its longest piece top."""
    out = [(top, 1)]
    for n in sorted((n for n in counts if n <= room), reverse=True):
        have = counts[n] - (n == top)
        if (k := min(have, room // n)) > 0:
            out.append((n, k))
            room -= n * k
    return _merged(out)


def _merged(parts) -> Filling:
    c = Counter()
    for n, k in parts:
        c[n] += k
    return tuple(sorted(c.items(), reverse=True))


def waste(filling: Filling, capacity: int) -> int:
    return capacity - sum(n * k for n, k in filling)


def completions(counts: dict[int, int], capacity: int, keep: int = 1, steps: int = FILL_STEPS) -> list[Filling]:
    """Up to keep undominated fillings around the longest piece, the least waste first.

    Depth first over the lengths, longest first, taking as many of a length as
    fit before fewer.  A branch ends where even a full rest would not beat the
    keep best, which begin with the best-fit filling.  A filling is dominated
    if a longer piece could stand for one of its pieces in its waste; such are
    passed over, as what they spare is never of less use.
    """
    top = max(counts)
    room = capacity - top
    lengths = np.array(sorted((n for n in counts if n <= room), reverse=True), dtype=np.int64).tolist()
    have = {n: counts[n] - (n == top) for n in lengths}
    lengths = [n for n in lengths if have[n] > 0]
    tails = np.cumsum([n * have[n] for n in lengths][::-1])[::-1].tolist() if lengths else []
    negative = [-n for n in lengths]
    found = {best_fit(counts, room, top)}
    worst = [capacity] if keep > 1 else [min(waste(f, capacity) for f in found)]
    seen = [0]

    def dominated(parts: list, left: int) -> bool:
        if not left:
            return False
        used = dict(parts)
        for n, k in parts:
            for m in lengths:
                if m <= n:
                    break
                if m - n <= left and have[m] > used.get(m, 0):
                    return True
        return any(n <= left and have[n] > used.get(n, 0) for n in lengths)

    def walk(i: int, left: int, parts: list) -> None:
        seen[0] += 1
        if left < worst[0] and not dominated(parts, left):
            found.add(_merged([(top, 1), *parts]))
            if len(found) >= keep:
                worst[0] = sorted(waste(f, capacity) for f in found)[keep - 1]
        for j in range(max(i, bisect_left(negative, -left)), len(lengths)):
            if left - tails[j] >= worst[0]:
                return
            n = lengths[j]
            for k in range(min(have[n], left // n), 0, -1):
                walk(j + 1, left - n * k, [*parts, (n, k)])
                if seen[0] > steps or worst[0] == 0:
                    return

    if lengths:
        walk(0, room, [])
    return sorted(found, key=lambda f: (waste(f, capacity), [-n for n, k in f for _ in range(k)]))[:keep]


def _take(counts: dict[int, int], filling: Filling, times: int = 1) -> None:
    for n, k in filling:
        counts[n] -= k * times
        if not counts[n]:
            del counts[n]


def complete(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Sequences by the best completion of the longest piece left, as often as the counts allow."""
    counts, out = dict(counts), []
    while counts:
        f = completions(counts, capacity)[0]
        times = min(counts[n] // k for n, k in f)
        _take(counts, f, times)
        out.append((f, times))
    return out


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    counts, out = dict(counts), []
    while counts:
        top = max(counts)
        f = best_fit(counts, capacity - top, top)
        times = min(counts[n] // k for n, k in f)
        _take(counts, f, times)
        out.append((f, times))
    return out


def _search(counts: dict[int, int], capacity: int, incumbent: int, nodes: int = SEARCH_NODES) -> list[Filling] | None:
    """Fewer than incumbent sequences for these counts, by branch and bound over completions; None if none was found."""
    total = sum(n * k for n, k in counts.items())
    best: list = [incumbent, None]
    goal, seen = lower_bound(counts, capacity), [0]

    def walk(left: dict, used: list, wasted: int) -> None:
        seen[0] += 1
        if seen[0] > nodes or best[0] <= goal:
            return
        if not left:
            if len(used) < best[0]:
                best[:] = [len(used), list(used)]
            return
        # the waste that still lets this beat the incumbent
        if wasted > (best[0] - 1) * capacity - total or len(used) + lower_bound(left, capacity) >= best[0]:
            return
        for f in completions(left, capacity, keep=4, steps=400):
            rest = dict(left)
            _take(rest, f)
            walk(rest, [*used, f], wasted + waste(f, capacity))

    walk(dict(counts), [], 0)
    return best[1]


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Patterns (filling, how many sequences) that hold all pieces, in as few sequences as were found.

    Incumbents are the best-fit packing and the greedy bin completion; where
    they miss the lower bound, the last sequences are packed anew by branch and
    bound.  Lengths must be from 1 to capacity.
    """
    counts = {int(n): int(k) for n, k in counts.items() if k}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece's length must be from 1 to the capacity")
    used = lambda p: sum(k for _, k in p)
    best = min((complete(counts, capacity), best_fit_decreasing(counts, capacity)), key=used)
    if used(best) > lower_bound(counts, capacity):
        for last in (8, 16, 32):
            kept, rest, n = list(best), Counter(), 0
            while kept and n < last:
                f, k = kept.pop()
                take = min(k, last - n)
                if k > take:
                    kept.append((f, k - take))
                for length, m in f:
                    rest[length] += m * take
                n += take
            better = _search(dict(rest), capacity, n)
            if better is not None:
                best = kept + [(f, k) for f, k in Counter(better).items()]
                if used(best) <= lower_bound(counts, capacity):
                    break
    return best


def slots(patterns: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, copies in a sequence, offset of the first copy), by length and rank."""
    out, sequence, rank = [], 0, Counter()
    for filling, times in patterns:
        offset = 0
        for n, k in filling:
            out.append((n, rank[n], times * k, sequence, k, offset))
            rank[n] += times * k
            offset += n * k
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def place(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece of each length and rank."""
    order = np.lexsort((rank, length))
    at = np.empty(len(length), dtype=np.int64)
    # both sides sorted by (length, rank): the last slot row that does not begin after the piece
    both = np.concatenate([table[:, 0], length[order]]), np.concatenate([table[:, 1], rank[order]]), np.concatenate([np.zeros(len(table), dtype=np.int64), np.ones(len(length), dtype=np.int64)])
    merged = np.lexsort((both[2], both[1], both[0]))
    row = np.cumsum(merged < len(table)) - 1
    mine = merged >= len(table)
    at[order[merged[mine] - len(table)]] = row[mine]
    t = table[at] if len(at) else np.empty((0, 6), dtype=np.int64)
    nth = rank - t[:, 1]
    return t[:, 3] + nth // np.maximum(t[:, 4], 1), t[:, 5] + (nth % np.maximum(t[:, 4], 1)) * length


# ASCII marks at which a letter run surely ends or begins for the tokenizer; the apostrophe and the marks of special tokens are not among them.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_SLOTS = 1 << 22


# The normalizer and the split of tokenizers that take a text piece by piece as they take it whole.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_words(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its pieces, one after another."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (split.get("pretokenizers") or [{}])[0]
    added = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens") or [])
    return normal.get("normalizers") == _NORMALIZER and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and bool(first.get("invert")) and added


class Encoder:
    """Token ids of whole texts, a distinct piece of text at a time.

    A piece is a word, cut where an ASCII letter meets a mark.  This is exact for
    tokenizers that lower-case, drop ASCII white space and cut there too before
    they merge, as word_bpe_49k.json does; tests check it against whole texts.
    Other tokenizers get whole texts.  Ids of up to CACHE_WORDS pieces are kept
    between batches.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.by_piece = cuts_at_words(json.loads(self.model.to_str()))
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(_SLOTS, dtype=np.int32)
        self.known = 1  # row 0 is no piece
        self.used = 0
        self.keys = np.zeros(1 << 16, dtype=np.uint64)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.many = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.empty(1 << 18, dtype=np.uint32)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one longer than texts)."""
        if not self.by_piece:
            found = self.model.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            ids = [np.array(x.ids, dtype=np.uint32) for x in found]
            return np.concatenate([np.empty(0, dtype=np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        w = _pieces(words.split(texts))
        hashes = w.hashes()
        if self.known > CACHE_WORDS:
            self._clear()
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        row = self.slots[slot]
        missing = np.flatnonzero(self.keys[row] != hashes)
        if len(missing):
            keys, at, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, s, e = w.data.tobytes(), w.starts[missing[at]].tolist(), w.ends[missing[at]].tolist()
            tokens = []
            for i in range(0, len(s), ENCODED_AT_ONCE):
                some = [raw[a:b].decode("utf-8") for a, b in zip(s[i : i + ENCODED_AT_ONCE], e[i : i + ENCODED_AT_ONCE], strict=True)]
                tokens += [array("I", x.ids) for x in self.model.encode_batch_fast(some, add_special_tokens=False)]
            row[missing] = self._add(keys, tokens)[which.reshape(-1)]
        begin, n = self.begin[row], self.many[row]
        grown = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n)])
        ids = self.ids[np.arange(grown[-1]) + np.repeat(begin - grown[:-1], n)]
        return ids, grown[w.ptr]

    def _add(self, keys: np.ndarray, tokens: list) -> np.ndarray:
        n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        size, rows = int(n.sum()), np.arange(self.known, self.known + len(keys))
        while self.known + len(keys) > len(self.keys):
            self.keys, self.begin, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.begin, self.many))
        while self.used + size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + size] = np.fromiter(chain.from_iterable(tokens), dtype=np.uint32, count=size)
        self.keys[rows], self.many[rows], self.begin[rows] = keys, n, self.used + np.cumsum(n) - n
        self.slots[(keys & np.uint64(_SLOTS - 1)).astype(np.int64)] = rows
        self.known, self.used = self.known + len(keys), self.used + size
        return rows


def _pieces(w: words.Words) -> words.Words:
    """Words cut between an ASCII letter and a mark; A-Z lower-cased, unless some text may hold a special token."""
    d = w.data
    mark, letter = _MARKS[d], _LETTERS[d]
    first, last = np.zeros(len(d) + 1, dtype=bool), np.zeros(len(d) + 1, dtype=bool)
    first[1:-1] = last[1:-1] = (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
    first[w.starts] = last[w.ends] = True
    # the cuts between texts are no word's end and no word's start unless they were
    inner = w.offsets[1:-1]
    was_first, was_last = np.zeros_like(first), np.zeros_like(last)
    was_first[w.starts] = was_last[w.ends] = True
    first[inner], last[inner] = was_first[inner], was_last[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    special = bool(np.any((d[1:] == ord("|")) & (d[:-1] == ord("<"))))
    return words.Words(d if special else words.LOWER[d], starts, ends, np.searchsorted(starts, w.offsets), w.offsets)


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it has learned serves its next tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, task, nth) for each piece of each document.

    A document is its token ids and then end_id; one longer than capacity is cut
    into pieces of capacity, the last of what is left.  nth is the piece's rank
    among those of its length that the task made.
    """
    store.ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *[T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.BinaryType()), ("task", T.IntegerType()), ("nth", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            encode = encoder(tokenizer_path)
            for part in words.blocks(batch, "text", 2 << 20):
                ids, ptr = encode(part.column(1))
                total = np.diff(ptr) + 1
                many = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), many)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = nth * capacity
                length = np.minimum(total[row] - start, capacity)
                crc, kept = [], []
                little = ids.astype("<u4")
                for d, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                    a = ptr[d] + s
                    b = min(a + n, ptr[d + 1])
                    raw = little[a:b].tobytes() + (np.full(n - (b - a), end_id, dtype="<u4").tobytes())
                    crc.append(zlib.crc32(raw))
                    kept.append(raw if with_ids else None)
                order = np.argsort(length, kind="stable")
                sizes, first, times = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), dtype=np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, times) + np.repeat(seen[sizes], times)
                seen[sizes] += times
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64()), pa.array(kept, type=pa.binary()), pa.array(np.full(len(row), task, dtype=np.int32)), pa.array(rank)], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset) for each piece.

    Each sequence is filled from 0 without a gap and holds capacity tokens at
    most.  A null or empty text is the document of end_id alone.  Rows that
    repeat an id are documents of their own.  Other columns are ignored, whatever
    their names.  An empty table gives no rows.  ids (little-endian unsigned
    32-bit) is null unless with_ids.
    """
    spark = docs.sparkSession
    cut = store.materialise(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # ranks: pieces of a length that earlier tasks made come first
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = store.materialise(counts.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(pack_counts(histogram, capacity))
    shared = spark.sparkContext.broadcast(table)  # a few rows for each pattern, of which there are a few for each length
    ranked = cut.join(offsets.select("length", "task", "before"), ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", "ids", (F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(batch.column(3).to_numpy(), batch.column(6).to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
