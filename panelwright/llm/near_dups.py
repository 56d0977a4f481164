"""Near duplicates by MinHash with tensored bands, confirmed on full sets.

Two small collections, U and V, hold b keys each, a key being r minhashes of its
own.  Table (i, j) is keyed by the pair of key i of U and key j of V, so b squared
tables cost 2 * b * r minhashes, not r times 2 * b squared.  Two sets of
similarity s meet in some table unless all of U or all of V miss, with
probability 1 - (1 - s^r)^b each.  b * r is given; r is chosen by the similarity
asked for, 3 at 0.8 and less where that would miss pairs.

The pair key is looked up in two steps: sets meet by a key of U, and among those
by the keys of V, which travel with them, 8 bits of each minhash.  Keys are counted
exactly.  Where more than FREQUENT_LEAST sets have a key of U, they meet by the
whole pair key at once; where more than MEET have that too, in three steps:

* each set is compared in full with one centre, a smallest set under one of its
  crowded pair keys, so a family of near copies becomes one class by about as
  many comparisons as it has sets;
* where a pair key still has sets of several classes, the largest class is one
  side, in blocks, and all others another, and only blocks that differ meet, once
  for all keys of that class;
* what is in one class already is never compared again.

What meets is weighed by the bits of all minhashes, and a spanning forest of what
may link is kept.  The sets of a tree are compared in full, and those of a large
tree in pairs of blocks, only where a block's sets have candidates in the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs, store, words
from .components import components, forest

SHINGLE = 5
SIMILARITY = 80  # percent
N = 72  # minhashes
MISSED = 0.001  # of pairs just similar enough, the part at most that may share no table
PASSED_OVER = 1e-6  # and, about, the part that may agree in too few minhashes
BLOCK = 512  # sets of a block of a large tree, at most about
BLOCK_SHINGLES = 500_000  # and shingles of its sets
TASK_BYTES = 8 << 20
FREQUENT_LEAST = 128  # sets that meet by one key of U, at most; this and MEET decide how sets are dealt out, not what is found
MEET = 512  # sets that meet by one pair key, at most
CENTRES = 3  # rounds in which crowded sets look for a centre
LOOKED_AT = 4  # of its crowded keys, in each round
SALT = 16
EDGES = 1 << 18  # candidates that a task holds before they go into its forest

_MULTIPLY = words.mix(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = words.mix(np.arange(1001, 1001 + N, dtype=np.uint64))

SKETCH = np.dtype([("key", "<u8"), ("rep", "<i8"), ("label", "<i8"), ("blocks", "<u4"), ("low", "u1", (N,))])


@dataclass(frozen=True)
class Tables:
    """Keys of U and of V, how many minhashes each is of, and how many of all minhashes must agree."""

    bands: int
    rows: int
    least_agree: int

    @cached_property
    def packed(self) -> np.dtype:
        return np.dtype([("keys", "<u8", (self.bands,)), ("low", "u1", (N,))])


def tables_for(similarity: float) -> Tables:
    """The longest keys by which pairs of that similarity, in percent, meet; an error where none are short enough."""
    s = similarity / 100
    if not s <= 1:
        raise ValueError("similarity is in percent, 100 at most")
    for rows in (3, 2, 1):
        bands = N // (2 * rows)
        if 1 - (1 - (1 - s**rows) ** bands) ** 2 <= MISSED:
            fewer, least = 0.0, 0
            while least < N and round((fewer := fewer + comb(N, least) * s**least * (1 - s) ** (N - least)) / PASSED_OVER) <= 1:
                least += 1
            return Tables(bands, rows, least)
    raise ValueError(f"{N} minhashes do not find pairs of a similarity of {similarity} percent; 20 is enough")


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, all in one array, and where each text's begin.

    A text of fewer than k words has its whole sequence as its shingle; one
    without words has none.
    """
    w = words.split(texts, words.SPACED, lower=True)
    h, counts = w.hashes(), w.counts
    whole = words.windows(h, k)[words.inside(w.ptr, k)]
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    short = [(n, d) for n in range(1, k) if len(d := np.flatnonzero(counts == n))]
    if short:
        whole = np.concatenate([whole, *(words.windows(h, n, salt=n)[w.ptr[d]] for n, d in short)])
        doc = np.concatenate([doc, *(d for _, d in short)])
    order = np.lexsort((whole, doc))
    whole, doc = whole[order], doc[order]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
    return whole[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def sketch(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """N minhashes of each set that is not empty."""
    first = ptr[:-1][np.diff(ptr) > 0]
    out = np.empty((len(first), N), dtype=np.uint64)
    if not len(first):
        return out
    with np.errstate(over="ignore"):
        for i in range(N):
            x = (sets ^ _XOR[i]) * _MULTIPLY[i]
            x ^= x >> np.uint64(32)
            out[:, i] = np.minimum.reduceat(x, first)
    return words.mix(out)


def set_digest(sets: np.ndarray, ptr: np.ndarray) -> list[bytes]:
    """128 bits that name each set: two sums of its mixed hashes."""
    full = np.diff(ptr) > 0
    out = np.zeros((len(full), 2), dtype=np.uint64)
    if full.any():
        with np.errstate(over="ignore"):
            for i in range(2):
                out[full, i] = np.add.reduceat(words.mix(sets ^ np.uint64(0xA5A5A5A5 + i)), ptr[:-1][full])
    return [x.tobytes() for x in out]


def packed(hashes: np.ndarray, t: Tables) -> list[bytes]:
    """Of each row of minhashes the keys of U, and the low bits of all."""
    r = t.rows
    keys = np.stack([words.windows(hashes[:, r * i : r * (i + 1)].reshape(-1), r, salt=i)[::r] for i in range(t.bands)], axis=1)
    out = np.empty(len(hashes), dtype=t.packed)
    out["keys"], out["low"] = keys, (hashes & np.uint64(255)).astype(np.uint8)
    return [x.tobytes() for x in out]


def _sketches(k: int, t: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, "text", 1 << 20):
                sets, ptr = shingle_sets(part.column(1), k)
                n = np.diff(ptr)
                low = np.full(len(n), None, dtype=object)
                if (n > 0).any():
                    low[n > 0] = packed(sketch(sets, ptr), t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(set_digest(sets, ptr), type=pa.binary()), pa.array(low.tolist(), type=pa.binary())], names=["id", "n_shingles", "digest", "sketch"])

    return run


def pair_keys(u: np.ndarray, low: np.ndarray, t: Tables) -> np.ndarray:
    """Keys of the tables (i, j) for one i: the key of U with each key of V, a column for each j."""
    v = low[:, N // 2 :].reshape(len(low), t.bands, t.rows).astype(np.uint64)
    number = np.arange(1, t.bands + 1, dtype=np.uint64)
    for r in range(t.rows):
        number = number * np.uint64(256) + v[:, :, r]
    with np.errstate(over="ignore"):
        return words.mix(u[:, None] ^ words.mix(number))


def _read(column, t: Tables) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=t.packed) for x in column]) if len(column) else np.empty(0, dtype=t.packed)


def _pairs_of(x: np.ndarray, hot: blobs.Members, t: Tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each key of U the rows that have it frequent, and their pair keys under it, a row of keys for each."""
    for i in range(t.bands):
        rows = np.flatnonzero(hot(x["keys"][:, i]))
        if len(rows):
            yield rows, pair_keys(x["keys"][rows, i], x["low"][rows], t)


def frequent_keys(reps: DataFrame, t: Tables) -> tuple[blobs.Members, blobs.Members]:
    """The keys of U that more than FREQUENT_LEAST sets have, and the pair keys under those that more than MEET have."""
    buckets = store.buckets_for(reps, TASK_BYTES)

    def counted(keys) -> blobs.Members:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = blobs.Counts(buckets)
            for batch in batches:
                for k in keys(_read(batch.column(0), t)):
                    yield from _plain(counts.add(k))
            yield from _plain(counts.flush())

        return run

    def often(keys, most: int) -> blobs.Members:
        found = blobs.more_than(reps.select("sketch").mapInArrow(counted(keys), blobs.SCHEMA + ", all int"), most, by="all")
        return blobs.members(store.materialise(found, "frequent-keys"), "h")

    hot = often(lambda x: [x["keys"].reshape(-1)], FREQUENT_LEAST)
    if not len(hot):
        return hot, hot
    return hot, often(lambda x: (pair.reshape(-1) for _, pair in _pairs_of(x, hot, t)), MEET)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, dtype=np.int32))], names=[*b.schema.names, "all"])


def _crowd(frequent, t: Tables):
    """(rep, n, keys) for each set with crowded pair keys: these, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, crowded = frequent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rep = _read(batch.column(1), t), batch.column(0).to_numpy()
            key, row = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for rows, pair in _pairs_of(x, hot, t):
                at, j = np.nonzero(crowded(pair))
                key.append(pair[at, j])
                row.append(rows[at])
            key, row = np.concatenate(key).view(np.int64), np.concatenate(row)
            order = np.lexsort((key, row))
            own = np.unique(row)
            ends = np.append(np.searchsorted(row[order], own), len(row)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), batch.column(2).take(pa.array(own)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order]))], names=["rep", "n", "keys"])

    return run


def _send(key: np.ndarray, rows: np.ndarray, batch: pa.RecordBatch, low: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Records of the batch's rows (rep, label, blocks) by key."""
    rep, label, blocks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rep", "label", "blocks"))
    for c in range(0, len(key), 1 << 16):
        k, r = key[c : c + (1 << 16)], rows[c : c + (1 << 16)]
        out = np.empty(len(k), dtype=SKETCH)
        out["key"], out["rep"], out["label"], out["blocks"], out["low"] = k, rep[r], label[r], blocks[r], low[r]
        yield from blobs.send((k % np.uint64(buckets)).astype(np.int64), out)


def _to_bands(buckets: int, frequent, t: Tables):
    """A record for each key that sets meet by, but for crowded pair keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, crowded = frequent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _read(batch.column(batch.schema.get_field_index("sketch")), t)
            for i in range(t.bands):
                u = x["keys"][:, i]
                rows = np.flatnonzero(~hot(u))
                yield from _send(u[rows], rows, batch, x["low"], buckets)
            for rows, pair in _pairs_of(x, hot, t):
                at, j = np.nonzero(~crowded(pair))
                yield from _send(pair[at, j], rows[at], batch, x["low"], buckets)

    return run


def _to_blocks(buckets: int, t: Tables):
    """A record for each pair of blocks of a crowded key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _read(batch.column(batch.schema.get_field_index("sketch")), t)
                key = batch.column(batch.schema.get_field_index("group")).to_numpy().view(np.uint64)
                yield from _send(key, np.arange(len(x)), batch, x["low"], buckets)

    return run


def _candidates(records: np.ndarray, t: Tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of records, two and two, that share a table's key, agree in enough minhashes and are not of one class yet; records are sorted by key."""
    key = records["key"]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, dtype=np.int64)
    sizes = np.diff(cut)
    for s, n in zip(cut[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        low, label = records["low"][s : s + n], records["label"][s : s + n]
        if (label == label[0]).all():
            continue
        # among sets that share a key of U, those that share a key of V: its minhashes' bits in order
        v = low[:, N // 2 :].reshape(n, t.bands, t.rows)
        if n <= 64:
            ia, ib = np.triu_indices(n, 1)
            ok = (label[ia] != label[ib]) & (v[ia] == v[ib]).all(2).any(1)
            ia, ib = ia[ok], ib[ok]
            ok = (low[ia] == low[ib]).sum(1) >= t.least_agree
            yield s + ia[ok], s + ib[ok]
            continue
        for p in range(0, n, 256):
            for q in range(p, n, 256):
                x, y = low[p : p + 256], low[q : q + 256]
                same = np.zeros((len(x), len(y)), dtype=np.uint8)
                for c in range(N):
                    same += x[:, c][:, None] == y[:, c]
                ia, ib = np.nonzero((same >= t.least_agree) & (label[p : p + 256][:, None] != label[q : q + 256]))
                ia, ib = ia + p, ib + q
                ok = ia < ib
                ia, ib = ia[ok], ib[ok]
                for w in range(0, len(ia), 1 << 16):
                    i, j = ia[w : w + (1 << 16)], ib[w : w + (1 << 16)]
                    ok = (v[i] == v[j]).all(2).any(1)
                    yield s + i[ok], s + j[ok]


def _meet(t: Tables):
    """Edges of a spanning forest of what may link, one forest for all keys of the bucket; its roots are the smallest ids, so that buckets give equal edges."""

    def run(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.argsort(records["key"], kind="stable")]
        ids, of = np.unique(records["rep"], return_inverse=True)
        of, root = of.reshape(-1), np.arange(len(ids))
        held, size = [], 0
        for i, j in chain(_candidates(records, t), [(None, None)]):
            if i is not None and len(i):
                held.append((of[i], of[j]))
                size += len(i)
            if held and (i is None or size > EDGES):
                a, b = (root[np.concatenate(x)] for x in zip(*held, strict=True))
                root = forest(len(ids), a, b)[root]
                held, size = [], 0
        child = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[child]]), pa.array(ids[child])], names=["a", "b"])

    return run


def _block(rep: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (words.mix(rep.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)


def _beside(t: Tables):
    """(rep, block, other): the blocks of its tree in which a set has candidates, its own block beside them."""

    def run(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.argsort(records["key"], kind="stable")]
        block = _block(records["rep"], records["blocks"])
        found = [np.empty((0, 3), dtype=np.int64)]
        for i, j in _candidates(records, t):
            rep = np.concatenate([records["rep"][i], records["rep"][j]])
            found.append(np.unique(np.stack([rep, np.concatenate([block[i], block[j]]), np.concatenate([block[j], block[i]])], axis=1), axis=0))
        made = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[:, c])) for c in range(3)], names=["rep", "block", "other"])

    return run


def _compare(sets: list[np.ndarray], left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that are similar enough, the first of each among the first left sets (all pairs if left is all), by their shared elements."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    new = np.concatenate([[True], element[1:] != element[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    both = np.zeros((left, n), dtype=np.float32)
    width = 4096
    for c in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        both += m[:left] @ m.T
    both = both.astype(np.int64)
    union = sizes[:left, None] + sizes[None, :] - both
    ia, ib = np.nonzero(100 * both >= percent * union)
    ok = ia < ib
    return ia[ok], ib[ok]


def _confirm(k: int, percent: int):
    """Links of the sets of each tree, or of two blocks of a large tree, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        table = table.sort_by([("tree", "ascending"), ("pair", "ascending"), ("block", "ascending"), ("rep", "ascending")])
        tree, pair, rep = (table.column(c).to_numpy() for c in ("tree", "pair", "rep"))
        block = table.column("block").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (pair[1:] != pair[:-1]), [True]])) if len(tree) else np.zeros(1, dtype=np.int64)
        texts = table.column("text")
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            part = texts.slice(s, e - s)
            sets, ptr = shingle_sets(part, k)
            each = [sets[ptr[i] : ptr[i + 1]] for i in range(e - s)]
            # block pairs (p, q), p < q: only p with q; within a block: all
            first = int((block[s:e] == block[s]).sum())
            left = first if first < e - s else e - s
            ia, ib = _compare(each, left, percent)
            if left < e - s:
                ok = ib >= left
                ia, ib = ia[ok], ib[ok]
            root = forest(int(e - s), ia, ib)
            child = np.flatnonzero(root != np.arange(e - s))
            out_a.append(rep[s:e][root[child]])
            out_b.append(rep[s:e][child])
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_a, out_b))
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run


def _blocks_for(n: str) -> Column:
    """Into how many blocks sets of n shingles each are dealt."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(n) / BLOCK_SHINGLES)).cast("int")


def _by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined to the one row that facts has for each key; a frequent key's rows are dealt to SALT places."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _classes(crowd: DataFrame, confirm) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of crowded sets (rep, n, keys) with centres, and (rep, label) of the classes that they make.

    A round's centres are the smallest sets under each key, looked for under a
    set's first LOOKED_AT keys; a set takes the one that it shares most of them
    with.  The next round is for sets that lie in no key's largest class.
    """
    linked, labels, rest = None, None, crowd
    for nth in range(CENTRES):
        few = rest.select("rep", "n", F.explode(F.slice("keys", 1 + nth, LOOKED_AT)).alias("key"))
        centre = _by_key(few, few.groupBy("key").agg(F.min("rep").alias("centre")))
        of_set = F.collect_list("centre").alias("all")
        most = F.array_max(F.transform("all", lambda c: F.struct(F.size(F.filter("all", lambda x: x == c)).alias("n"), (-c).alias("back"))))
        best = centre.groupBy("rep").agg(of_set, F.first("n").alias("n")).withColumn("best", most)  # LOOKED_AT centres a set at most
        star = best.select((-F.col("best.back")).alias("centre"), "rep", "n").where("centre <> rep")
        star = store.materialise(star, "stars", of=crowd)
        sizes = star.groupBy("centre").agg(_blocks_for("n").alias("parts"))
        star = star.join(sizes, "centre").select("rep", F.col("centre").alias("tree"), F.pmod(F.xxhash64("rep"), "parts").alias("pair"), F.lit(1).cast("long").alias("block"))
        middle = sizes.select(F.col("centre").alias("rep"), F.col("centre").alias("tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("pair"), F.lit(0).cast("long").alias("block"))
        new = confirm(store.materialise(star.unionByName(middle), "star-sets", of=crowd))
        linked = store.materialise(new if linked is None else linked.unionByName(new), "centre-links")
        labels = store.materialise(components(linked).select(F.col("node").alias("rep"), F.col("component").alias("label")), "classes")
        if nth < CENTRES - 1:
            by, mixed = _mixed(_labelled(crowd, labels), crowd)
            others = by.join(mixed, "key").where("label <> top").select("label").distinct()
            rest = store.materialise(_labelled(crowd, labels).join(others, "label", "left_semi").select("rep", "n", "keys"), "no-centre-yet", of=crowd)
            if rest.isEmpty():
                break
    return linked, labels


def _labelled(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    return crowd.join(labels, "rep", "left").select("rep", "n", "keys", F.coalesce("label", "rep").alias("label"))


def _mixed(named: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, label, n) of all keys, and (key, top, n_top), the largest class, of those under which sets of several classes lie."""
    by = store.materialise(named.select("label", F.explode("keys").alias("key")).groupBy("key", "label").agg(F.count("*").alias("n")), "key-classes", of=crowd)
    mixed = by.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
    return by, store.materialise(mixed.select("key", F.col("most.label").alias("top"), F.col("most.n").alias("n_top")), "mixed-keys", of=crowd)


def _differing(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, group): the pairs of blocks by which sets meet that share mixed keys.

    A key's sets meet at its largest class, once however many keys they share:
    those of the class are one side, all others another.  Two blocks of the class
    meet nowhere.  Where the class's sets lie under many mixed keys, all of it is
    taken, rather than looked up by each key.
    """
    named = _labelled(crowd, labels)
    by, mixed = _mixed(named, crowd)
    members = named.groupBy(F.col("label").alias("top")).agg(F.count("*").alias("members"))
    load = store.materialise(mixed.groupBy("top").agg(F.sum("n_top").alias("load")).join(members, "top"), "mixed-load", of=crowd)
    tops = named.withColumn("top", F.col("label")).join(load, "top")
    whole = tops.where("members <= 4 * load").select("top", "rep", "label")
    keyed = _by_key(tops.where("members > 4 * load").select("rep", "label", F.explode("keys").alias("key")), mixed).where("label = top")
    others = by.join(mixed, "key").where("label <> top").select("label").distinct()
    rests = _by_key(named.join(others, "label").select("rep", "label", F.explode("keys").alias("key")), mixed).where("label <> top")
    rows = store.materialise(whole.unionByName(keyed.unionByName(rests).select("top", "rep", "label").distinct()), "mixed-sets", of=crowd)

    own = F.col("label") == F.col("top")
    counts = rows.groupBy("top").agg(*[F.ceil(F.sum(side.cast("long")) / MEET).alias(c) for side, c in ((own, "tops"), (~own, "rests"))])
    rows = _by_key(rows.select(F.col("top").alias("key"), "rep", own.alias("own")), counts.withColumnRenamed("top", "key"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("tops")).otherwise(F.col("rests"))).cast("long")
    rows = rows.withColumn("mine", mine)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_rest = F.transform(upto("rests"), lambda b: F.when(F.col("own"), F.xxhash64("key", F.lit("top"), b, "mine")).otherwise(F.xxhash64("key", F.lit("rest"), F.least(b, "mine"), F.greatest(b, "mine"))))
    with_top = F.when(F.col("own"), F.array().cast("array<bigint>")).otherwise(F.transform(upto("tops"), lambda c: F.xxhash64("key", F.lit("top"), "mine", c)))
    return store.materialise(rows.select("rep", F.explode(F.concat(with_rest, with_top)).alias("group")), "mixed-blocks")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z
    lower-cased; a document's set is its distinct shingles of so many words, or
    its whole sequence if that is shorter.  Documents are linked if the
    intersection of their sets is similarity percent of the union or more;
    component_id is the smallest id that links lead to, its own included, and
    kept says whether that is its own.

    Documents without words, null texts too, have an empty set and are linked
    with nothing.  Rows that repeat an id are one node: their links are joined.
    A null id gets null for component_id and is kept.  Ids are whole numbers,
    else a TypeError.  Other columns are ignored, whatever their names; an empty
    table gives no rows.

    Of pairs just similar enough one in 1,000 at most is not compared (at 80: 4
    in 10,000), of others fewer.  Below 78 keys are shorter, so that more sets
    meet; a similarity of less than 20 is an error.
    """
    t = tables_for(similarity)
    store.whole_number_ids(docs, id_col)
    spark = docs.sparkSession
    store.ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = source.mapInArrow(_sketches(shingle, t), "id long, n_shingles long, digest binary, sketch binary")
    made = store.materialise(made, "sketches")
    full = made.where("n_shingles > 0 and id is not null")
    # equal sets are one from here on
    reps = store.materialise(full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")), "sets", of=made)
    buckets = store.buckets_for(reps, TASK_BYTES // 8)
    found = frequent_keys(reps, t)
    frequent = spark.sparkContext.broadcast(found)  # tables of bits of a bounded size
    groups = store.buckets_for(docs.select(F.col(text_col)), TASK_BYTES)
    texts = source.where("id is not null").withColumnRenamed("id", "rep")

    def confirm(sets: DataFrame) -> DataFrame:
        """Links among sets (rep, tree, pair, block): those of a tree and pair are compared, one block with the other where there are two."""
        # one text of each set
        joined = texts.join(sets.hint("merge"), "rep").withColumn("bucket", F.pmod(F.xxhash64("tree", "pair"), F.lit(4 * groups)))
        rows = store.dealt(joined.select("bucket", "rep", "tree", "pair", "block", "text"), "bucket", docs.select(F.col(text_col)), always=True)
        return rows.groupBy("bucket").applyInArrow(_confirm(shingle, similarity), "a long, b long")

    named, blocked, linked = reps.withColumn("label", F.col("rep")), None, None
    if len(found[1]):
        crowd = store.materialise(reps.select("rep", "sketch", "n").mapInArrow(_crowd(frequent, t), "rep long, n long, keys array<long>").where(F.size("keys") > 0), "crowd")
        linked, labels = _classes(crowd, confirm)
        named = store.materialise(reps.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
        blocked = _differing(crowd, labels)

    def meet(sets: DataFrame, work, schema: str) -> DataFrame:
        """What is made of the records that meet, of these sets (rep, label, blocks, sketch)."""
        sets = sets.select("rep", "label", "blocks", "sketch")
        bands = sets.mapInArrow(_to_bands(buckets, frequent, t), blobs.SCHEMA)
        if blocked is not None:
            both = sets.join(blocked.hint("merge"), "rep").select("group", "rep", "label", "blocks", "sketch")
            bands = bands.unionByName(both.mapInArrow(_to_blocks(buckets, t), blobs.SCHEMA))
        return blobs.each_bucket(store.dealt(bands, "bucket", docs.select(F.col(text_col))), work, SKETCH, schema)

    meets = meet(named.withColumn("blocks", F.lit(1)), _meet(t), "a long, b long")
    meets = store.materialise(meets.distinct(), "meets", of=reps)

    # what may link, as trees
    trees = components(meets).select(F.col("node").alias("rep"), F.col("component").alias("tree")).join(reps.select("rep", "n"), "rep")
    trees = store.materialise(trees, "trees")
    sizes = trees.groupBy("tree").agg(_blocks_for("n").alias("blocks"))
    sized = store.materialise(trees.join(sizes, "tree").select("rep", "tree", "blocks"), "tree-sizes", of=trees)
    pairs = sized.where("blocks = 1").select("rep", "tree", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("block"))
    large = sized.where("blocks > 1")
    if not large.isEmpty():
        # blocks of a large tree are compared only where one has candidates in the other
        beside = meet(named.join(large.select("rep", "blocks"), "rep"), _beside(t), "rep long, block long, other long").distinct()
        beside = beside.join(large, "rep")
        pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
        pairs = pairs.unionByName(beside.select("rep", "tree", pair.alias("pair"), "block"))
    links = confirm(store.materialise(pairs, "blocks", of=reps))
    if linked is not None:
        links = links.unionByName(linked)
    # an id that several sets have joins them
    several = full.groupBy("id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("id", "d")
    same = full.select("id", "digest").join(several, "id").where("d <> digest").select("d", "digest").distinct()
    name = reps.select("digest", "rep")
    same = same.join(name.select(F.col("digest").alias("d"), F.col("rep").alias("a")), "d").join(name.select("digest", F.col("rep").alias("b")), "digest").select("a", "b")
    links = store.materialise(links.unionByName(same).distinct(), "links", of=reps)
    member = components(links).withColumnRenamed("node", "rep")
    of_set = store.materialise(name.join(member, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "set-components")
    out = made.select("id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest")).join(of_set, "digest", "left")
    component = F.coalesce("component", "id")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group; all columns stay.

    Of rows that repeat an id all stay or none.  Null ids stay.
    """
    found = near_duplicates(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    gone = store.materialise(found.where("not kept").select(id_col).distinct(), "near-duplicates")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
