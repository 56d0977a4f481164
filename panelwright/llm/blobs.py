"""Numbers between tasks as packed blocks.

A record is a few numbers.  Each task sorts its records by bucket and sends one
binary block for each bucket, so that an exchange moves bytes and not rows, and
numpy takes them up without a copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket long, block binary"
MOST = 1 << 20  # bytes of a block


def send(bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of records (a structured array), by bucket."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    keys, out = [], []
    step = max(1, MOST // records.itemsize)
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        for c in range(a, b, step):
            keys.append(int(bucket[a]))
            out.append(records[c : min(c + step, b)].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(out, type=pa.binary())], names=["bucket", "block"])


def unpack(table: pa.Table, dtype: np.dtype, column: str = "block") -> np.ndarray:
    """The records of a table of blocks, those of one bucket."""
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for chunk in table.column(column).chunks for x in chunk]
    return np.concatenate(parts) if parts else np.empty(0, dtype=dtype)


def each_bucket(blocks: DataFrame, work: Callable[[np.ndarray], Iterator[pa.RecordBatch]], dtype: np.dtype, schema: str) -> DataFrame:
    """work on the records of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        made = list(work(unpack(table, dtype)))
        return pa.Table.from_batches(made) if made else empty

    empty = _empty(schema)
    return blocks.groupBy("bucket").applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.table({c: pa.array([], type=kinds[t]) for c, t in (x.strip().split(" ") for x in schema.split(","))})


class Members:
    """A set of 64-bit hashes as bits of a table of bounded size: it may tell more hashes to be in it than are, never fewer."""

    def __init__(self, bits: np.ndarray, n: int):
        self.bits, self.n = bits, n

    def __len__(self) -> int:
        return self.n

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(hashes.shape, dtype=bool)
        at = (hashes & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


MEMBER_BITS = 1 << 28  # of a table of members, at most: 32 MB
PIECE_BITS = 1 << 18


def members(hashes: DataFrame, column: str) -> Members:
    """The distinct hashes of a column of longs, which is read twice.  16 bits for each, up to MEMBER_BITS in all."""
    n = hashes.count()
    if not n:
        return Members(np.zeros(1, dtype=np.uint8), 0)
    bits = PIECE_BITS
    while bits < min(MEMBER_BITS, 16 * n):
        bits *= 2

    def piece(table: pa.Table) -> pa.Table:
        flags = np.zeros(PIECE_BITS, dtype=np.uint8)
        flags[table.column("at").to_numpy() % PIECE_BITS] = 1
        packed = np.packbits(flags, bitorder="little").tobytes()
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([packed], type=pa.binary())})

    at = hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()
    made = at.withColumn("piece", F.shiftright("at", PIECE_BITS.bit_length() - 1)).groupBy("piece").applyInArrow(piece, "piece long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in made.collect():  # MEMBER_BITS at most
        out[r["piece"] * (PIECE_BITS // 8) : (r["piece"] + 1) * (PIECE_BITS // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Members(out, n)


COUNT = np.dtype([("h", "<u8"), ("n", "<u4")])


class Counts:
    """How often a task met each hash, sent on whenever it holds many."""

    def __init__(self, buckets: int, most: int = 1 << 18):
        self.buckets, self.most, self.parts, self.size = buckets, most, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(hashes):
            self.parts.append(hashes)
            self.size += len(hashes)
        if self.size > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h = np.sort(np.concatenate(self.parts))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        out = np.empty(len(first), dtype=COUNT)
        out["h"], out["n"] = h[first], np.diff(np.append(first, len(h)))
        self.parts, self.size = [], 0
        yield from send((out["h"] % np.uint64(self.buckets)).astype(np.int64), out)


def more_than(counts: DataFrame, most: int, by: str) -> DataFrame:
    """(by, h): the hashes that all tasks together met more than so many times, exactly counted, for each value of by."""

    def run(table: pa.Table) -> pa.Table:
        records = unpack(table, COUNT)
        records = records[np.argsort(records["h"], kind="stable")]
        h = records["h"]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
        n = np.add.reduceat(records["n"].astype(np.int64), first) if len(first) else first
        found = h[first[n > most]].view(np.int64)
        return pa.table({by: pa.array(np.full(len(found), table.column(by)[0].as_py(), dtype=np.int32)), "h": pa.array(found)})

    return counts.groupBy(by, "bucket").applyInArrow(run, f"{by} int, h long")
