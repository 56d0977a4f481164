"""Words of whole texts, by numpy, over Arrow batches.

A batch's texts stay one byte buffer.  Every byte of a multi-byte UTF-8
character is 0x80 or more, so the word classes used here can be told byte by
byte.  Equal words have equal 64-bit hashes whatever batch they are in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 18  # bytes hashed at a time, but for a longer word

# The separators of a class are the bytes named here.
_SPACE = [0x20, *range(0x09, 0x0E)]
_NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def _mask(separators: list[int]) -> np.ndarray:
    m = np.ones(256, dtype=bool)
    m[separators] = False
    return m


SPACED = _mask(_SPACE)
ALNUM = _mask(_NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix one); a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25 | 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = powers(_BASE, CHUNK), powers(_INVERSE, CHUNK)


@dataclass
class Words:
    """Words of a batch of texts.

    data: the bytes (lower-cased if asked for); starts, ends: of each word in
    data; ptr: word index at which each text begins, one longer than the batch.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: its bytes as a polynomial, from running sums over a chunk of text."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            low = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            high = int(self.ends[b - 1])
            up, down = (_UP, _DOWN) if high - low <= CHUNK else (powers(_BASE, high - low), powers(_INVERSE, 1))
            grown = np.empty(high - low + 1, dtype=np.uint64)
            grown[0] = 0
            with np.errstate(over="ignore"):
                x = _BYTE[self.data[low:high]]
                x *= up[: high - low]
                np.cumsum(x, out=grown[1:])
                s, e = self.starts[a:b] - low, self.ends[a:b] - low
                h = grown[e]
                h -= grown[s]
                h *= down[s]
                out[a:b] = h + (e - s).astype(np.uint64) * U(0x632BE59BD9B4E019)
            a = b
        return mix(out)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, each with one space after it, and where each begins (one longer than the words)."""
        n = self.ends - self.starts
        first = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n)])
        at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(self.starts, n)
        out = np.full(first[-1] + len(n), 0x20, dtype=np.uint8)
        out[np.arange(first[-1]) + np.repeat(np.arange(len(n)), n)] = self.data[at]
        return out.tobytes(), first + np.arange(len(first))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :] if len(texts) else np.zeros(1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if hi > lo else np.empty(0, dtype=np.uint8)
    return raw, offsets - lo


def split(texts: pa.Array | pa.ChunkedArray, word: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of every text: maximal runs of bytes that word marks."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    m = word[data]
    before = np.empty_like(m)
    after = np.empty_like(m)
    if len(m):
        before[0], before[1:] = False, m[:-1]
        after[-1], after[:-1] = False, m[1:]
        inner = offsets[(offsets > 0) & (offsets < len(m))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def windows(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each k consecutive values; one entry for each start, len - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = U(0xD6E8FEB86659FD93 + 2 * salt)
    with np.errstate(over="ignore"):
        h = np.full(n, 0x2545F4914F6CDD1D + salt, dtype=np.uint64)
        for j in range(k):
            h *= base
            h += values[j : j + n]
    return mix(h)


def inside(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which of the window starts of windows() lie, with all k words, in one text."""
    n = int(ptr[-1]) - k + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    left = np.repeat(ptr[1:], np.diff(ptr))[:n] - np.arange(n)
    return left >= k


def blocks(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in slices of about most bytes of text each, at least a row."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(buffers(col)[1])
    grown, a = np.cumsum(sizes), 0
    while a < len(sizes):
        done = grown[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(grown, done + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by one sort."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(1, dtype=bool), x[1:] != x[:-1]])] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([np.ones(1, dtype=bool), x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)
    return x[first], np.diff(np.append(first, len(x))).astype(np.int64)
