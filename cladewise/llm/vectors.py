"""Words, shingles and hashes of batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20260101))
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
PLACE = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE_BYTES = 3_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of the splitmix64 generator: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n-1 and the same of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(max(n, SLICE_BYTES), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**place over the first k bytes, for k from 0 to len(data)."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that depend on the bytes and their number alone."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Some texts end to end: ``data`` holds the UTF-8 bytes, text i lies at bounds[i]:bounds[i+1]."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty) in slices of about ``most`` bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield Texts(slice(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end


@dataclass
class Words:
    """Hashes of the words of some texts, A-Z lower-cased; words of text i are at bounds[i]:bounds[i+1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(texts: Texts) -> Words:
    data = LOWER[texts.data]
    n = len(data)
    solid = ~IS_WHITE[data]
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = texts.bounds[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(prefix_hash(data), start, end) if n else np.zeros(0, np.uint64)
    return Words(hashes, np.searchsorted(start, texts.bounds), start, end)


def shingles_of(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (hashes, bounds). A text of fewer words has its whole sequence as one."""
    counts = words.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    h, total = words.hashes, len(words.hashes)
    place = np.arange(total) - words.bounds[:-1][doc]
    left = counts[doc] - place  # words from here to the end of the text
    value = np.zeros(total, np.uint64)
    for k in range(size):
        here = left > k
        value[here] += mix(h[np.flatnonzero(here) + k] + PLACE[k]) * PLACE[(k + 3) % 8]
    whole = (place == 0) & (counts[doc] < size)
    start = (left >= size) | whole
    value[whole] += mix(counts[doc][whole].astype(np.uint64))
    value, doc = mix(value[start]), doc[start]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def set_digest(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit digest per set of hashes, whatever their order."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ PLACE[7]), out=sums[1:])
    out = sums[bounds[1:]] - sums[bounds[:-1]]
    return mix(out + np.diff(bounds).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return start, np.diff(np.r_[start, len(sorted_values)])


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start..start+count of every range, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All values of a column of binary arrays, one after the other."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
