"""Words, shingles and 64-bit hashes of Arrow text columns, computed over whole batches with numpy.

Texts are read as UTF-8 bytes. All separators used here are ASCII, so splitting bytes equals
splitting characters. Hashes are position independent: a word has the same hash in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

_ODD = 0x9E3779B97F4A7C15
_SLICE_BYTES = 512 << 10

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, m in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(max(n + 1, _SLICE_BYTES + 65), m, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes wherever they stand."""
    up, down = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of ``column``; a row is never cut."""
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0), dtype=np.int64)
        piece = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each text; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: byte spans, hashes, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, word_bytes: np.ndarray) -> Words:
    """Maximal runs of ``word_bytes`` after lower-casing A-Z, never across texts."""
    data, offsets = utf8(column)
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_bytes[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(start, end, span_hashes(data, start, end), np.searchsorted(start, offsets))


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and where each text's runs begin.

    A text of fewer words, but not none, has one run: all its words.
    """
    h, count = found.hash, found.count
    weight = [np.uint64(pow(0xD1342543DE82EF95, t + 1, 1 << 64)) for t in range(k)]
    runs = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for t in range(k):
        runs += h[t : t + len(runs)] * weight[t]
    runs = mix(runs + np.uint64(k))
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], n)
    out = runs[np.minimum(at, len(runs) - 1)] if len(runs) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = h[found.first[i] : found.first[i + 1]]
        total = np.uint64(len(own)) + np.sum(own * np.array(weight[: len(own)], np.uint64), dtype=np.uint64)
        out[first[i]] = mix(np.array([total]))[0]
    return out, first
