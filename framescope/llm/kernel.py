"""Vectorised text primitives over Arrow string buffers: slices, words, hashes, shingles.

All work on UTF-8 bytes without building Python strings. A slice holds whole texts, about
SLICE_BYTES of them, so that working memory does not depend on the Arrow batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n).bit_length()
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers, _inverse = np.full(size, _BASE), np.full(size, back)
        _powers[0] = _inverse[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverse, out=_inverse)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets from 0) for runs of whole texts of about size bytes."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """White-space separated words of a slice: document, byte start and end, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, strip: bool = False):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        gap = np.ones(n + 2, bool)
        gap[1:-1] = _SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        solid = ~gap[1:-1]
        self.start = np.flatnonzero(solid & (gap[:n] | first[:n]))
        self.end = np.flatnonzero(solid & (gap[2:] | first[1:])) + 1
        if strip:
            for _ in range(4):
                self.end -= (self.end > self.start) & _PUNCT[self.data[self.end - 1]]
                self.start += (self.end > self.start) & _PUNCT[self.data[np.minimum(self.start, n - 1)]] if n else 0
            kept = self.end > self.start
            self.start, self.end = self.start[kept], self.end[kept]
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets) - 1))
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        powers, inverse = _tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each position."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    return mix((total[k:] - total[:n]) * inverse[:n])


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: document and hash, ordered by both. A document with fewer words than
    width has one of all its words; one without words has none."""
    n, count = len(words.hash), words.count
    step = [np.uint64(x | 1) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x6C8D7F1B2A3E4C55)]
    out = np.zeros(n, np.uint64)
    place = np.arange(n) - words.first[words.doc]
    left = count[words.doc] - place
    for j in range(width):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - j)] = words.hash[j:]
        out += np.where(left > j, part * step[j % len(step)] + np.uint64(j + 1), 0).astype(np.uint64)
    kept = (left >= width) | ((place == 0) & (count[words.doc] < width))
    doc, value = words.doc[kept], mix(out[kept])
    return distinct(doc, value)


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) ordered by both."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and their counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
