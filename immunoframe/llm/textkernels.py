"""Vectorised word kernels over Arrow string columns (numpy on the UTF-8 buffer, no per-word objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the word pattern ``[0-9a-z]`` and everything beyond ASCII, after lower-casing A-Z.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

C1, C2, C3, C4, C5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * C1)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, so that temporary arrays stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and the n + 1 row offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some rows: ``start`` and ``end`` (bytes), ``row``, ``counts`` and ``first`` (by row)."""

    def __init__(self, column: pa.Array, *, lower: bool = True, alnum: bool = False) -> None:
        data, self.offsets = utf8(column)
        self.data = _LOWER[data] if lower else data
        inside = _ALNUM[self.data] if alnum else ~_SPACE[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begin[edges] = inside[edges]  # a word never goes over the end of its row
        finish[edges - 1] = inside[edges - 1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, self.offsets[:-1])
        self.counts = np.diff(np.append(self.first, len(self.start)))

    def split(self, at: np.ndarray) -> None:
        """Words also end and begin at these bytes, all of which stand inside a word or at its start."""
        edges = np.zeros(len(self.data) + 1, bool)
        edges[self.start] = True
        edges[at] = True
        begin = np.flatnonzero(edges)
        edges[self.end] = True
        stops = np.flatnonzero(edges)
        nxt = np.searchsorted(stops, begin, side="right")
        self.start, self.end = begin, stops[nxt]
        self.first = np.searchsorted(self.start, self.offsets[:-1])
        self.counts = np.diff(np.append(self.first, len(self.start)))

    def lower(self) -> None:
        self.data = _LOWER[self.data]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of random numbers drawn by byte and place, then mixed."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        total = int(lengths.sum())
        heads = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(heads, lengths)
        value = self.data[self.inside] if total == int(self.inside.sum()) else self.data[np.repeat(self.start, lengths) + place]
        cell = _TABLE[((place & 63) << 8) | value]
        far = place >= 64
        if far.any():
            cell[far] = mix64(cell[far] + (place[far] >> 6).astype(np.uint64) * C2)
        return mix64(np.add.reduceat(cell, heads) + lengths.astype(np.uint64) * C3)


def windows(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows, and the number of windows by row (none for rows of fewer words)."""
    coef = (C1, C2, C3, C4, C5)[:k]
    n = np.maximum(words.counts - k + 1, 0)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first, n)
    out = hashes[at] * coef[0]
    for i in range(1, k):
        out += hashes[at + i] * coef[i]
    return mix64(out), n


def shingle_sets(column: pa.Array, k: int = 3) -> Iterator[np.ndarray]:
    """By row, its sorted distinct ``k``-word shingle hashes; the whole sequence if there are fewer words."""
    words = Words(column)
    hashes = words.hashes()
    grams, n = windows(hashes, words, k)
    ends = np.cumsum(n)
    for i, (count, first) in enumerate(zip(words.counts.tolist(), words.first.tolist(), strict=True)):
        if count >= k:
            yield np.unique(grams[ends[i] - n[i] : ends[i]])
        elif count:
            short = (hashes[first : first + count] * np.array([C1, C2, C3, C4, C5][:count])).sum(dtype=np.uint64) + np.uint64(count)
            yield mix64(np.array([short], np.uint64) * C4)
        else:
            yield np.zeros(0, np.uint64)
