"""Vectorised word and shingle hashing over Arrow string buffers (numpy, no per-word objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 17

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) for runs of rows of about CHUNK_BYTES; null is empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, n)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), and the row of each."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]  # a row's first byte begins a word of its own
    at = np.flatnonzero(inside)
    begins = np.flatnonzero(first)
    if len(begins) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where = np.searchsorted(at, begins) if len(at) != len(data) else begins
    lengths = np.diff(np.append(where, len(at)))
    place = np.arange(len(at)) - np.repeat(where, lengths)
    chars = data[at]
    if lower:
        chars = _LOWER[chars]
    value = _BYTE[chars] * powers(int(lengths.max()))[place]
    h = mixed(np.add.reduceat(value, where) + lengths.astype(np.uint64))
    return h, np.searchsorted(offsets, begins, side="right") - 1


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes, grouped by row and sorted, and offsets by row (rows + 1).

    A row of 1 to k-1 words has its whole sequence as its one shingle; a row without words has none.
    """
    counts = np.bincount(row, minlength=rows)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n = len(h)
    if n >= k:
        g = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            g += h[j : n - k + 1 + j] * _STEPS[j]
        ok = row[: n - k + 1] == row[k - 1 :]
        g, r = mixed(g[ok]), row[: n - k + 1][ok]
    else:
        g, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = [mixed(np.sum(h[starts[i] : starts[i + 1]] * _STEPS[: counts[i]], dtype=np.uint64, keepdims=True) + _STEPS[63:] * np.uint64(counts[i]))[0] for i in short]
        g, r = np.append(g, np.array(extra, dtype=np.uint64)), np.append(r, short)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    if len(g):
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[new], r[new]
    return g, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=rows))))
