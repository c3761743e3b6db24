"""Vectorised text primitives over Arrow string buffers: words, word hashes, n-gram hashes.

A *word* is a maximal run of bytes outside {0x20, 0x09-0x0D}. These separators are ASCII, so the
work is done on UTF-8 bytes. Hashes are 64-bit polynomial hashes with a random value per byte,
finished with a mixing step; arithmetic wraps in uint64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n (at least)."""
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _PINV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finisher on uint64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = CHUNK_BYTES) -> np.ndarray:
    """Hash of values[s:e] for ascending, non-overlapping spans; values: one uint64 for each symbol."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        pw, inv = powers(b - a + 1)
        h = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * pw[: b - a], out=h[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((h[e] - h[s]) * inv[s])
        i = j
    return out


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, for each document the index of its first word; one more at the end)."""
    if lower:
        data = _LOWER[data]
    word = ~_IS_SEP[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = word
    starts = np.flatnonzero(word & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(word & (np.append(~word[1:], True) | first[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], starts, ends)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word (shorter at the end of h)."""
    out = h.copy()
    c = 1
    for j in range(1, k):
        c = c * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        out[: len(h) - j] += h[j:] * _U(c)
    return mix(out + _U(k))


def document_grams(h: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the hashes of its k-word shingles in text order. A document of fewer words has one, of all its words; one without words has none."""
    g = gram_hashes(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield g[a : b - k + 1]
        elif b > a:
            yield gram_hashes(h[a:b], b - a)[:1]
        else:
            yield g[:0]
