"""Vectorised hashes of the words of many texts, straight from an Arrow batch's UTF-8 buffer.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is the sum over its bytes of (random 64-bit value of the byte) x
P^position mod 2^64, then mixed; with ``fold`` A-Z count as a-z. The buffer is taken in blocks that end between
words, so memory beside the result is bounded except by the longest word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C55)
_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:  # doubling
        step = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have:have + step] = out[:step] * (out[have - 1] * base)
        have += step
    return out


_POW, _INVPOW = _powers(_P, BLOCK + 1), _powers(_INV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each text's offsets in them (nulls have no bytes)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, firsts)`` of all words: hash, byte span in ``data``, and for each text the number of words
    before it (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = inside[edges]  # a text ends the word before it
    starts = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    table, at = _FOLD if fold else _BYTE, 0
    while at < len(starts):
        low = starts[at]
        stop = max(int(np.searchsorted(ends, low + BLOCK, "right")), at + 1)
        high = int(ends[stop - 1])
        size = high - low
        pw, inv = (_POW, _INVPOW) if size <= BLOCK else (_powers(_P, size + 1), _powers(_INV, size + 1))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[low:high]] * pw[:size], out=total[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        hashes[at:stop] = mix((total[b] - total[a]) * inv[a] + (b - a).astype(np.uint64))
        at = stop
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)
