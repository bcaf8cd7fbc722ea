"""Sets of word shingles as sorted 64-bit hashes, and minwise signatures of them."""

from __future__ import annotations

import numpy as np

from quarry.llm.hashing import buffer_of, mix, words

POSITIONS = 128
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_STEP = 1 << 14


def shingle_sets(column, width: int = 2):
    """The distinct shingles of each text, one sorted array after the other: ``width`` words (A-Z folded), or all words
    where there are fewer."""
    data, offsets = buffer_of(column)
    hashes, _, _, firsts = words(data, offsets)
    if width == 2:
        pair = hashes.copy()
        pair[:-1] = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])
    else:
        pair = np.zeros_like(hashes)
        for k in range(width):
            pair[: len(hashes) - k] = mix(pair[: len(hashes) - k] * np.uint64(0x9FB21C651E98DF25) + hashes[k:])
    for i in range(len(firsts) - 1):
        a, b = int(firsts[i]), int(firsts[i + 1])
        if b - a >= width:
            yield np.unique(pair[a:b - width + 1])
        elif b > a:  # the whole sequence as one; marked, since it is no shingle of ``width`` words
            own = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    own = own * np.uint64(0x9FB21C651E98DF25) + h
            yield mix(np.array([own], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """Minwise values of a set at ``POSITIONS`` positions."""
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), _STEP):  # bounded memory for very large sets
        part = own[at:at + _STEP]
        low = (part ^ (part >> np.uint64(32))).astype(np.uint32)
        h = low[None, :] * _MUL[:, None] + _ADD[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, by sums of mixed hashes (signed)."""
    a = int(mix(own).sum(dtype=np.uint64)) if len(own) else 0
    b = int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(own) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))
