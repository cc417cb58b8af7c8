"""Words and word shingles as 64-bit numbers, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z alone
_FORGET = 250_000  # words remembered at most: some 50 MB in each Python worker
_known: dict[bytes, int] = {}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(33))) * _B
    x = (x ^ (x >> np.uint64(33))) * _C
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > _FORGET:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingles of ``width`` folded words; fewer words are one shingle, no word is none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _A + h[k:len(h) - size + 1 + k])
    return np.unique(out)
