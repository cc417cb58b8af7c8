"""Hashed word features: words, their beginnings, word pairs and pairs that skip words."""

from __future__ import annotations

import string

import numpy as np
import xxhash

PREFIXES = (4, 5, 6, 7, 8)
_SPACED = bytes.maketrans((string.punctuation + "\n\t\r\x0b\x0c").encode(), b" " * (len(string.punctuation) + 5))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_FORGET = 400_000  # words remembered at most


def folded_words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Hasher:
    """Text -> the distinct feature slots of a table of 2 ** bits, in order."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.rows: dict[bytes, int] = {}
        self.matrix = np.zeros((0, len(PREFIXES) + 1), np.uint64)

    def _learn(self, new: set[bytes]) -> None:
        """Hashes of new words and of their first bytes (a beginning is seeded by its length; short words have none)."""
        digest, flat = xxhash.xxh3_64_intdigest, []
        for w in new:
            self.rows[w] = len(self.rows)
            whole = digest(w)
            flat.append(whole)
            flat += [digest(w[:n], n) if len(w) >= n else whole for n in PREFIXES]
        more = np.array(flat, np.uint64).reshape(-1, len(PREFIXES) + 1)
        first = len(self.rows) - len(more)
        if len(self.rows) > len(self.matrix):  # grows by doubling
            grown = np.zeros((2 * len(self.rows), more.shape[1]), np.uint64)
            grown[:first] = self.matrix[:first]
            self.matrix = grown
        self.matrix[first:first + len(more)] = more

    def slots(self, text: str) -> np.ndarray:
        words = folded_words(text)
        if not words:
            return np.zeros(0, np.int64)
        if len(self.rows) > _FORGET:
            self.rows.clear()
        rows = self.rows
        new = set(words).difference(rows)
        if new:
            self._learn(new)
        ids = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        single = self.matrix[np.unique(ids)].ravel()
        h = self.matrix[ids, 0]
        pairs = [(h[:-gap] * _MIX[0] ^ h[gap:] * _MIX[k]) * _MIX[1] >> np.uint64(7) for k, gap in ((1, 1), (2, 2), (0, 3)) if len(h) > gap]
        return np.unique(np.concatenate([single, *pairs]) & self.mask).astype(np.int64)
