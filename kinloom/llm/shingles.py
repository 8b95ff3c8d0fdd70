"""Word shingles of whole texts as sorted 64-bit tokens."""

from __future__ import annotations

import numpy as np
import xxhash


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when it grows, so that a worker's memory stays bounded."""

    MOST = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, size: int) -> np.ndarray:
    r"""Distinct shingles of ``size`` words ``[^\x20\x09-\x0D]+``, A-Z lower-cased.

    A text of fewer words has the whole sequence as its one shingle; one without words has none.
    """
    # bytes.lower and bytes.split know ASCII letters and the six ASCII spaces only, as asked for.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            acc = mix(acc) + hashes[i : len(words) - n + 1 + i]
        return np.unique(mix(acc))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
