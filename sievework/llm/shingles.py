"""Word shingle hashes of a whole text: a strong hash a word, shingles in numpy.

A-Z are lower-cased; words are maximal runs without ASCII white space.  A
shingle is five words in a row; a text with fewer words is one shingle, one
without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import Memo

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hash(word: bytes) -> int:
    """64 bits of BLAKE2, as a polynomial hash of letters meets itself on repetitive words."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: Hashes of the words met lately, one memory a Python worker.
_HASHES = Memo(_hash, 16 << 20)


def forgetful(run):
    """run, a function of batches that uses shingles, which frees their memory with its task."""

    def out(batches):
        return _HASHES.released_after(run)(batches)

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + w[i:len(w) - size + 1 + i]
    return np.unique(mix(out))
