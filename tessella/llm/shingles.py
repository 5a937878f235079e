"""Word shingles of whole texts as sets of 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed value: upper-case Latin letters and what they become; other characters stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers whose every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs without blanks and the control characters from tab to carriage return, A-Z lowered."""
    return text.encode().translate(LOWER).split() if text else []


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted set of all runs of `size` words; the whole text is one run where it has fewer words; none without words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(size, len(w))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s * _ODD + h[i : i + n])
    return np.unique(s)
