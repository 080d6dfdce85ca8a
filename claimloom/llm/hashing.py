"""64-bit polynomial hashes of byte ranges, and hashed word shingles, over whole numpy buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C13)
_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_MIX = [int(x) | 1 for x in _RNG.integers(0, 1 << 63, 64, dtype=np.uint64)]
_INVERSE = U(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of a base modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.have = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            with np.errstate(over="ignore"):
                steps = np.full(max(n, 2 * len(self.have), 1 << 16), self.base)
                steps[0] = 1
                self.have = np.multiply.accumulate(steps)
        return self.have[:n]


_UP, _DOWN = _Powers(BASE), _Powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Rolled:
    """Prefix sums of a buffer, from which the hash of any range follows in constant time."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(TABLE[raw] * _UP.upto(self.n), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * _DOWN.upto(self.n + 1)[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:m]) * _DOWN.upto(m))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word (a maximal run without ASCII white space) of UTF-8 bytes."""
    if not raw:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    with np.errstate(over="ignore"):
        return Rolled(buf).ranges(start, end) + (end - start).astype(np.uint64)


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of lower-cased bytes.

    Fewer words than k make one shingle of the whole sequence; no words make none.
    """
    words = word_hashes(raw.lower())  # bytes.lower() changes A-Z only
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, U(k))
        for i in range(k):
            out += words[i : n - k + 1 + i] * U(_MIX[i])
    return np.unique(mixed(out))
