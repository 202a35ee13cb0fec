"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of an odd number modulo 2 ** 64, made as far as they are asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.made = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.made) < n:
            size = 1 << max(12, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.made = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, self.base, dtype=np.uint64))])
        return self.made[:n]


_powers, _inverses = _Powers(_BASE), _Powers(_INVERSE)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of the runs of a sequence of word hashes; equal runs have equal hashes wherever they start."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * _powers.upto(n), out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of each run of so many words, by its start."""
        n = max(0, len(self.sums) - length)
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:n]) * _inverses.upto(n) + np.uint64(length))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * _inverses.upto(len(self.sums))[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of each ``width`` neighbours, by the first of them."""
    pick, have = np.minimum if least else np.maximum, 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x
