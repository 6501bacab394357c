"""Hashed character n-grams of many words at once, in numpy."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd constant of Fibonacci hashing: 2**64 / golden ratio


def _squeeze(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Subwords:
    """n-gram ids of ``words`` (none empty, none with a space), each word padded with a space on both sides.

    n-grams with the pad are the affixes. ``ids[k]`` are hashed to ``bits`` bits, and
    ``word[k]`` says which word each belongs to; ``whole`` is a hash of each whole word.
    """

    def __init__(self, words: list[str], sizes: tuple[int, ...], bits: int):
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        gaps = np.flatnonzero(codes == 32)
        self.n = len(words)
        self.ids, self.word = [], []
        owner = np.cumsum(codes == 32) - 1
        rolled = codes.copy()
        with np.errstate(over="ignore"):
            for n in range(2, max(sizes) + 1):
                rolled = rolled[:-1] * np.uint64(1000003) + codes[n - 1 :]
                if n not in sizes:
                    continue
                if n > 2:  # no pad inside
                    inner = np.concatenate(([0], np.cumsum(codes == 32)))
                    ok = np.flatnonzero(inner[n - 1 : len(codes)] - inner[1 : len(codes) - n + 2] == 0)
                else:
                    ok = np.arange(len(rolled))
                self.ids.append(_squeeze(rolled[ok] + np.uint64(n), bits))
                self.word.append(owner[ok])
            position = np.arange(len(codes), dtype=np.uint64) - gaps[owner].astype(np.uint64)
            spread = (codes + np.uint64(0x51ED27)) * (position * np.uint64(2) + np.uint64(1)) * _MIX
            spread ^= spread >> np.uint64(29)
            self.whole = _squeeze(np.add.reduceat((spread * _MIX)[: gaps[-1]], gaps[:-1]), bits) if self.n else np.zeros(0, np.int64)

    def sums(self, tables: list[np.ndarray]) -> np.ndarray:
        """Per word, the sum of its n-grams' rows in ``tables`` (one table for each size)."""
        shape = (self.n,) + tables[0].shape[1:]
        out = np.zeros(shape)
        for ids, word, weights in zip(self.ids, self.word, tables):
            if weights.ndim == 1:
                out += np.bincount(word, weights=weights[ids], minlength=self.n)
            else:
                for k in range(weights.shape[1]):
                    out[:, k] += np.bincount(word, weights=weights[ids, k], minlength=self.n)
        return out

    def counts(self) -> np.ndarray:
        return sum(np.bincount(w, minlength=self.n) for w in self.word)
