"""A compressed full-text index over numbers: suffix order, Burrows-Wheeler transform, wavelet
matrix, and backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order, by doubling the length that is compared."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    n, step = len(text), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Index of numbers ``0 .. top``; no number beyond the text's own is looked up."""

    def __init__(self, text: np.ndarray):
        self.order = suffix_order(text)
        last = text[self.order - 1]
        top = int(text.max()) + 1
        self.bits = max(1, int(top).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))]).astype(np.int64)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.start = self._descend(np.arange(top), np.zeros(top, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals ``[low, high)`` of the rows of ``patterns``, from their last symbol."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.order), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = np.ascontiguousarray(patterns[:, j])
            base = self.before[c] - self.start[c]
            low, high = base + self._descend(c, low), base + self._descend(c, high)
        return low, high
