"""Gradient-boosted regression trees for binary labels, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees on the logistic loss; leaves are Newton steps, splits come from histograms of at most 32 bins, and each
    tree sees a share of the features and of the rows, drawn with a fixed seed."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 8.0, penalty: float = 1.0, share: float = 0.35, rows: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty, self.share, self.rows = trees, depth, rate, bins, least, penalty, share, rows

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = []
        for j in range(x.shape[1]):
            u = np.unique(x[:, j])
            if len(u) > self.bins:
                u = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest"))
                self.edges.append(u)
            else:
                self.edges.append((u[1:] + u[:-1]) / 2)
        b = self._binned(x)
        n, every = b.shape
        every_row = np.arange(n)
        two = np.array([len(e) < 2 for e in self.edges])  # features of two values
        width = max(1, int(every * self.share))
        draw = np.random.default_rng(7)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        z = np.full(n, self.base)
        size = 2**self.depth
        self.feature = np.zeros((self.trees, size), np.int32)
        self.cut = np.full((self.trees, size), 255, np.uint8)
        self.leaf = np.zeros((self.trees, size))
        for t in range(self.trees):
            seen = every_row if self.rows >= 1 else np.flatnonzero(draw.random(n) < self.rows)
            p = 1 / (1 + np.exp(-z[seen]))
            g, h = y[seen] - p, p * (1 - p)
            some = np.sort(draw.permutation(every)[:width])
            self._grow(t, b[seen], g, h, some, two[some])
            z += self.leaf[t][self._leaves(t, b)]
        return self

    def _grow(self, t: int, b: np.ndarray, g: np.ndarray, h: np.ndarray, some: np.ndarray, flag: np.ndarray) -> None:
        """Tree t on binned rows with gradients g and curvatures h, of the features `some`; `flag` marks those of two values."""
        n, width, size = len(b), len(some), 2**self.depth
        numeric, flags = some[~flag], np.ascontiguousarray(b[:, some[flag]].T.astype(float))
        cells = b[:, numeric].astype(np.int64) + np.arange(len(numeric)) * self.bins
        node, above = np.ones(n, np.int64), None
        for level in range(self.depth):
            first = count = 1 << level
            # Histograms of the left children only; their sisters have what is left of the parents.
            rows = np.flatnonzero(node & 1 == 0) if level else np.arange(n)
            half = max(1, count // 2)
            at = (((node[rows] - first) // min(2, count))[:, None] * (len(numeric) * self.bins) + cells[rows]).ravel()
            sums = [np.bincount(at, np.repeat(v[rows], len(numeric)), half * len(numeric) * self.bins).reshape(half, len(numeric), self.bins) for v in (g, h)]
            if level:
                sums = [np.stack([left, whole - left], 1).reshape(count, len(numeric), self.bins) for left, whole in zip(sums, above, strict=True)]
            above = sums
            at = node - first
            hists = []
            for v, numbers in zip((g, h), sums, strict=True):
                total = np.bincount(at, v, count)
                yes = np.stack([np.bincount(at, v * f, count) for f in flags], 1) if len(flags) else np.zeros((count, 0))
                hist = np.repeat(np.repeat(total[:, None, None], width, 1), self.bins, 2)
                hist[:, ~flag] = numbers.cumsum(2)
                hist[:, flag, 0] = total[:, None] - yes
                hists.append(hist)
            hg, hh = hists
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + self.penalty) + (tg - hg) ** 2 / (th - hh + self.penalty) - tg**2 / (th + self.penalty)
            gain[(hh < self.least / 4) | (th - hh < self.least / 4)] = -np.inf
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            useful = flat[np.arange(count), best] > 1e-6
            self.feature[t, first : 2 * first] = np.where(useful, some[best // self.bins], 0)
            self.cut[t, first : 2 * first] = np.where(useful, best % self.bins, 255)
            node = node * 2 + (b[np.arange(n), self.feature[t, node]] > self.cut[t, node])
        where = node - size
        self.leaf[t] = self.rate * np.bincount(where, g, size) / (np.bincount(where, h, size) + self.penalty)

    def _leaves(self, t: int, b: np.ndarray) -> np.ndarray:
        """The leaf of tree t that each binned row comes to."""
        rows, node = np.arange(len(b)), np.ones(len(b), np.int64)
        for _ in range(self.depth):
            node = node * 2 + (b[rows, self.feature[t][node]] > self.cut[t][node])
        return node - 2**self.depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self._binned(x)
        for t in range(self.trees):
            out += self.leaf[t][self._leaves(t, b)]
        return out
