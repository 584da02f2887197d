"""Gradient-boosted trees with logistic loss on binned features, and isotonic regression; numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees=40, depth=4, rate=0.25, bins=32, penalty=1.0, least=20):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        q = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.int64)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(n, self.base)
        size = 1 << self.depth
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            feats, cuts = np.zeros(size - 1, dtype=np.int64), np.full(size - 1, np.inf)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                pick = np.full((width, 2), -1)
                gt, ht = np.bincount(node, g, width), np.bincount(node, h, width)
                for j in range(m):
                    b = len(self.cuts[j]) + 1
                    if b < 2:
                        continue
                    key = node * b + q[:, j]
                    gl = np.bincount(key, g, width * b).reshape(width, b).cumsum(1)[:, :-1]
                    hl = np.bincount(key, h, width * b).reshape(width, b).cumsum(1)[:, :-1]
                    nl = np.bincount(key, minlength=width * b).reshape(width, b).cumsum(1)
                    gain = gl**2 / (hl + self.penalty) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + self.penalty) - (gt**2 / (ht + self.penalty))[:, None]
                    gain[(nl[:, :-1] < self.least) | (nl[:, -1:] - nl[:, :-1] < self.least)] = 0
                    k = gain.argmax(1)
                    v = gain[np.arange(width), k]
                    better = v > best
                    best[better] = v[better]
                    pick[better, 0], pick[better, 1] = j, k[better]
                right = np.zeros(n, dtype=np.int64)
                for w in range(width):
                    j, k = pick[w]
                    if j >= 0:
                        feats[first + w], cuts[first + w] = j, self.cuts[j][k]
                        rows = node == w
                        right[rows] = q[rows, j] > k
                node = node * 2 + right
            leaf = -np.bincount(node, g, size) / (np.bincount(node, h, size) + self.penalty) * self.rate
            f += leaf[node]
            self.feature.append(feats)
            self.cut.append(cuts)
            self.value.append(leaf)
        self.feature, self.cut, self.value = np.array(self.feature), np.array(self.cut, dtype=np.float32), np.array(self.value, dtype=np.float32)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        n = len(x)
        out = np.full(n, self.base, dtype=np.float32)
        if not n:
            return out
        x = np.asarray(x, dtype=np.float32)
        flat, base, m = x.ravel(), np.arange(n) * x.shape[1], 1 << self.depth
        for t in range(len(self.value)):
            at = np.zeros(n, dtype=np.int64)
            f, c = self.feature[t], self.cut[t]
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[base + f[at]] > c[at])
            out += self.value[t][at - (m - 1)]
        return out


def isotonic(score: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps of a rising function, as (upper ends of scores, values)."""
    order = np.argsort(score, kind="stable")
    s, v = score[order], value[order].astype(float)
    sums, counts, ends = [], [], []
    for a, b in zip(s, v):
        sums.append(b)
        counts.append(1)
        ends.append(a)
        while len(sums) > 1 and sums[-2] / counts[-2] >= sums[-1] / counts[-1]:
            b, c, e = sums.pop(), counts.pop(), ends.pop()
            sums[-1] += b
            counts[-1] += c
            ends[-1] = e
    return np.array(ends), np.array(sums) / np.array(counts)
