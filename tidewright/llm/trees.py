"""Small models in numpy: boosted trees, isotonic calibration, an additive model with pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each column at quantiles of its distinct-enough values."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) if len(c) else np.empty(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value; NaN goes to the lowest."""
    return np.stack([np.searchsorted(c, np.nan_to_num(col, nan=-np.inf), side="left") for col, c in zip(x.T, cuts)], axis=1).astype(np.int32) if x.shape[1] else np.zeros((len(x), 0), np.int32)


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve; ties count half.  NaN without both classes."""
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    p, n = int(y.sum()), int(len(y) - y.sum())
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")


class BoostedTrees:
    """Gradient boosting of binary trees of fixed depth for the logistic loss, on histograms."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, ridge: float = 2.0, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = cut_points(x, self.bins)
        b = binned(x, self.cuts)
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = sigmoid(f)
            g, h = y - p, p * (1 - p)
            inner = 2**self.depth - 1
            feature, cut = np.zeros(inner, np.int32), np.full(inner, self.bins, np.int32)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                gain_best = np.full(many, 1e-6)
                local = node - first
                for k in range(x.shape[1]):
                    cell = local * width + b[:, k]
                    size = many * width
                    gs, hs, ns = (np.cumsum(np.bincount(cell, w, size).reshape(many, width), axis=1) for w in (g, h, None))
                    gr, hr, nr = gs[:, -1:] - gs, hs[:, -1:] - hs, ns[:, -1:] - ns
                    gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[(ns < self.least) | (nr < self.least)] = -1
                    at = gain.argmax(axis=1)
                    best = gain[np.arange(many), at]
                    better = best > gain_best
                    gain_best[better] = best[better]
                    feature[first : first + many][better] = k
                    cut[first : first + many][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gs / (hs + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        f, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - inner]
        return f


class Isotonic:
    """Least-squares monotone fit by pooling adjacent violators, linear between block means."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        sums: list[list[float]] = []
        for at, v in zip(s[order], y[order]):
            sums.append([float(at), float(v), 1.0])
            while len(sums) > 1 and sums[-2][1] * sums[-1][2] >= sums[-1][1] * sums[-2][2]:
                a, b, n = sums.pop()
                sums[-1][0] = (sums[-1][0] * sums[-1][2] + a * n) / (sums[-1][2] + n)
                sums[-1][1] += b
                sums[-1][2] += n
        self.at = np.array([x[0] for x in sums] or [0.0])
        self.value = np.array([(x[1] + 0.05) / (x[2] + 0.1) for x in sums] or [0.5])
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        # a trace of the raw margin keeps scores of one block apart, so ranking is not lost
        return np.clip(np.interp(s, self.at, self.value) * 0.999 + 0.001 * sigmoid(s), 0, 1)


class AdditiveModel:
    """Generalised additive model with pairwise interactions for the logistic loss.

    Rounds go through the features in turn; each fits a shallow tree of one
    feature to the residuals and adds its leaf values to that feature's lookup
    table.  Pairs are chosen by how much a grid of the two reduces what is left,
    and boosted alike into two-way tables.  A score is a sum of table entries.
    """

    def __init__(self, rounds: int = 150, rate: float = 0.08, bins: int = 48, leaves: int = 4, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, ridge: float = 3.0, least: int = 15):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    @staticmethod
    def _steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, ridge: float, least: int) -> np.ndarray:
        """Leaf value of every bin of the best tree of one feature, grown greedily."""
        edges = [0, len(g)]
        cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))
        score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        for _ in range(leaves - 1):
            best = (1e-6, None)
            for a, b in zip(edges, edges[1:]):
                c = np.arange(a + 1, b)
                if not len(c):
                    continue
                gain = score(a, c) + score(c, b) - score(a, b)
                gain[(cn[c] - cn[a] < least) | (cn[b] - cn[c] < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(c[k]))
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(edges, edges[1:]):
            out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.cuts, self.coarse = cut_points(x, self.bins), cut_points(x, self.pair_bins)
        b, c = binned(x, self.cuts), binned(x, self.coarse)
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(k) + 1) for k in self.cuts]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                p = sigmoid(f)
                sums = [np.bincount(b[:, k], w, len(table)) for w in (y - p, p * (1 - p), None)]
                step = self.rate * self._steps(*sums, self.leaves, self.ridge, self.least)
                table += step
                f += step[b[:, k]]
        grids = {}
        for i, j in combinations(range(x.shape[1]), 2):
            p = sigmoid(f)
            cell = c[:, i] * (self.pair_bins + 1) + c[:, j]
            g, h = (np.bincount(cell, w, (self.pair_bins + 1) ** 2) for w in (y - p, p * (1 - p)))
            grids[i, j] = float((g**2 / (h + self.ridge)).sum())
        self.chosen = sorted(sorted(grids, key=lambda k: (-grids[k], k))[: self.pairs])
        side = self.pair_bins + 1
        self.pair_tables = [np.zeros(side * side) for _ in self.chosen]
        for _ in range(self.pair_rounds):
            for (i, j), table in zip(self.chosen, self.pair_tables):
                p = sigmoid(f)
                cell = c[:, i] * side + c[:, j]
                g, h = (np.bincount(cell, w, side * side) for w in (y - p, p * (1 - p)))
                step = self.rate * g / (h + 4 * self.ridge)
                table += step
                f += step[cell]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, c, side = binned(x, self.cuts), binned(x, self.coarse), self.pair_bins + 1
        f = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            f += table[b[:, k]]
        for (i, j), table in zip(self.chosen, self.pair_tables):
            f += table[c[:, i] * side + c[:, j]]
        return f
