"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of equal depth: at node k go to 2k + 1, or to 2k + 2 if ``x[feature[k]] > cut[k]``."""

    prior: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes)
    value: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1, all rows of a tree level at once."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -700, 700)))


def _bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between different values, at most ``bins - 1``, at equal shares of the rows."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return values
    return (values[:-1] + values[1:]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
        ridge: float = 1.0, least_weight: float = 2.0) -> Trees:
    """Fit to rows ``x`` and labels 0/1. Without rows, or with one class only, the trees are empty and the score is constant."""
    inner = 2 ** depth - 1
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(prior, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [_bin_edges(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    n_features = x.shape[1]
    slot = binned + np.arange(n_features) * bins
    margin, grown = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1.0 - p)
        grown.append(_grow(binned, slot, edges, gradient, hessian, depth, rate, bins, ridge, least_weight))
        margin += grown[-1][3]
    return Trees(prior, depth, *(np.stack([g[k] for g in grown]) for k in range(3)))


def _grow(binned, slot, edges, gradient, hessian, depth, rate, bins, ridge, least_weight):
    """One tree, level by level; returns feature, cut, leaf values and each row's step."""
    n, n_features = binned.shape
    inner = 2 ** depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(n, dtype=np.int64)
    width = n_features * bins
    for level in range(depth):
        nodes, first = 2 ** level, 2 ** level - 1
        where = ((node - first)[:, None] * width + slot).ravel()
        g = np.bincount(where, np.repeat(gradient, n_features), nodes * width).reshape(nodes, n_features, bins)
        h = np.bincount(where, np.repeat(hessian, n_features), nodes * width).reshape(nodes, n_features, bins)
        left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - all_g ** 2 / (all_h + ridge)
        gain[(left_h < least_weight) | (right_h < least_weight)] = -1.0
        best = gain.reshape(nodes, width).argmax(axis=1)
        chosen_feature, chosen_bin = best // bins, best % bins
        useful = gain.reshape(nodes, width)[np.arange(nodes), best] > 1e-9
        threshold = np.full(nodes, bins)
        for k in np.flatnonzero(useful):
            if chosen_bin[k] < len(edges[chosen_feature[k]]):
                feature[first + k] = chosen_feature[k]
                cut[first + k] = edges[chosen_feature[k]][chosen_bin[k]]
                threshold[k] = chosen_bin[k]
        here = node - first
        node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > threshold[here])
    leaf = node - inner
    total_g = np.bincount(leaf, gradient, inner + 1)
    total_h = np.bincount(leaf, hessian, inner + 1)
    value = -rate * total_g / (total_h + ridge)
    return feature, cut, value, value[leaf]
