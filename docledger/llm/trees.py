"""Histogram gradient-boosted trees for two classes, held and walked as flat arrays.

Fitting takes a bounded sample as one matrix; features are cut into quantile bins once and every
split is found on per-bin sums. Trees are complete to a fixed depth, so a model is three matrices
and a batch of rows goes down all levels with one indexing step each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  #: trees x inner nodes
    threshold: np.ndarray  #: trees x inner nodes; values above go right
    leaf: np.ndarray  #: trees x leaves
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of the matrix."""
        total = np.full(len(rows), self.base)
        if len(rows):
            inner, at = self.feature.shape[1], np.arange(len(rows))
            for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
                node = np.zeros(len(rows), np.int64)
                while node[0] < inner:
                    node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
                total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of the bins but the last."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:]))
    return (values[:-1] + values[1:]) / 2 if len(values) > 1 else np.empty(0)


def fit_forest(
    rows: np.ndarray, labels: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15,
    penalty: float = 5.0, least: int = 20,
) -> Forest:
    """Boosts ``trees`` trees on the logistic loss. Without rows, or with one class, the prior is the score."""
    count, width = rows.shape
    inner, prior = 2**depth - 1, (labels.sum() + 0.5) / (count + 1.0)
    base = float(np.log(prior / (1 - prior)))
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if count == 0 or labels.min() == labels.max():
        return Forest(feature[:0], threshold[:0], leaf[:0], base)
    edges = [_edges(rows[:, k], bins) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], rows[:, k], side="left") for k in range(width)], axis=1)
    score = np.full(count, base)
    for tree in range(trees):
        chance = 1.0 / (1.0 + np.exp(-score))
        slope, bend = labels - chance, chance * (1 - chance)
        node = np.zeros(count, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            for k in range(width):
                if not len(edges[k]):
                    continue
                cell = (node - first) * bins + binned[:, k]
                grid = [
                    np.bincount(cell, weights, nodes * bins)[: nodes * bins].reshape(nodes, bins).cumsum(axis=1)
                    for weights in (slope, bend, np.ones(count))
                ]
                (g, h, n), (gs, hs, ns) = grid, (part[:, -1:] for part in grid)
                gain = g**2 / (h + penalty) + (gs - g) ** 2 / (hs - h + penalty) - gs**2 / (hs + penalty)
                gain[(n < least) | (ns - n < least)] = 0
                cut = gain[:, : len(edges[k])].argmax(axis=1)
                won = gain[np.arange(nodes), cut]
                better = won > best
                best[better] = won[better]
                feature[tree, first:first + nodes][better] = k
                threshold[tree, first:first + nodes][better] = edges[k][cut[better]]
            node = 2 * node + 1 + (rows[np.arange(count), feature[tree][node]] > threshold[tree][node])
        side = node - inner
        leaf[tree] = rate * np.bincount(side, slope, inner + 1) / (np.bincount(side, bend, inner + 1) + penalty)
        score += leaf[tree][side]
    return Forest(feature, threshold, leaf, base)
