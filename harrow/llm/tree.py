"""A small decision tree: axis-parallel splits that lessen the Gini impurity most, grown on a table in memory."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> tuple:
    """Nested (feature, threshold, left, right), rows with a value up to the threshold go left; leaves are (share of 1,)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, n = np.cumsum(t), np.arange(1, len(t) + 1)
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(n[cut] >= least) & (len(t) - n[cut] >= least)]
        if len(cut):
            a, na, b, nb = ones[cut], n[cut], ones[-1] - ones[cut], len(t) - n[cut]
            gini = a * (na - a) / na + b * (nb - b) / nb
            k = int(gini.argmin())
            if gini[k] < best[0] - 1e-12:
                best = (float(gini[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[0] == np.inf:
        return (float(y.mean()),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if len(node) == 1:
            out[at] = node[0]
        else:
            left = x[at, node[0]] <= node[1]
            todo += [(node[2], at[left]), (node[3], at[~left])]
    return out
