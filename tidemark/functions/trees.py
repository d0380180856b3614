"""Small regression trees for one group of rows: bagged, boosted, and what a feature adds to their predictions.

A tree is a handful of arrays; the groups (an instrument, a fold, an iteration) and
their number are Spark's business.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial
from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Nodes in order of making: the feature split on (-1 in a leaf), its threshold (left is at or below), children, the value, the rows that came by, and what the split gained."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray


class Ensemble(NamedTuple):
    base: float
    rate: float
    trees: list[Tree]


def _score(total: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return np.maximum(np.abs(total) - l1, 0) ** 2 / np.maximum(n + l2, 1e-12)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, draw: np.random.Generator, tried: int | None = None, l1: float = 0.0, l2: float = 0.0) -> Tree:
    """A tree of least squares (with penalties on the leaves' values), each split the best of ``tried`` random features with ``least`` rows or more on either side; equal gains go to the first feature and the lowest threshold."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        n, total = len(rows), y[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(np.sign(total) * max(abs(total) - l1, 0) / (n + l2)), n, 0.0])
        if level == depth or n < 2 * least:
            return me
        features = np.arange(x.shape[1]) if tried is None or tried >= x.shape[1] else np.sort(draw.permutation(x.shape[1])[:tried])
        part = x[np.ix_(rows, features)]
        order = np.argsort(part, axis=0, kind="stable")
        values = np.take_along_axis(part, order, 0)
        sums = np.cumsum(y[rows][order], axis=0)[:-1]
        k = np.arange(1, n)[:, None]
        gain = _score(sums, k, l1, l2) + _score(total - sums, n - k, l1, l2) - _score(total, n, l1, l2)
        gain[(values[1:] <= values[:-1]) | (k < least) | (n - k < least)] = -np.inf
        best = int(gain.T.argmax())
        f, at = divmod(best, n - 1)
        if not gain[at, f] > 1e-12:
            return me
        cut = (values[at, f] + values[at + 1, f]) / 2
        goes = part[:, f] <= cut
        nodes[me][0:2], nodes[me][6] = (int(features[f]), float(cut)), float(gain[at, f])
        nodes[me][2] = grow(rows[goes], level + 1)
        nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    grow(np.arange(len(y)), 0)
    feature, threshold, left, right, value, cover, gain = zip(*nodes)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(cover, float), np.array(gain))


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    while (inner := tree.feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        at[rows] = np.where(x[rows, tree.feature[node]] <= tree.threshold[node], tree.left[node], tree.right[node])
    return tree.value[at]


def forest(x: np.ndarray, y: np.ndarray, seed: int, trees: int = 100, depth: int = 4, least: int = 5) -> Ensemble:
    """Bagged trees that try the root of the number of features at each split."""
    draw, made = np.random.default_rng(seed), []
    for _ in range(trees):
        own = draw.integers(0, len(y), len(y))
        made.append(fit_tree(x[own], y[own], depth, least, draw, max(1, int(np.sqrt(x.shape[1])))))
    return Ensemble(0.0, 1.0 / max(trees, 1), made)


def boosted(x: np.ndarray, y: np.ndarray, seed: int, trees: int = 100, depth: int = 3, rate: float = 0.05, share: float = 0.8, least: int = 5, columns: float = 1.0, l1: float = 0.0, l2: float = 0.0) -> Ensemble:
    """Trees each fitted to what those before leave, on a share of the rows and of the features."""
    draw, base, made = np.random.default_rng(seed), float(y.mean()), []
    rest = y - base
    for _ in range(trees):
        own = np.sort(draw.permutation(len(y))[: max(1, int(len(y) * share))])
        used = np.sort(draw.permutation(x.shape[1])[: max(1, int(round(x.shape[1] * columns)))])
        tree = fit_tree(x[np.ix_(own, used)], rest[own], depth, least, draw, None, l1, l2)
        tree = tree._replace(feature=np.where(tree.feature >= 0, used[tree.feature], -1))
        made.append(tree)
        rest = rest - rate * tree_values(tree, x)
    return Ensemble(base, rate, made)


def predicted(model: Ensemble, x: np.ndarray) -> np.ndarray:
    return model.base + model.rate * np.sum([tree_values(t, x) for t in model.trees], axis=0) if model.trees else np.full(len(x), model.base)


def importances(model: Ensemble, features: int) -> np.ndarray:
    """Each feature's share of the gains, averaged over the trees that split at all."""
    out, n = np.zeros(features), 0
    for t in model.trees:
        inner = t.feature >= 0
        if inner.any():
            own = np.bincount(t.feature[inner], t.gain[inner], features)
            out, n = out + own / own.sum(), n + 1
    return out / max(n, 1)


def _leaves(tree: Tree) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Every leaf's value, and for each feature on its path the open interval that leads there with the share of rows that its splits let by."""
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        f = int(tree.feature[at])
        if f < 0:
            out.append((float(tree.value[at]), path))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, span in ((tree.left[at], (low, min(high, tree.threshold[at]))), (tree.right[at], (max(low, tree.threshold[at]), high))):
            todo.append((int(child), path | {f: (*span, share * tree.cover[child] / tree.cover[at])}))
    return out


def attributions(model: Ensemble, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean prediction along the training rows' paths, and the Shapley value of each feature for each row; they add up to the prediction.

    A feature that a coalition lacks follows both branches by the share of training rows. In one leaf this is a
    product over the features of its path, so the leaf's Shapley values come from the
    sums over coalitions by their size, built up one feature at a time.
    """
    base, out = model.base, np.zeros(x.shape)
    for tree in model.trees:
        for value, path in _leaves(tree):
            base += model.rate * value * float(np.prod([s for *_, s in path.values()]))
            d = len(path)
            if not d or not value:
                continue
            features = list(path)
            inside = np.stack([((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype(float) for f in features])
            share = [path[f][2] for f in features]
            for i, f in enumerate(features):
                by_size = np.zeros((d, len(x)))
                by_size[0] = 1
                for k in range(d):
                    if k != i:
                        grown = by_size * share[k]
                        grown[1:] += by_size[:-1] * inside[k]
                        by_size = grown
                weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
                out[:, f] += model.rate * value * (inside[i] - share[i]) * (weight @ by_size)
    return base, out


def plain_attributions(model: Ensemble, x: np.ndarray) -> np.ndarray:
    """The same from the definition, over all subsets of features: for checks on few features."""
    n = x.shape[1]

    def expected(tree: Tree, row: np.ndarray, known: frozenset, at: int = 0) -> float:
        f = tree.feature[at]
        if f < 0:
            return float(tree.value[at])
        a, b = int(tree.left[at]), int(tree.right[at])
        if f in known:
            return expected(tree, row, known, a if row[f] <= tree.threshold[at] else b)
        return (tree.cover[a] * expected(tree, row, known, a) + tree.cover[b] * expected(tree, row, known, b)) / tree.cover[at]

    out = np.zeros(x.shape)
    for r, row in enumerate(x):
        for i in range(n):
            others = [k for k in range(n) if k != i]
            for size in range(n):
                weight = factorial(size) * factorial(n - 1 - size) / factorial(n)
                for some in combinations(others, size):
                    s = frozenset(some)
                    out[r, i] += weight * model.rate * sum(expected(t, row, s | {i}) - expected(t, row, s) for t in model.trees)
    return out
