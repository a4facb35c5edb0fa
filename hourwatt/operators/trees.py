"""Regression trees from histograms of binned features, for one model's training rows.

One model sees the hours of one series in one training window: a few ten thousand rows, a bound set by time. Spark
spreads models over tasks (``plans/model_table.py``); this module grows the trees of one of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BINS = 255


@dataclass(frozen=True)
class Growth:
    """How an ensemble grows. ``step`` 0 averages independent trees (a forest) instead of adding corrections."""

    trees: int
    step: float
    leaves: int | None = None
    depth: int | None = None
    min_rows: int = 1
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    bootstrap: bool = False


# The forest and the three boosted configurations.
GROWTHS = {
    "random_forest": Growth(trees=200, step=0.0, depth=18, min_rows=5, bootstrap=True),
    "hist_gradient_boosting": Growth(trees=300, step=0.05, leaves=31, min_rows=20, l2=0.1),
    "lightgbm": Growth(trees=600, step=0.03, leaves=31, min_rows=20, l1=0.1, l2=1.0, row_share=0.9, column_share=0.9),
    "xgboost": Growth(trees=600, step=0.03, depth=6, min_rows=5, l1=0.1, l2=1.0, row_share=0.9, column_share=0.9),
}


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has ``left`` -1. Rows with ``x <= threshold`` go left."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]


def cut_points(column: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, or between quantiles where there are more than ``BINS`` values."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="lower"))
    return (values[:-1] + values[1:]) / 2


class _Grower:
    def __init__(self, x: np.ndarray, growth: Growth) -> None:
        self.growth = growth
        self.cuts = [cut_points(x[:, f]) for f in range(x.shape[1])]
        self.width = max((len(c) for c in self.cuts), default=0) + 1
        bins = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)]
        self.bins = np.stack(bins, axis=1)
        self.places = self.bins + np.arange(x.shape[1]) * self.width

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        shrunk = np.maximum(np.abs(g) - self.growth.l1, 0.0)
        return shrunk * shrunk / (h + self.growth.l2 + 1e-300)

    def _value(self, g: float, h: float) -> float:
        return float(-np.sign(g) * max(abs(g) - self.growth.l1, 0.0) / (h + self.growth.l2)) if h > 0 else 0.0

    def _histogram(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = self.places[rows].ravel(), len(self.cuts) * self.width
        shape = (len(self.cuts), self.width)
        wide = np.repeat(g[rows], shape[0]), np.repeat(h[rows], shape[0])
        return np.bincount(at, wide[0], size).reshape(shape), np.bincount(at, wide[1], size).reshape(shape)

    def _split(self, sums: tuple[np.ndarray, np.ndarray], total: tuple[float, float], columns: np.ndarray) -> tuple[float, int, int]:
        """The best (gain, feature, bin): rows up to the bin go left. Ties go to the first feature and bin."""
        g, h = np.cumsum(sums[0], axis=1)[:, :-1], np.cumsum(sums[1], axis=1)[:, :-1]
        if not g.size:
            return 0.0, 0, 0
        rest = total[1] - h
        gain = self._score(g, h) + self._score(total[0] - g, rest) - self._score(np.float64(total[0]), np.float64(total[1]))
        least = max(self.growth.min_rows, 1e-9)
        gain[(h < least) | (rest < least) | ~columns[:, None]] = 0.0
        best = int(np.argmax(gain))
        return float(gain.flat[best]), best // g.shape[1], best % g.shape[1]

    def tree(self, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree grown best split first, and the leaf value of every row."""
        growth, out, fitted = self.growth, Tree([], [], [], [], [], []), np.zeros(len(g))
        most = growth.leaves or len(g)
        waiting: list[tuple] = []

        def node(rows: np.ndarray, sums: tuple[np.ndarray, np.ndarray], depth: int) -> int:
            total = float(g[rows].sum()), float(h[rows].sum())
            number = len(out.feature)
            value = self._value(*total)
            for column, v in ((out.feature, -1), (out.threshold, 0.0), (out.left, -1), (out.right, -1), (out.value, value), (out.gain, 0.0)):
                column.append(v)
            fitted[rows] = value
            if (growth.depth is None or depth < growth.depth) and total[1] >= 2 * growth.min_rows:
                gain, feature, last = self._split(sums, total, columns)
                if gain > 1e-12:
                    heapq.heappush(waiting, (-gain, number, feature, last, rows, sums, depth))
            return number

        all_rows = np.flatnonzero(h > 0)
        node(all_rows, self._histogram(all_rows, g, h), 0)
        leaves = 1
        while waiting and leaves < most:
            gain, number, feature, last, rows, sums, depth = heapq.heappop(waiting)
            goes_left = self.bins[rows, feature] <= last
            left, right = rows[goes_left], rows[~goes_left]
            # The smaller side is counted, the larger one is what is left.
            small = self._histogram(left if len(left) <= len(right) else right, g, h)
            large = sums[0] - small[0], sums[1] - small[1]
            sides = (small, large) if len(left) <= len(right) else (large, small)
            out.feature[number], out.threshold[number], out.gain[number] = feature, float(self.cuts[feature][last]), -gain
            out.left[number] = node(left, sides[0], depth + 1)
            out.right[number] = node(right, sides[1], depth + 1)
            out.value[number] = 0.0
            leaves += 1
        return out, fitted


def grow(x: np.ndarray, y: np.ndarray, growth: Growth, seed: int) -> Iterator[Tree]:
    """The trees of one ensemble over rows without gaps, their leaf values scaled so that they are only added up.

    The first one is a single leaf, the mean, for boosting. Squared error: a row's gradient is its error.
    """
    rng = np.random.default_rng(seed)
    grower = _Grower(x, growth)
    n, features = x.shape
    scale = growth.step or 1.0 / growth.trees
    now = np.zeros(n)
    if growth.step:
        now += y.mean()
        yield Tree([-1], [0.0], [-1], [-1], [float(y.mean())], [0.0])
    for _ in range(growth.trees):
        weights = np.ones(n)
        if growth.bootstrap:
            weights = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
        elif growth.row_share < 1:
            weights = np.zeros(n)
            weights[rng.permutation(n)[: max(1, round(n * growth.row_share))]] = 1.0
        columns = np.zeros(features, bool)
        columns[rng.permutation(features)[: max(1, round(features * growth.column_share))]] = True
        tree, _ = grower.tree((now - y) * weights, weights, columns)
        tree.value = [v * scale for v in tree.value]
        if growth.step:
            now += tree_values(tree, x)
        yield tree


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """What a tree gives each row."""
    left, right = np.asarray(tree.left), np.asarray(tree.right)
    feature, threshold = np.asarray(tree.feature), np.asarray(tree.threshold)
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return np.asarray(tree.value)[at]
        going = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(inner, np.where(going, left[at], right[at]), at)
