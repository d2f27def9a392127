"""Small gradient-boosted trees: trained with numpy on the driver, calibrated on other rows, applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf has value only; else rows with feature <= cut go to low, the others to high."""

    value: float = 0.0
    feature: str = ""
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass(frozen=True)
class Boosted:
    """start: log-odds before all trees. cuts: for each group of candidates, the least log-odds that is accepted."""

    trees: tuple[Node, ...]
    start: float
    cuts: tuple[tuple[str, float], ...] = ()

    def score(self, feature) -> Column:
        """Log-odds as a column; feature(name) gives a feature's column."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _column(tree, feature)
        return total

    def least(self, group: Column) -> Column:
        """The least log-odds accepted in a group; zero for groups that weren't calibrated."""
        out = F.lit(0.0)
        for name, cut in self.cuts:
            out = F.when(group == name, F.lit(cut)).otherwise(out)
        return out

    def scores(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(rows.values())))
        total = np.full(n, self.start)
        for tree in self.trees:
            total += _values(tree, rows, n)
        return total

    def probability(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.scores(rows)))


def _column(node: Node, feature) -> Column:
    if node.low is None:
        return F.lit(float(node.value))
    return F.when(feature(node.feature) <= F.lit(float(node.cut)), _column(node.low, feature)).otherwise(_column(node.high, feature))


def _values(node: Node, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    if node.low is None:
        return np.full(n, node.value)
    return np.where(rows[node.feature] <= node.cut, _values(node.low, rows, n), _values(node.high, rows, n))


def _grow(rows, slope, curve, at, depth, least):
    """A tree on rows at, by the gain of second-order boosting with an L2 penalty of 1."""
    g, h = slope[at].sum(), curve[at].sum()
    best = (1e-6, None)
    if depth:
        for name, column in rows.items():
            x = column[at]
            order = np.argsort(x, kind="stable")
            xs, gs, hs = x[order], np.cumsum(slope[at][order])[:-1], np.cumsum(curve[at][order])[:-1]
            ok = xs[1:] > xs[:-1]
            ok &= (np.arange(1, len(xs)) >= least) & (len(xs) - np.arange(1, len(xs)) >= least)
            if ok.any():
                gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, float((xs[k] + xs[k + 1]) / 2)))
    if best[1] is None:
        return Node(value=round(float(-g / (h + 1)), 6))
    name, cut = best[1]
    low = rows[name][at] <= cut
    return Node(0.0, name, cut, _grow(rows, slope, curve, at[low], depth - 1, least), _grow(rows, slope, curve, at[~low], depth - 1, least))


def _shrunk(node: Node, rate: float) -> Node:
    if node.low is None:
        return Node(value=round(node.value * rate, 6))
    return Node(0.0, node.feature, node.cut, _shrunk(node.low, rate), _shrunk(node.high, rate))


def train(rows: dict[str, np.ndarray], label: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4, least: int = 5) -> Boosted:
    fit = {k: v.astype(float) for k, v in rows.items()}
    y = label.astype(float)
    start = round(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 6)
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _shrunk(_grow(fit, p - y, p * (1 - p), np.arange(len(y)), depth, least), rate)
        trees.append(tree)
        total = total + _values(tree, fit, len(y))
    return Boosted(tuple(trees), start)


def isotonic(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in ascending order (each once) and the probabilities, never falling, that fit the labels best."""
    kinds, inverse = np.unique(scores, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, label) / weight
    pools: list[list[float]] = []  # mean, weight, number of scores
    for m, w in zip(mean.tolist(), weight.tolist(), strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return kinds, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def calibrated(model: Boosted, rows: dict[str, np.ndarray], label: np.ndarray, group: np.ndarray, least: dict[str, float]) -> Boosted:
    """model with a cut for each group: the least score whose calibrated probability, by isotonic regression over the group's
    rows, reaches least[group]. Rows should be others than those of the training. A group that never reaches it accepts none."""
    scores, cuts = model.scores({k: v.astype(float) for k, v in rows.items()}), []
    for name in sorted(least):
        at = group == name
        kinds, probability = isotonic(scores[at], label[at].astype(float))
        good = np.flatnonzero(probability >= least[name])
        if not len(good):
            cuts.append((name, float("inf")))
            continue
        below = kinds[good[0] - 1] if good[0] else kinds[good[0]] - 1.0
        cuts.append((name, round(float(kinds[good[0]] + below) / 2, 6)))  # halfway to the score that is refused
    return Boosted(model.trees, model.start, tuple(cuts))
