"""Gradient-boosted regression trees on a small table of numbers, written out as SQL.

Fitting takes a bounded sample in the driver; scoring is a sum of nested IF expressions that Spark evaluates.
"""

from __future__ import annotations

import numpy as np

#: A node: (feature, threshold, left, right), or a leaf's value.
Node = tuple | float


def _grow(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]) -> Node:
    def leaf() -> float:
        return float(residual.sum() / (hessian.sum() + 1.0))

    if depth == 0 or len(x) < 2 * least:
        return leaf()
    best = (1e-9, None, None)
    base = residual.sum() ** 2 / (hessian.sum() + 1.0)
    for f, own in enumerate(cuts):
        for cut in own:
            left = x[:, f] <= cut
            n = int(left.sum())
            if n < least or len(x) - n < least:
                continue
            g, h = residual[left].sum(), hessian[left].sum()
            gain = g * g / (h + 1.0) + (residual.sum() - g) ** 2 / (hessian.sum() - h + 1.0) - base
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf()
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], *(_grow(x[side], residual[side], hessian[side], depth - 1, least, cuts) for side in (left, ~left)))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, left, right = node
    return np.where(x[:, f] <= cut, _value(left, x), _value(right, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5) -> tuple[float, list[Node]]:
    """Log-odds of the base rate and the trees of a logistic booster."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1])) for f in range(x.shape[1])]
    score, found = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, least, cuts)
        found.append(tree)
        score = score + rate * _value(tree, x)
    return start, found


def predict(model: tuple[float, list[Node]], x: np.ndarray, rate: float = 0.3) -> np.ndarray:
    start, trees = model
    return start + rate * sum((_value(t, x) for t in trees), np.zeros(len(x)))


def to_sql(model: tuple[float, list[Node]], names: list[str], rate: float = 0.3) -> str:
    """The log-odds as SQL over columns or fields with these names."""

    def text(node: Node) -> str:
        if not isinstance(node, tuple):
            return f"{node:.6g}D"
        f, cut, left, right = node
        return f"if({names[f]} <= {cut:.6g}D, {text(left)}, {text(right)})"

    start, trees = model
    return " + ".join([f"{start:.6g}D", *(f"{rate}D * {text(t)}" for t in trees)])


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of true cases, with one false case added, is at least precision.

    Infinite where no score reaches it.
    """
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / (np.arange(len(y)) + 2)
    last = np.append(score[order][1:] != score[order][:-1], True)[: len(y)]
    fine = np.flatnonzero((share >= precision) & last)
    return float(score[order][fine[-1]]) if len(fine) else float("inf")
