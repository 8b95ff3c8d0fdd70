"""A small random forest, grown on the driver from a bounded table and scored as a SQL expression."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np


@dataclass(slots=True)
class Leaf:
    share: float


@dataclass(slots=True)
class Split:
    feature: int
    limit: float
    low: Leaf | Split
    high: Leaf | Split


def _grow(x: np.ndarray, y: np.ndarray, r: random.Random, depth: int, least: int, tried: int):
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Leaf(share)
    best = None
    for f in r.sample(range(x.shape[1]), tried):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        impurity = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        impurity[(v[:-1] == v[1:]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(impurity.argmin())
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
            best = (impurity[k], f, float(v[k] + v[k + 1]) / 2)
    if best is None:
        return Leaf(share)
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], y[low], r, depth - 1, least, tried), _grow(x[~low], y[~low], r, depth - 1, least, tried))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, least: int = 4, seed: int = 11) -> list:
    """Trees on bootstrap samples, each split chosen from a random third of the features."""
    r = random.Random(seed)
    out = []
    for _ in range(trees):
        rows = np.array([r.randrange(len(y)) for _ in range(len(y))])
        out.append(_grow(x[rows], y[rows].astype(float), r, depth, least, max(2, x.shape[1] // 3)))
    return out


def predict(trees: list, row) -> float:
    total = 0.0
    for node in trees:
        while isinstance(node, Split):
            node = node.low if row[node.feature] <= node.limit else node.high
        total += node.share
    return total / len(trees)


def as_sql(trees: list, names: list[str]) -> str:
    """The mean of the leaves' shares over features that have these names."""

    def tree(node) -> str:
        if isinstance(node, Leaf):
            return f"{node.share!r}D"
        return f"CASE WHEN {names[node.feature]} <= {node.limit!r}D THEN {tree(node.low)} ELSE {tree(node.high)} END"

    return "(" + " + ".join(f"({tree(t)})" for t in trees) + f") / {len(trees)}D"
