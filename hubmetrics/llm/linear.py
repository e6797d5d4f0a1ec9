"""Logistic regression on sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """``value[k]`` stands in row ``row[k]`` and column ``column[k]``."""

    rows: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.rows)

    def pulled(self, x: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * x[self.row], minlength=columns)


def sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    """From pairs (columns, values)."""
    sizes = [len(c) for c, _ in rows]
    none = np.empty(0)
    return Sparse(
        len(rows), np.repeat(np.arange(len(rows)), sizes),
        np.concatenate([c for c, _ in rows] or [none]).astype(np.int64), np.concatenate([v for _, v in rows] or [none]).astype(float),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(
    x: Sparse, target: np.ndarray, columns: int, l2: float = 1e-4, swaps: Sparse | None = None, swap_weight: float = 0.0,
    weight: np.ndarray | None = None, steps: int = 400, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets between 0 and 1.

    ``swaps`` holds differences of rows that should score alike; the mean of their squared scores is a penalty. Every
    step uses all rows, so the result depends on the rows only, not on an order or a seed.
    """
    w, b = np.zeros(columns), 0.0
    if not x.rows:
        return w, b
    weight = np.ones(x.rows) if weight is None else weight
    weight = weight / weight.sum()
    share = np.clip((weight * target).sum(), 1e-6, 1 - 1e-6)
    b = float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(columns), np.zeros(columns), 0.0, 0.0
    for step in range(1, steps + 1):
        off = weight * (sigmoid(x.times(w) + b) - target)
        g = x.pulled(off, columns) + l2 * w
        gb = float(off.sum())
        if swaps is not None and swaps.rows:
            g += 2 * swap_weight / swaps.rows * swaps.pulled(swaps.times(w), columns)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b
