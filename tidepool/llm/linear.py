"""Sparse linear models fitted on the driver from a bounded sample, and applied to whole texts on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sets of feature numbers, one per row: ``index[start[i]:start[i + 1]]``."""

    index: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def counts(self, labels: np.ndarray, width: int) -> np.ndarray:
        """In how many of the rows with a true label each feature occurs."""
        return np.bincount(self.index[np.repeat(labels, np.diff(self.start))], minlength=width)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.index])])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def pick(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(sizes)])
        index = np.concatenate([self.index[self.start[r] : self.start[r + 1]] for r in rows]) if len(rows) else self.index[:0]
        return Rows(index, start)

    def keep(self, wanted: np.ndarray) -> Rows:
        """Only the features in ``wanted`` (sorted), numbered by their places there."""
        place = np.minimum(np.searchsorted(wanted, self.index), max(len(wanted) - 1, 0))
        known = wanted[place] == self.index if len(wanted) else np.zeros(len(self.index), bool)
        owner = np.repeat(np.arange(len(self)), np.diff(self.start))[known]
        return Rows(place[known], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self)))]))


def rows_of(lists: list[np.ndarray]) -> Rows:
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return Rows(np.concatenate(lists).astype(np.int32, copy=False) if lists else np.zeros(0, np.int32), start)


def log_count_ratio(rows: Rows, labels: np.ndarray, width: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes: the log of how much more often each indicator occurs in rows with label 1."""
    p, q = rows.counts(labels, width) + smooth, rows.counts(~labels, width) + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: Rows, scale: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 0, balance: bool = True, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with squared hinge loss on the scaled indicators, by dual coordinate descent.

    The bias is the weight of a feature that every row has. With ``balance`` both classes weigh alike.
    """
    sign = np.where(labels, 1.0, -1.0)
    share = np.where(labels, max(labels.mean(), 1e-9), max(1 - labels.mean(), 1e-9))
    loss = 1 / (2 * cost * (0.5 / share if balance else np.ones(len(rows))))
    weights, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    parts = [rows.index[rows.start[i] : rows.start[i + 1]] for i in range(len(rows))]
    values = [scale[p] for p in parts]
    square = np.array([v @ v + 1.0 for v in values]) + loss
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (values[i] @ weights[parts[i]] + bias) - 1 + loss[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            most = max(most, abs(slope))
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            alpha[i] += step
            weights[parts[i]] += step * sign[i] * values[i]
            bias += step * sign[i]
        if most < tolerance:
            break
    return weights, bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset with which a sigmoid of the margins gives probabilities (Platt's method, by Newton steps)."""
    n, p = len(labels), int(labels.sum())
    target = np.where(labels, (p + 1) / (p + 2), 1 / (n - p + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = sigmoid(a * margins + b)
        g, h = s - target, np.maximum(s * (1 - s), 1e-9)
        ga, gb = float(g @ margins) + 1e-6 * a, float(g.sum())
        haa, hab, hbb = float(h @ margins**2) + 1e-6, float(h @ margins), float(h.sum()) + 1e-9
        d = haa * hbb - hab * hab
        da, db = ((hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d) if abs(d) > 1e-12 else (0.0, gb / hbb)
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def logistic(rows: Rows, extra: np.ndarray, labels: np.ndarray, width: int, ridge: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights (features, then extra columns, then bias) of a logistic model with an L2 penalty, by accelerated gradient steps."""
    n, m = len(rows), extra.shape[1]
    owner = np.repeat(np.arange(n), np.diff(rows.start))
    weights = np.zeros(width + m + 1)
    ahead, last, target = weights.copy(), 1.0, labels.astype(float)
    # each column's own bound of the curvature: a quarter of the row sums of the rows that have it
    full = np.diff(rows.start) + np.abs(extra).sum(axis=1) + 1
    bound = np.concatenate([np.bincount(rows.index, full[owner], minlength=width), np.abs(extra).T @ full, [full.sum()]])
    pace = 1 / (0.25 * bound + ridge)
    for _ in range(steps):
        margin = rows.dot(ahead[:width]) + extra @ ahead[width:-1] + ahead[-1]
        gap = sigmoid(margin) - target
        slope = np.concatenate([np.bincount(rows.index, gap[owner], minlength=width), extra.T @ gap, [gap.sum()]])
        slope[:-1] += ridge * ahead[:-1]
        new = ahead - pace * slope
        now = (1 + (1 + 4 * last * last) ** 0.5) / 2
        ahead, weights, last = new + (last - 1) / now * (new - weights), new, now
    return weights
