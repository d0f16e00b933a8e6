"""Heads for a probe other than the logistic one. All fit the models of every repeat and fold in the same passes, from sums over rows.

A head is called with the rows (x, c, y, fold), the numbers of features, covariates, folds and repeats, and the
classes; what it gives has ``classes``, ``scales`` (repeats by folds) and ``score`` (siftline.operators.linear.Models).

Defined cases are those of the logistic head; a training set with one class only gives no scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siftline.operators.linear import Models, auto_pca, matrix, moments, scale_of, total


@dataclass
class Perceptron:
    """One hidden layer of rectified units and a softmax over the classes (and "any other" for a single class)."""

    classes: list[int]
    scales: np.ndarray
    layers: np.ndarray  # object array (rep, fold) of flat weights, None where there is no model
    hidden: int
    outputs: int

    def score(self, x: np.ndarray, cov: np.ndarray, r: int, j: int) -> np.ndarray:
        if self.layers[r, j] is None:
            return np.full((len(x), len(self.classes)), np.nan)
        p = forward(self.layers[r, j], self.scales[r, j](x, cov), self.hidden, self.outputs)[2]
        return p[:, 1:] if len(self.classes) == 1 else p


def parts(w: np.ndarray, width: int, hidden: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    at = (width + 1) * hidden
    return w[:at].reshape(width + 1, hidden), w[at:].reshape(hidden + 1, outputs)


def forward(w: np.ndarray, z: np.ndarray, hidden: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs with a one, hidden with a one, probabilities)."""
    a, b = parts(w, z.shape[1], hidden, outputs)
    z1 = np.column_stack([np.ones(len(z)), z])
    h1 = np.column_stack([np.ones(len(z)), np.maximum(z1 @ a, 0)])
    o = h1 @ b
    e = np.exp(o - o.max(1, keepdims=True))
    return z1, h1, e / e.sum(1, keepdims=True)


class Descent:
    """Limited-memory quasi-Newton search for one model, asked and told: ``at`` is where loss and slope are wanted next."""

    def __init__(self, w: np.ndarray, memory: int = 10, patience: int = 10, tolerance: float = 1e-4):
        self.w, self.at, self.memory, self.patience, self.tolerance = w, w, memory, patience, tolerance
        self.f, self.g, self.d, self.t, self.past, self.still, self.done = np.inf, None, None, 1.0, [], 0, False

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.g is not None and f > self.f + 1e-4 * self.t * (self.g @ self.d):
            self.t /= 2  # too far
            self.done = self.t < 1e-10
            self.at = self.w + self.t * self.d
            return
        if self.g is not None:
            s, y = self.at - self.w, g - self.g
            if s @ y > 1e-12:
                self.past = [*self.past[1 - self.memory :], (s, y)]
            self.still = self.still + 1 if self.f - f < self.tolerance else 0
            self.done = self.still >= self.patience
        self.w, self.f, self.g = self.at, f, g
        q, alphas = g.copy(), []
        for s, y in reversed(self.past):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        if self.past:
            s, y = self.past[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), alpha in zip(self.past, reversed(alphas), strict=True):
            q += (alpha - y @ q / (s @ y)) * s
        self.d, self.t = -q, 1.0
        if g @ self.d > 0:
            self.d, self.past = -g, []
        self.at = self.w + self.d


def perceptron(hidden: int = 32, alpha: float = 1.0, steps: int = 800):
    """A head: mean log-loss and alpha / (2 rows) times the squared weights (not those of ones); ends when ten steps in a row gain under 1e-4, or after ``steps``."""

    def fit(df: DataFrame, width: int, covariates: int, k: int, reps: int, classes: list[int]) -> Models:
        fill, g = moments(df, width, covariates, k, reps)
        scales, search = np.empty((reps, k), object), {}
        outputs = 2 if len(classes) == 1 else len(classes)
        counts = total(df.select("y", "fold"), lambda b: np.array([[((b["y"].to_numpy() == t) & (np.stack(b["fold"].to_list())[:, r] != j)).sum() for t in classes] for r in range(reps) for j in range(k)], float).ravel()).reshape(reps, k, len(classes))
        for r in range(reps):
            for j in range(k):
                train = g[r].sum(0) - g[r, j]
                n = train[0, 0]
                scales[r, j] = scale_of(fill, train, covariates, auto_pca(n, width))
                if n and (counts[r, j] > 0).all() and (len(classes) > 1 or counts[r, j][0] < n):
                    dims, rng = scales[r, j].turn.shape[1], np.random.default_rng([r, j])
                    a, b = np.zeros((dims + 1, hidden)), np.zeros((hidden + 1, outputs))
                    a[1:], b[1:] = (rng.uniform(-1, 1, (m, o)) * np.sqrt(6 / (m + o)) for m, o in ((dims, hidden), (hidden, outputs)))
                    search[r, j] = Descent(np.concatenate([a.ravel(), b.ravel()]))
        rows = {at: (g[at[0]].sum(0) - g[at])[0, 0] for at in search}
        for _ in range(steps):
            now = {at: s.at for at, s in search.items() if not s.done}
            if not now:
                break

            def slopes(pdf: pd.DataFrame, now: dict = now) -> np.ndarray:
                x, cov, y, f, out = matrix(pdf["x"], width), matrix(pdf["c"], covariates), pdf["y"].to_numpy(), np.stack(pdf["fold"].to_list()), []
                t = (y == classes[0]).astype(int) if len(classes) == 1 else np.searchsorted(classes, y)
                for (r, j), w in now.items():
                    use = f[:, r] != j
                    z1, h1, p = forward(w, scales[r, j](x[use], cov[use]), hidden, outputs)
                    loss = -np.log(np.maximum(p[np.arange(len(p)), t[use]], 1e-300)).sum()
                    e = p.copy()
                    e[np.arange(len(p)), t[use]] -= 1
                    b = parts(w, z1.shape[1] - 1, hidden, outputs)[1]
                    back = (e @ b[1:].T) * (h1[:, 1:] > 0)
                    out += [[loss], (z1.T @ back).ravel(), (h1.T @ e).ravel()]
                return np.concatenate(out)

            s, at = total(df.select("x", "c", "y", "fold"), slopes), 0
            for key, w in now.items():
                n, dims = rows[key], scales[key].turn.shape[1]
                a, b = parts(w.copy(), dims, hidden, outputs)
                a[0], b[0] = 0, 0  # the weights of ones aren't shrunk
                flat = np.concatenate([a.ravel(), b.ravel()])
                search[key].tell((s[at] + alpha / 2 * flat @ flat) / n, (s[at + 1 : at + 1 + len(w)] + alpha * flat) / n)
                at += 1 + len(w)
        layers = np.empty((reps, k), object)
        for key, s in search.items():
            layers[key] = s.w
        return Perceptron(classes, scales, layers, hidden, outputs)

    return fit


def discriminant(df: DataFrame, width: int, covariates: int, k: int, reps: int, classes: list[int]) -> Models:
    """A head in closed form: the difference of each class's mean from the others', by the inverse of the training set's covariance within both."""
    fill, g = moments(df, width, covariates, k, reps)
    scales = np.empty((reps, k), object)
    for r in range(reps):
        for j in range(k):
            scales[r, j] = scale_of(fill, g[r].sum(0) - g[r, j], covariates)

    def sums(b: pd.DataFrame) -> np.ndarray:
        x, cov, y, f, out = matrix(b["x"], width), matrix(b["c"], covariates), b["y"].to_numpy(), np.stack(b["fold"].to_list()), []
        for r in range(reps):
            for j in range(k):
                use = f[:, r] != j
                z = np.column_stack([np.ones(use.sum()), scales[r, j](x[use], cov[use])])
                out += [(z.T @ z).ravel(), *(z[y[use] == t].sum(0) for t in classes)]
        return np.concatenate(out)

    q = width + 1
    s = total(df.select("x", "c", "y", "fold"), sums).reshape(reps, k, -1)
    weights = np.full((len(classes), reps, k, q), np.nan)
    for r in range(reps):
        for j in range(k):
            whole = s[r, j, : q * q].reshape(q, q)
            for i in range(len(classes)):
                own = s[r, j, q * q + i * q : q * q + (i + 1) * q]
                n, n1 = whole[0, 0], own[0]
                if 0 < n1 < n:
                    m1, m0 = own[1:] / n1, (whole[0, 1:] - own[1:]) / (n - n1)
                    within = (whole[1:, 1:] - n1 * np.outer(m1, m1) - (n - n1) * np.outer(m0, m0)) / max(n - 2, 1) + 1e-6 * np.eye(width)
                    w = np.linalg.solve(within, m1 - m0)
                    weights[i, r, j] = np.concatenate([[-w @ (m1 + m0) / 2], w])
    return Models(classes, scales, weights)
