"""Clusters by sums over rows: k-means, diagonal Gaussian mixtures, stability under subsampling.

Every iteration is one pass that handles all candidates (numbers of clusters, starts, replicates) together;
only centres and their sums reach the driver. Starts are drawn from a bounded sample of START rows by hash
(a parameter of the start only; all rows are assigned and counted).

Defined cases: rows with a null id or feature array are left out, null or NaN features count as the mean;
fewer rows than clusters give as many clusters as there are distinct rows; an empty table gives no row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.linear import Scale, matrix, moments, scale_of, total
from siftline.operators.ranks import hash_unit
from siftline.session import balanced, cut

START = 2_000


def reduced(df: DataFrame, id_: str, x: str) -> tuple[DataFrame, int]:
    """(id, z: whitened principal components; their number max(2, min(20, width - 1, rows // 5)))."""
    v = cut(df.where(F.col(id_).isNotNull() & F.col(x).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(x).cast("array<double>").alias("x"), F.array().cast("array<double>").alias("c"), F.array(F.lit(0)).alias("fold")))
    s = v.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).first()
    if not s["n"]:
        return v.select("id", F.col("x").alias("z")), 0
    fill, g = moments(v, s["w"], 0, 1, 1)
    dims = min(s["w"], max(2, min(20, s["w"] - 1, s["n"] // 5)))
    scale: Scale = scale_of(fill, g[0, 0], 0, dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = scale(matrix(b["x"], s["w"]), np.zeros((len(b), 0)))
            yield pd.DataFrame({"id": b["id"], "z": list(z)})

    return cut(v.select("id", "x").mapInPandas(run, "id string, z array<double>")), dims


def _sample(df: DataFrame, dims: int) -> np.ndarray:
    rows = df.orderBy(hash_unit(F.col("id"), F.lit("start")), "id").limit(START).collect()
    return np.array([r["z"] for r in rows], float).reshape(-1, dims)


def _starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows far from each other (k-means++)."""
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(c)


def _weights(ids: pd.Series, b: int, share: float) -> np.ndarray:
    """(rows, b): which rows are in each subsample, by hash."""
    h = pd.util.hash_array(ids.to_numpy(object), categorize=False)
    with np.errstate(over="ignore"):
        mixed = (h[:, None] ^ (np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(11)) / float(2**53) < share


def kmeans(df: DataFrame, dims: int, ks: list[int], starts: int = 10, subsamples: int = 0, share: float = 0.8, steps: int = 300) -> dict:
    """{k: (centres, cost)}, the best of the starts for each k; with subsamples (one k only) the centres of each.

    df: id, z (checkpointed). All candidates move in the same passes.
    """
    x, rng = _sample(df, dims), np.random.default_rng(0)
    if not len(x):
        return {}
    ks = [k for k in ks if k <= len(np.unique(x, axis=0))] or [1]
    jobs = [(k, s) for k in ks for s in range(subsamples or starts)]
    centres = [_starts(x, k, rng) for k, _ in jobs]
    cost, moving = np.full(len(jobs), np.inf), list(range(len(jobs)))
    df = balanced(df, 5_000)
    for _ in range(steps):
        now = {j: centres[j].copy() for j in moving}

        def sums(b: pd.DataFrame, now: dict = now) -> np.ndarray:
            z = matrix(b["z"], dims)
            w = _weights(b["id"], subsamples, share) if subsamples else None
            c = np.concatenate(list(now.values()))
            far, at, out = (z**2).sum(1)[:, None] - 2 * z @ c.T + (c**2).sum(1), 0, []  # of all candidates at once
            for j, own in now.items():
                d = far[:, at : at + len(own)]
                at += len(own)
                near, take = d.argmin(1), w[:, j].astype(float) if w is not None else np.ones(len(z))
                one = np.eye(len(own))[near] * take[:, None]
                out += [(one.T @ z).ravel(), one.sum(0), [(d.min(1) * take).sum()]]
            return np.concatenate(out)

        s, at, still = total(df, sums), 0, []
        for j in moving:
            k = len(centres[j])
            t, n = s[at : at + k * dims].reshape(k, dims), s[at + k * dims : at + k * dims + k]
            cost[j] = s[at + k * dims + k]
            at += k * dims + k + 1
            new = np.where(n[:, None] > 0, t / np.maximum(n, 1)[:, None], centres[j])
            if ((new - centres[j]) ** 2).sum() > 1e-4:  # of features of variance 1
                still.append(j)
            centres[j] = new
        moving = still  # candidates that have settled leave the passes
        if not moving:
            break
    else:
        if steps >= 100:  # fewer are asked for on purpose
            warnings.warn(f"{len(moving)} of {len(jobs)} sets of centres still move after {steps} steps", stacklevel=2)
    if subsamples:
        return {ks[0]: centres}
    return {k: min(((centres[j], cost[j]) for j, (q, _) in enumerate(jobs) if q == k), key=lambda c: c[1]) for k in ks}


def labels(df: DataFrame, dims: int, centres: np.ndarray) -> DataFrame:
    """id, cluster (nearest centre), silhouette (simplified: by distances to centres)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = matrix(b["z"], dims)
            d = np.sqrt(np.maximum((z**2).sum(1)[:, None] - 2 * z @ centres.T + (centres**2).sum(1), 0))
            two = np.sort(d, 1)[:, :2] if len(centres) > 1 else np.column_stack([d, d])
            yield pd.DataFrame({"id": b["id"], "cluster": d.argmin(1) if len(b) else [], "silhouette": (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-12)})

    return df.mapInPandas(run, "id string, cluster int, silhouette double")


def choose_k(df: DataFrame, dims: int, ks: list[int]) -> tuple[int, np.ndarray, DataFrame]:
    """(k, centres, labels) of the largest mean simplified silhouette; distances to centres need no pairs of rows."""
    found = kmeans(df, dims, ks)

    def score(b: pd.DataFrame) -> np.ndarray:
        z, out = matrix(b["z"], dims), [float(len(b))]
        for c, _ in found.values():
            d = np.sort(np.sqrt(np.maximum((z**2).sum(1)[:, None] - 2 * z @ c.T + (c**2).sum(1), 0)), 1)
            out.append(((d[:, 1] - d[:, 0]) / np.maximum(d[:, 1], 1e-12)).sum() if len(c) > 1 else 0.0)
        return np.array(out)

    s = total(df, score)
    k = max(zip(s[1:], found, strict=True))[1]
    return k, found[k][0], cut(labels(df, dims, found[k][0]))


def stability(df: DataFrame, dims: int, centres: np.ndarray, b: int = 50, share: float = 0.8) -> list[float]:
    """For each cluster the mean over subsamples of its best Jaccard overlap with the clusters found there (greedy, one to one)."""
    k = len(centres)
    subs = kmeans(df, dims, [k], subsamples=b, share=share)[k]

    def table(pdf: pd.DataFrame) -> np.ndarray:
        z, w, out = matrix(pdf["z"], dims), _weights(pdf["id"], b, share), []
        near = lambda c: np.eye(len(c))[((z**2).sum(1)[:, None] - 2 * z @ c.T + (c**2).sum(1)).argmin(1)]
        ref = near(centres)
        for j, c in enumerate(subs):
            out.append(((ref * w[:, j : j + 1]).T @ near(c)).ravel())
        return np.concatenate(out)

    t = total(df, table).reshape(b, k, k)
    out = np.zeros(k)
    for m in t:
        j = m / np.maximum(m.sum(1)[:, None] + m.sum(0)[None, :] - m, 1e-12)
        for _ in range(k):
            r, c = np.unravel_index(j.argmax(), j.shape)
            out[r] += max(j[r, c], 0)
            j[r, :], j[:, c] = -1, -1
    return (out / b).tolist()


def mixture(df: DataFrame, dims: int, ks: list[int], steps: int = 100) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """{k: (weights, means, variances, BIC)} of diagonal Gaussian mixtures, by expectation and maximisation in shared passes."""
    init = kmeans(df, dims, ks, steps=5)
    par = {k: (np.full(len(c), 1 / len(c)), c, np.ones_like(c)) for k, (c, _) in init.items()}
    last, out = None, {}
    df = balanced(df, 5_000)
    for _ in range(steps):
        now = dict(par)

        def sums(b: pd.DataFrame) -> np.ndarray:
            z, parts = matrix(b["z"], dims), [[float(len(b))]]
            for w, m, v in now.values():
                ll = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(1) + ((z**2) @ (1 / v).T - 2 * z @ (m / v).T + (m**2 / v).sum(1)))
                top = ll.max(1, keepdims=True)
                e = np.exp(ll - top)
                r = e / e.sum(1, keepdims=True)
                parts += [[(np.log(e.sum(1)) + top[:, 0]).sum()], r.sum(0), (r.T @ z).ravel(), (r.T @ z**2).ravel()]
            return np.concatenate(parts)

        s = total(df, sums)
        if not len(s):
            return {}
        n, at, like = s[0], 1, []
        for k, (w, m, v) in now.items():
            q = len(w)
            like.append(s[at])
            r, a, b2 = s[at + 1 : at + 1 + q], s[at + 1 + q : at + 1 + q + q * dims].reshape(q, dims), s[at + 1 + q + q * dims : at + 1 + q + 2 * q * dims].reshape(q, dims)
            at += 1 + q + 2 * q * dims
            out[k] = (w, m, v, -2 * like[-1] + (q * 2 * dims + q - 1) * np.log(max(n, 1)))
            mean = a / np.maximum(r, 1e-9)[:, None]
            par[k] = (np.maximum(r, 1e-9) / n, mean, np.maximum(b2 / np.maximum(r, 1e-9)[:, None] - mean**2, 1e-6))
        if last is not None and np.abs(np.array(like) - last).max() < 1e-3 * max(n, 1) ** 0.5:
            break
        last = np.array(like)
    return out
