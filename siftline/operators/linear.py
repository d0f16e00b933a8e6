"""Linear models over rows of any number: everything that is fitted comes from sums over rows.

``total`` is the one kernel: a function turns a batch of rows into an array of fixed length, arrays are added
up within partitions, then over partitions in two levels, and a single array, whose length depends on the
number of features and models only, reaches the driver. One pass per step serves all repeats and folds.

* ``moments`` gives means and cross-products by fold; scaling, whitening and residualising on covariates of
  each training set follow from them without another pass.
* ``fit_logistic`` runs Newton's method for all (class, repeat, fold) models together.
* ``out_of_fold`` scores each row by the models that haven't seen its fold.

Defined cases: rows with a null id, label or feature array are left out; a null or NaN feature counts as the
training mean; constant features are dropped by scaling (deviation counts as 1); a training set with one class
only gives no model, and rows that lack a model in a repeat get no score from it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.ranks import hash_unit
from siftline.operators.resample import ranked_by_hash, replicate
from siftline.session import cut

MOST_GROUPS = 10_000


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """An array column as rows of a matrix, nulls as NaN."""
    return np.array([np.asarray(v, float) for v in column]).reshape(len(column), width)


def total(df: DataFrame, f: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of f over all batches of df."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            if len(b):
                v = f(b)
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"v": [acc.astype(float)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    def part_sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield add(b)

    parts = df.mapInPandas(part, "v array<double>")
    if df.rdd.getNumPartitions() > 16:
        parts = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("slot").applyInPandas(add, "v array<double>")
        parts = parts.repartition(1).mapInPandas(part_sum, "v array<double>")
    rows = parts.collect()  # one array, or those of at most 16 partitions
    return np.sum([np.array(r["v"]) for r in rows], axis=0) if rows else np.zeros(0)


def folds(df: DataFrame, id_: str, label: str, group: str | None, k: int, reps: int = 1) -> DataFrame:
    """df with ``fold``, an array with the row's fold in each repeat.

    With a group, whole groups share a fold: of the MOST_GROUPS largest groups a table of group and class counts
    comes to the driver and each, from the largest down, joins the fold whose class counts it evens out most; all
    smaller ones are dealt to the folds in the order of a hash, by their most frequent class. Without, each class's
    rows are dealt in the order of a hash.
    """

    def dealt(units: DataFrame, unit: str, cls: str) -> DataFrame:
        r = ranked_by_hash(replicate(units, reps), ["rep", cls], hash_unit(F.col(unit).cast("string"), F.lit("f"), F.col("rep").cast("string")), F.col(unit))
        return r.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("rep", ((F.col("hash_rank") - 1) % k).cast("int").alias("f")))).alias("x")).select(unit, F.col("x.f").alias("fold"))

    if group is None:
        f = dealt(df.select(F.col(id_).alias("_id"), F.col(label).alias("_y")), "_id", "_y")
        return df.join(f.withColumnRenamed("_id", id_), id_)
    g = F.coalesce(F.col(group).cast("string"), F.lit("__na__"))
    hist = cut(df.groupBy(g.alias("_g"), F.col(label).alias("_y")).agg(F.count("*").alias("n")))
    size = hist.groupBy("_g").agg(F.sum("n").alias("s"), F.max_by("_y", F.struct("n", "_y")).alias("_top"))
    large = size.orderBy(F.col("s").desc(), "_g").limit(MOST_GROUPS + 1)
    rows = hist.join(large.select("_g"), "_g").collect()  # classes of MOST_GROUPS + 1 groups at most
    count: dict[str, np.ndarray] = {}
    classes = sorted({r["_y"] for r in rows})
    for r in rows:
        count.setdefault(r["_g"], np.zeros(len(classes)))[classes.index(r["_y"])] += r["n"]
    order = sorted(count, key=lambda n: (-count[n].sum(), n))
    more, order = len(order) > MOST_GROUPS, order[:MOST_GROUPS]
    whole = sum((count[n] for n in order), np.zeros(len(classes)))
    out: dict[str, list[int]] = {name: [] for name in order}
    for rep in range(reps):
        rng = np.random.default_rng(rep)
        have = np.zeros((k, len(classes)))
        luck = {n: rng.random() for n in sorted(order)}
        for name in sorted(order, key=lambda n: (-count[n].sum(), luck[n])):
            spread = [np.std(np.vstack([have[:j], have[j : j + 1] + count[name], have[j + 1 :]]) / np.maximum(whole, 1), axis=0).mean() for j in range(k)]
            j = min(range(k), key=lambda j: (round(spread[j], 12), have[j].sum()))
            have[j] += count[name]
            out[name].append(j)
    t = df.sparkSession.createDataFrame([(n, f) for n, f in out.items()], "_g string, fold array<int>")
    r = df.withColumn("_g", g)
    if not more:
        return r.join(F.broadcast(t), "_g").drop("_g")  # at most MOST_GROUPS rows
    small = dealt(size.join(F.broadcast(t.select("_g")), "_g", "left_anti").select("_g", "_top"), "_g", "_top")
    return r.join(small.unionByName(t), "_g").drop("_g")


@dataclass
class Scale:
    """How a training set's features are read: x less its part explained by covariates, centred, then times a matrix."""

    fill: np.ndarray
    beta: np.ndarray  # (1 + covariates, features)
    centre: np.ndarray
    turn: np.ndarray

    def __call__(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill[c.shape[1] :], x)
        c = np.where(np.isnan(c), self.fill[: c.shape[1]], c)
        return (x - np.column_stack([np.ones(len(c)), c]) @ self.beta - self.centre) @ self.turn


def moments(df: DataFrame, width: int, covariates: int, k: int, reps: int) -> tuple[np.ndarray, np.ndarray]:
    """(means used for gaps, sums): sums[rep, fold] is the cross-product matrix of (1, covariates, features)."""
    m = covariates + width
    s = total(df.select("x", "c"), lambda b: (lambda v: np.concatenate([np.nansum(v, 0), (~np.isnan(v)).sum(0)]))(np.hstack([matrix(b["c"], covariates), matrix(b["x"], width)])))
    fill = s[:m] / np.maximum(s[m:], 1) if len(s) else np.zeros(m)

    def products(b: pd.DataFrame) -> np.ndarray:
        v = np.hstack([matrix(b["c"], covariates), matrix(b["x"], width)])
        v = np.column_stack([np.ones(len(v)), np.where(np.isnan(v), fill, v)])
        f = np.stack(b["fold"].to_list())
        return np.concatenate([(v[f[:, r] == j].T @ v[f[:, r] == j]).ravel() for r in range(reps) for j in range(k)])

    p = total(df.select("x", "c", "fold"), products)
    return fill, (p if len(p) else np.zeros(reps * k * (m + 1) ** 2)).reshape(reps, k, m + 1, m + 1)


def scale_of(fill: np.ndarray, g: np.ndarray, covariates: int, pca: int = 0, without: np.ndarray | None = None) -> Scale:
    """The scale of a set of rows with cross-products g; without (orthonormal columns): directions to project out first."""
    q = 1 + covariates
    n = max(g[0, 0], 1.0)
    if covariates:
        beta = np.linalg.lstsq(g[:q, :q], g[:q, q:], rcond=None)[0]
        cov = (g[q:, q:] - g[q:, :q] @ beta) / n
        centre = np.zeros(g.shape[0] - q)
    else:
        beta, centre = np.zeros((1, g.shape[0] - 1)), g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(centre, centre)
    left = np.eye(len(cov)) - (without @ without.T if without is not None else 0)
    cov = left @ cov @ left
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    turn = left @ np.diag(1 / np.where(dev > 1e-9, dev, 1.0))
    if pca:
        val, vec = np.linalg.eigh(turn.T @ cov @ turn)
        top = np.argsort(-val)[:pca]
        turn = turn @ vec[:, top] / np.sqrt(np.maximum(val[top], 1e-12))
    return Scale(fill, beta, centre, turn)


def auto_pca(n: float, width: int) -> int:
    """Number of components for n rows; 0 for none."""
    return 0 if width <= 10 or n >= 2 * width else int(min(10, width, max(2, n - 1)))


@dataclass
class Models:
    """What a head gives: the classes, the numbers of repeats and folds, and scores by the model that lacks a fold."""

    classes: list[int]
    scales: np.ndarray  # object array (rep, fold) of Scale
    weights: np.ndarray  # (class, rep, fold, 1 + width), NaN where there is no model

    def score(self, x: np.ndarray, cov: np.ndarray, r: int, j: int) -> np.ndarray:
        """(rows, classes): the scores of rows of fold j of repeat r."""
        z = np.column_stack([np.ones(len(x)), self.scales[r, j](x, cov)])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:, r, j].T, -40, 40)))


def fit_logistic(df: DataFrame, width: int, covariates: int, k: int, reps: int, classes: list[int], c: float = 1.0, steps: int = 40, without: Callable[[int, int], np.ndarray] | None = None) -> Models:
    """Balanced L2 logistic models of each class against the rest, trained on all folds but one. df: x, c, y, fold (checkpointed).

    without gives the directions to project out of the features for the training set that lacks (repeat, fold).
    """
    fill, g = moments(df, width, covariates, k, reps)
    scales = np.empty((reps, k), object)
    for r in range(reps):
        for j in range(k):
            train = g[r].sum(0) - g[r, j]
            scales[r, j] = scale_of(fill, train, covariates, auto_pca(train[0, 0], width), without(r, j) if without else None)
    dims = scales[0, 0].turn.shape[1]

    def count(b: pd.DataFrame) -> np.ndarray:
        y, f = b["y"].to_numpy(), np.stack(b["fold"].to_list())
        return np.array([[[((y == t) & (f[:, r] != j)).sum(), (f[:, r] != j).sum()] for r in range(reps) for j in range(k)] for t in classes], float).ravel()

    n = total(df.select("y", "fold"), count).reshape(len(classes), reps, k, 2)
    pos, rows = n[..., 0], n[..., 1]
    ok = (pos > 0) & (pos < rows)
    w1, w0 = rows / (2 * np.maximum(pos, 1)), rows / (2 * np.maximum(rows - pos, 1))
    beta = np.where(ok[..., None], np.zeros((len(classes), reps, k, dims + 1)), np.nan)

    def slopes(b: pd.DataFrame, beta: np.ndarray) -> np.ndarray:
        x, cov, y, f = matrix(b["x"], width), matrix(b["c"], covariates), b["y"].to_numpy(), np.stack(b["fold"].to_list())
        out = np.zeros((len(classes), reps, k, (dims + 1) * (dims + 2)))
        for r in range(reps):
            for j in range(k):
                use = f[:, r] != j
                z = np.column_stack([np.ones(use.sum()), scales[r, j](x[use], cov[use])])
                for i, t in enumerate(classes):
                    if ok[i, r, j]:
                        on = y[use] == t
                        p = 1 / (1 + np.exp(-np.clip(z @ beta[i, r, j], -40, 40)))
                        w = np.where(on, w1[i, r, j], w0[i, r, j])
                        out[i, r, j] = np.concatenate([z.T @ (w * (p - on)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()])
        return out.ravel()

    ridge = np.diag([0.0] + [1 / c] * dims)
    for _ in range(steps):
        now = beta.copy()
        s = total(df.select("x", "c", "y", "fold"), lambda b: slopes(b, now)).reshape(len(classes), reps, k, -1)
        move = 0.0
        for at in zip(*np.nonzero(ok), strict=True):
            grad, hess = s[at][: dims + 1] + ridge @ beta[at], s[at][dims + 1 :].reshape(dims + 1, dims + 1) + ridge + 1e-9 * np.eye(dims + 1)
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            beta[at] -= step
            move = max(move, np.abs(step).max())
        if move < 1e-6:
            break
    else:
        warnings.warn(f"logistic models still move by {move:.2g} after {steps} steps", stacklevel=2)
    return Models(classes, scales, beta)


def out_of_fold(df: DataFrame, models: Models, width: int, covariates: int, keep: str, some: bool = False) -> DataFrame:
    """df's columns of the schema string ``keep`` with ``p``, array with each class's score: mean over repeats of the model that hasn't seen the row; null if a class has none, or with ``some`` NaN for that class."""
    reps, k = models.scales.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, cov, f = matrix(b["x"], width), matrix(b["c"], covariates), np.stack(b["fold"].to_list()) if len(b) else np.zeros((0, reps), int)
            p = np.full((len(b), len(models.classes), reps), np.nan)
            for r in range(reps):
                for j in range(k):
                    use = f[:, r] == j
                    p[use, :, r] = models.score(x[use], cov[use], r, j)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # a mean of nothing is NaN
                mean = np.nanmean(p, axis=2) if len(b) else p[:, :, 0]
            b = b.drop(columns=["x", "c", "fold"])
            b["p"] = [None if np.isnan(v).any() and not some else v for v in mean]
            yield b

    return df.mapInPandas(run, f"{keep}, p array<double>")


def probe(df: DataFrame, id_: str, x: str, y: str, group: str | None = None, covariates: list[str] | None = None, k: int = 5, reps: int = 1, keep: list[str] | None = None, head: Callable[[DataFrame, int, int, int, int, list[int]], Models] | None = None) -> DataFrame:
    """Out-of-fold scores: id, y, grp, the columns kept, score (of class 1 for two classes) and scores (by class).

    The number of folds is at most the number of groups and of rows of the smallest class. head fits the models
    (``fit_logistic`` by default): it gets the rows (x, c, y, fold), the numbers of features, covariates, folds and
    repeats, and the classes, and gives an object with classes, scales (repeats by folds) and score.
    """
    covariates, keep = covariates or [], keep or []
    v = df.where(F.col(id_).isNotNull() & F.col(y).isNotNull() & F.col(x).isNotNull())
    v = v.select(F.col(id_).cast("string").alias("id"), F.col(y).cast("int").alias("y"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.transform(x, lambda e: F.when(~F.isnan(e.cast("double")), e.cast("double"))).alias("x"), F.array(*(F.col(c).cast("double") for c in covariates)).cast("array<double>").alias("c"), *keep)
    v = cut(v)
    stats = v.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).orderBy("y").collect()  # a row a class
    classes = [r["y"] for r in stats]
    kinds = dict(v.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["id", "y", "grp", *keep])
    none = v.select("id", "y", "grp", *keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<double>").alias("scores"))
    if len(classes) < 2:
        return none
    most = [k, min(r["n"] for r in stats)] + ([v.select("grp").distinct().count()] if group else [])
    k = max(2, min(most))
    width = stats[0]["w"]
    f = cut(folds(v, "id", "y", "grp" if group else None, k, reps))
    use = classes if len(classes) > 2 else classes[1:]
    models = (head or fit_logistic)(f, width, len(covariates), k, reps, use)
    o = out_of_fold(f, models, width, len(covariates), schema)
    whole = F.aggregate("p", F.lit(0.0), lambda a, e: a + e)
    scores = F.transform("p", lambda e: e / whole) if len(classes) > 2 else F.when(F.col("p").isNotNull(), F.array(1 - F.col("p")[0], F.col("p")[0]))
    return o.withColumn("scores", scores).withColumn("score", F.col("scores")[len(classes) - 1] if len(classes) == 2 else F.lit(None).cast("double")).drop("p")


def ridge_r2(df: DataFrame, width: int, k: int, alphas: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, Scale]:
    """(best out-of-fold R2, weights on all rows, alphas, intercept, scale) of ridge regression; df: x (with the target as its last entry), c (empty), fold.

    Held-out errors follow from the folds' cross-products, so choosing among alphas needs no pass over the rows.
    """
    fill, g = moments(df, width + 1, 0, k, 1)
    g = g[0]

    def solve(t: np.ndarray, alpha: float) -> tuple[np.ndarray, Scale]:
        sub = scale_of(fill[:-1], t[:-1, :-1], 0)
        m, y = t[0, 1:-1] / t[0, 0], t[0, -1] / t[0, 0]
        a = sub.turn.T @ (t[1:-1, 1:-1] - t[0, 0] * np.outer(m, m)) @ sub.turn
        b = np.linalg.solve(a + alpha * np.eye(len(a)), sub.turn.T @ (t[1:-1, -1] - t[0, 0] * m * y))
        w = sub.turn @ b
        return np.concatenate([[y - m @ w], w]), sub

    all_ = g.sum(0)
    mean = all_[0, -1] / all_[0, 0]
    sst = all_[-1, -1] - all_[0, 0] * mean**2
    best = (-np.inf, alphas[0])
    for alpha in alphas:
        sse = 0.0
        for j in range(k):
            w, _ = solve(all_ - g[j], alpha)
            sse += g[j][-1, -1] - 2 * w @ g[j][:-1, -1] + w @ g[j][:-1, :-1] @ w
        best = max(best, (1 - sse / sst, alpha))
    w, sub = solve(all_, best[1])
    return best[0], w[1:], alphas, float(w[0]), sub


def batch_directions(df: DataFrame, width: int, k: int, most: int = 2) -> list[np.ndarray]:
    """For each fold the at most ``most`` orthonormal directions that tell the batches apart in the other folds (linear discriminants of scaled features).

    df: x, b (batch, not null), fold. Spark sums by batch and fold, so batches of any number count, and only sums of
    features by features reach the driver: cross-products of rows by fold, and of batch means (times rows) by fold left out.
    """
    v = df.select("b", F.col("fold")[0].alias("j"), F.concat(F.array(F.lit(1.0)), F.transform("x", lambda e: F.coalesce(F.nanvl(e, F.lit(0.0)), F.lit(0.0)))).alias("x"))
    sums = v.select("b", "j", F.posexplode("x").alias("i", "e")).groupBy("b", "j", "i").agg(F.sum("e").alias("s"))
    sums = cut(sums.groupBy("b").agg(F.collect_list(F.struct("j", "i", "s")).alias("sums")))

    def spreads(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((k, 1 + (width + 1) ** 2))
        for cells in pdf["sums"]:
            one = np.zeros((k, width + 1))
            for c in cells:
                one[c["j"], c["i"]] = c["s"]
            for j in range(k):
                m = one.sum(0) - one[j]
                if m[0] > 0.5:
                    out[j] += np.concatenate([[1.0], np.outer(m, m).ravel() / m[0]])
        return out.ravel()

    def products(pdf: pd.DataFrame) -> np.ndarray:
        x, f = matrix(pdf["x"], width + 1), pdf["j"].to_numpy()
        return np.concatenate([(x[f == j].T @ x[f == j]).ravel() for j in range(k)])

    spread = total(sums.select("sums"), spreads).reshape(k, -1)
    gram = total(v.select("x", "j"), products).reshape(k, width + 1, width + 1)
    out = []
    for j in range(k):
        g, batches = gram.sum(0) - gram[j], round(spread[j, 0])
        means = spread[j, 1:].reshape(width + 1, width + 1)[1:, 1:]
        n = g[0, 0]
        mu = g[0, 1:] / n
        sd = np.sqrt(np.maximum(np.diag(g)[1:] / n - mu**2, 1e-12))
        within = (g[1:, 1:] - means) / n / np.outer(sd, sd) + 1e-6 * np.eye(width)
        between = (means / n - np.outer(mu, mu)) / np.outer(sd, sd)
        val, vec = np.linalg.eigh(within)
        half = vec / np.sqrt(np.maximum(val, 1e-9))
        _, top = np.linalg.eigh(half.T @ between @ half)
        scal = (half @ top[:, ::-1])[:, : min(most, max(batches - 1, 0))] / sd[:, None]
        out.append(np.linalg.qr(scal)[0] if scal.shape[1] else np.zeros((width, 0)))
    return out


def leave_one_out(df: DataFrame, id_: str, x: str, y: str) -> DataFrame:
    """id, y, score: of each row by the balanced logistic model of all others.

    The model of all rows is fitted once; the one without a row follows by one Newton step from it, in closed form, so
    the cost is one more pass, whatever the number of rows. (Its scale stays that of all rows.)
    """
    v = cut(df.where(F.col(id_).isNotNull() & F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(y).cast("int").alias("y"), F.transform(x, lambda e: F.when(~F.isnan(e.cast("double")), e.cast("double"))).alias("x"), F.array().cast("array<double>").alias("c"), F.array(F.lit(1)).alias("fold")))
    s = v.agg(F.count("*").alias("n"), F.sum("y").alias("k"), F.max(F.size("x")).alias("w")).first()
    if not s["n"] or s["k"] < 2 or s["n"] - s["k"] < 2:
        return v.select("id", "y", F.lit(None).cast("double").alias("score"))
    width, w1, w0 = s["w"], s["n"] / (2 * s["k"]), s["n"] / (2 * (s["n"] - s["k"]))
    m = fit_logistic(v, width, 0, 2, 1, [1])  # all rows are in fold 1, so the model without fold 0 is that of all
    beta, scale = m.weights[0, 0, 0], m.scales[0, 0]

    def parts(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = b["y"].to_numpy()
        z = scale(matrix(b["x"], width), np.zeros((len(b), 0)))
        z = np.column_stack([np.ones(len(z)), z])
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        return z, p, t, np.where(t == 1, w1, w0)

    def curvature(b: pd.DataFrame) -> np.ndarray:
        z, p, _, w = parts(b)
        return (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()

    h = total(v.select("x", "y"), curvature).reshape(len(beta), -1) + np.diag([1e-9] + [1.0] * (len(beta) - 1))
    inverse = np.linalg.inv(h)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, p, t, w = parts(b)
            lever = np.einsum("ni,ij,nj->n", z, inverse, z)
            eta = z @ beta + w * (p - t) * lever / np.maximum(1 - w * p * (1 - p) * lever, 1e-9)
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "score": 1 / (1 + np.exp(-np.clip(eta, -40, 40)))})

    return v.select("id", "y", "x").mapInPandas(run, "id string, y int, score double")
