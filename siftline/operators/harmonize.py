"""ComBat: removing batch effects in location and scale, with empirical-Bayes shrinkage.

One pass gives the sums of each batch. The regression on covariates and the pooled variance follow from their
total, which is small (features and covariates only); each batch's shrunken parameters are found from its own
row of sums, batches in parallel; rows then get their batch's parameters by a join.

Defined cases: a null batch is a batch of its own, as are all batches of one row together; null covariates
count as their mean; batches not seen in fitting pass unchanged (neutral parameters); features without variance
stay; a null embedding stays null; an empty table comes back empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.linear import matrix
from siftline.session import cut, number

NEUTRAL, ROUNDS, TOLERANCE = "__single__", 200, 1e-4


def covariate(df: DataFrame, c: str) -> Column:
    """A number; a two-valued text as 1 for the greater value (M of F and M)."""
    return F.when(F.col(c) == "M", 1.0).when(F.col(c).isNotNull(), 0.0) if dict(df.dtypes)[c] == "string" else number(c)


def shrink(n: float, gamma: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior location and scale of one batch's features from their means and variances."""
    bar, tau = gamma.mean(), max(gamma.var(ddof=1) if len(gamma) > 1 else 0.0, 1e-12)
    m, s2 = delta.mean(), max(delta.var(ddof=1) if len(delta) > 1 else 0.0, 1e-12)
    a, b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
    g, d = gamma.copy(), np.maximum(delta, 1e-12)
    for _ in range(ROUNDS):
        g2 = (n * tau * gamma + d * bar) / (n * tau + d)
        ss = (n - 1) * delta + n * (gamma - g2) ** 2
        d2 = (b + ss / 2) / (n / 2 + a - 1)
        move = max(np.abs((g2 - g) / np.where(g == 0, 1, g)).max(), np.abs((d2 - d) / d).max())
        g, d = g2, d2
        if move < TOLERANCE:
            break
    return g, d


def combat(df: DataFrame, id_: str, emb: str, batch: str, covariates: list[str], train: Column | None = None) -> DataFrame:
    """df with the embedding harmonised. With train (a boolean column), parameters come from those rows only."""
    q = len(covariates)
    means = df.agg(*(F.coalesce(F.avg(covariate(df, c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(covariates)), F.max(F.size(emb)).alias("w")).first()
    if means["w"] is None or means["w"] < 1:
        return df
    width = means["w"]
    b = F.coalesce(F.col(batch).cast("string"), F.lit("__na__"))
    cov = F.array(*(F.coalesce(covariate(df, c), F.lit(means[f"m{i}"])) for i, c in enumerate(covariates))).cast("array<double>")
    rows = df.withColumns({"_b": b, "_c": cov})
    fit = rows.where(F.col(emb).isNotNull() & (train if train is not None else F.lit(True)))
    sizes = fit.groupBy("_b").count()
    single = sizes.where("count = 1").select("_b", F.lit(True).alias("_one"))
    fit = fit.join(single, "_b", "left").withColumn("_b", F.when(F.col("_one"), NEUTRAL).otherwise(F.col("_b")))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            v = np.column_stack([np.ones(len(pdf)), matrix(pdf["c"], q), matrix(pdf["x"], width)])
            for name, at in pdf.groupby("b").indices.items():
                s = v[at].T @ v[at]
                acc[name] = acc[name] + s if name in acc else s
        if acc:
            yield pd.DataFrame({"b": list(acc), "s": [a.ravel() for a in acc.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_list()), axis=0)]})

    # a row a batch and partition, then a row a batch
    sums = cut(fit.select(F.col("_b").alias("b"), F.col("_c").alias("c"), F.col(emb).cast("array<double>").alias("x")).mapInPandas(part, "b string, s array<double>").groupBy("b").applyInPandas(add, "b string, s array<double>"))
    m = 1 + q + width

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cross-products within batches and the total of rows and sums, added up over the batches of a slot."""
        out = np.zeros(m * m + m)
        for s in pdf["s"]:
            s = np.asarray(s).reshape(m, m)
            out += np.concatenate([(s - np.outer(s[0], s[0]) / s[0, 0]).ravel(), s[0]])
        return pd.DataFrame({"t": [out]})

    got = sums.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(16))).groupBy("slot").applyInPandas(within, "t array<double>").collect()  # at most 16 arrays
    if not got:
        return df
    t = np.sum([np.asarray(r["t"]) for r in got], axis=0)
    w, first = t[: m * m].reshape(m, m), t[m * m :]
    n = first[0]
    beta = np.linalg.lstsq(w[1 : 1 + q, 1 : 1 + q], w[1 : 1 + q, 1 + q :], rcond=None)[0] if q else np.zeros((0, width))
    grand = (first[1 + q :] - first[1 : 1 + q] @ beta) / n
    resid = w[1 + q :, 1 + q :] - w[1 + q :, 1 : 1 + q] @ beta
    sigma = np.sqrt(np.maximum(np.diag(resid) / n, 0))
    sigma = np.where(sigma > 1e-12, sigma, 1.0)

    def parameters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, s in zip(pdf["b"], pdf["s"], strict=True):
                s = np.asarray(s).reshape(m, m)
                k = s[0, 0]
                map_ = np.vstack([-grand[None, :], -beta, np.eye(width)]) / sigma  # (1, covariates, x) to standardised x
                mean = s[0] @ map_ / k
                var = np.maximum(np.einsum("ij,ik,jk->k", s, map_, map_) / k - mean**2, 0) * k / max(k - 1, 1)
                out.append((name, *shrink(k, mean, var)))
            yield pd.DataFrame(out, columns=["_b", "_g", "_d"])

    p = cut(sums.mapInPandas(parameters, "_b string, _g array<double>, _d array<double>"))
    alone = single.join(p.where(F.col("_b") == NEUTRAL).select("_g", "_d", F.lit(True).alias("_one")), "_one").select("_b", "_g", "_d")
    out = rows.join(p.where(F.col("_b") != NEUTRAL).unionByName(alone), "_b", "left")
    arr = lambda v: F.array(*map(F.lit, v.tolist())) if len(v) else F.array().cast("array<double>")
    base = F.transform(F.arrays_zip(arr(grand).alias("g"), F.array(*(arr(beta[:, i]) for i in range(width))).alias("b")), lambda z: z["g"] + F.aggregate(F.zip_with("_c", z["b"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    z = F.arrays_zip(F.col(emb).cast("array<double>").alias("x"), base.alias("m"), arr(sigma).alias("s"), F.coalesce("_g", F.array_repeat(F.lit(0.0), width)).alias("g"), F.coalesce("_d", F.array_repeat(F.lit(1.0), width)).alias("d"))
    value = F.transform(z, lambda e: ((e["x"] - e["m"]) / e["s"] - e["g"]) / F.sqrt(e["d"]) * e["s"] + e["m"])
    return out.withColumn(emb, F.when(F.col(emb).isNotNull(), value)).select(*df.columns)
