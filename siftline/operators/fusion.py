"""Several views of one subject: aligned, compared, gated and attended to.

Defined cases: subjects that lack a view are left out of comparisons, and counted as not complete in ``align``;
repeated subjects count once (first in the order of all columns); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import linear, ranks, resample
from siftline.operators.linear import matrix
from siftline.session import beside, cut, number


def align(base: DataFrame, other: DataFrame, key: str, values: list[str]) -> DataFrame:
    """base with another table's values by key (the first of repeats) and ``complete``, whether all are there."""
    cols = [key, *values]
    one = ranks.first_per_key(other.select(*cols).where(F.col(key).isNotNull()), [key], [F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    j = base.join(one, key, "left")
    ok = F.lit(True)
    for v in values:
        ok = ok & number(v).isNotNull() if dict(other.dtypes)[v] in ("double", "float") else ok & F.col(v).isNotNull()
    return j.withColumn("complete", ok)


def views(df: DataFrame, id_: str, y: str, group: str, blocks: dict[str, Column]) -> DataFrame:
    """id, y, grp and each block as an array, for subjects that have all of all blocks; ``all`` is their concatenation."""
    v = df.select(F.col(id_).cast("string").alias("id"), F.col(y).alias("y"), F.col(group).alias("grp"), *(b.cast("array<double>").alias(k) for k, b in blocks.items()))
    whole = F.concat(*blocks)
    return v.withColumn("all", whole).where(F.col("all").isNotNull() & ~F.exists("all", lambda e: e.isNull() | F.isnan(e)))


def compare(v: DataFrame, blocks: list[str], n: int = resample.DRAWS) -> DataFrame:
    """view, auc, lo, hi of each block, of their concatenation ("all"), of the softmax gate over blocks ("gated") and of a probe on the blocks' scores ("stacked")."""
    scored = None
    for b in [*blocks, "all"]:
        s = linear.probe(v, "id", b, "y", "grp").select("id", "y", "grp", F.lit(b).alias("view"), "score")
        scored = s if scored is None else scored.unionByName(s)
    scored = cut(scored)
    area = cut(ranks.rank_auc(scored, ["view"], "score", F.col("y")))
    gate = area.where(F.col("view") != "all").withColumn("e", F.exp(F.greatest(F.col("auc") - 0.5, F.lit(0.0)) / 0.1))
    gated = scored.join(gate.select("view", "e"), "view").groupBy("id", "y", "grp").agg((F.sum(F.col("e") * F.col("score")) / F.sum("e")).alias("score"), F.array_sort(F.collect_list(F.struct("view", "score"))).alias("s"))
    gated = cut(gated)
    stacked = linear.probe(gated.withColumn("x", F.col("s.score")), "id", "x", "y", "grp").select("id", "y", "grp", F.lit("stacked").alias("view"), "score")
    scored = cut(scored.unionByName(gated.select("id", "y", "grp", F.lit("gated").alias("view"), "score")).unionByName(stacked))
    drawn = cut(resample.bootstrap_auc(scored, "id", "score", F.col("y"), n, ["view"], observed=True))
    return drawn.where("rep = -1").join(resample.interval(drawn.where("rep >= 0"), "auc", ["view"]), "view").select("view", "auc", "lo", "hi")


def attribution(v: DataFrame, blocks: list[str]) -> DataFrame:
    """block, auc without it, drop: what the concatenation loses without each block."""
    whole = ranks.rank_auc(linear.probe(v, "id", "all", "y", "grp"), [], "score", F.col("y")).select(F.col("auc").alias("full"))
    out = None
    for b in blocks:
        rest = v.withColumn("x", F.concat(*(c for c in blocks if c != b)))
        a = beside(ranks.rank_auc(linear.probe(rest, "id", "x", "y", "grp"), [], "score", F.col("y")), whole).select(F.lit(b).alias("block"), F.col("auc").alias("without"), (F.col("full") - F.col("auc")).alias("drop"))
        out = a if out is None else out.unionByName(a)
    return out


def attended(df: DataFrame, x: str, width: int, tokens: int = 4, heads: int = 2, size: int = 4, seed: int = 7) -> DataFrame:
    """df with ``attended`` (4 * size numbers) and ``weights`` (tokens): scaled dot-product attention of one row's tokens.

    The array is cut into tokens, which are projected by fixed seeded matrices, normalised, and attend to each
    other in several heads. Nothing is learnt and rows don't meet, so this is one vectorised pass.
    """
    rng = np.random.default_rng(seed)
    per = -(-width // tokens)
    embed, q, k, v = rng.normal(size=(tokens, per, size)) / per**0.5, *(rng.normal(size=(heads, size, size)) / size**0.5 for _ in range(3))

    @F.pandas_udf("struct<a: array<double>, w: array<double>>")
    def run(col: pd.Series) -> pd.DataFrame:
        x = np.nan_to_num(matrix(col, width)) if len(col) else np.zeros((0, width))
        x = np.pad(x, ((0, 0), (0, per * tokens - width))).reshape(len(x), tokens, per)
        t = np.einsum("ntp,tps->nts", x, embed)
        t = (t - t.mean(2, keepdims=True)) / np.sqrt(t.var(2, keepdims=True) + 1e-5)
        s = np.einsum("nts,hsd,hed,nue->nhtu", t, q, k, t) / size**0.5
        w = np.exp(s - s.max(3, keepdims=True))
        w /= w.sum(3, keepdims=True)
        o = np.einsum("nhtu,nus,hsd->nhtd", w, t, v).mean(1)
        flat = np.concatenate([o.mean(1), o.max(1), o.min(1), o.std(1)], axis=1)
        return pd.DataFrame({"a": list(flat), "w": list(w.mean((1, 2)))})

    r = df.withColumn("_r", F.when(F.col(x).isNotNull(), run(F.transform(F.coalesce(x, F.array_repeat(F.lit(0.0), width)), lambda e: e.cast("double")))))
    return r.withColumns({"attended": F.col("_r.a"), "weights": F.col("_r.w")}).drop("_r")
