"""Ranks and what follows from them. Every order is total or averages ties, so results don't depend on the layout.

Rows are first reduced to distinct values with counts, then ranked by prefix sums over blocks
(siftline.operators.keyblocks), so a key with a third of all rows is never sorted in one task.

Defined cases: null and NaN values have no rank and are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.keyblocks import blocked, running
from siftline.session import number


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows with it), rank (average of its ties, from 1), total (rows of the key): a row a distinct value."""
    v = df.select(*keys, number(value).alias(value)).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    v = running(blocked(v, keys, F.col(value)), keys, [F.col(value)], F.col("n"), "_to")
    total = v.groupBy(*keys).agg(F.sum("n").alias("total"))
    return v.join(total, keys).select(*keys, value, "n", (F.col("_to") - (F.col("n") - 1) / 2).alias("rank"), "total")


def rank_auc(df: DataFrame, keys: list[str], score: str, label: Column, weight: Column | None = None) -> DataFrame:
    """keys, pos, neg, auc: chance that a positive row scores above a negative one, ties half; null with one class only."""
    w = weight if weight is not None else F.lit(1)
    if not keys:
        return rank_auc(df.withColumn("_all", F.lit(0)), ["_all"], score, label, weight).drop("_all")
    v = df.select(*keys, number(score).alias("_s"), label.cast("int").alias("_y"), w.cast("double").alias("_w")).where("_s is not null and _y is not null")
    v = v.groupBy(*keys, "_s").agg(F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0.0)).alias("_q"))
    v = running(blocked(v, keys, F.col("_s")), keys, [F.col("_s")], F.col("_q"), "_below", itself=False)
    won = F.sum(F.col("_p") * (F.coalesce("_below", F.lit(0.0)) + F.col("_q") / 2))
    a = v.groupBy(*keys).agg(F.sum("_p").alias("pos"), F.sum("_q").alias("neg"), won.alias("won"))
    return a.select(*keys, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """df with q, the step-up adjusted p-value among the key's non-null p; null where p is null."""
    v = df.select(*keys, p).where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("n"))
    v = running(blocked(v, keys, F.col(p)), keys, [F.col(p)], F.col("n"), "_i").drop("_blk", "_hot")
    total = v.groupBy(*keys).agg(F.sum("n").alias("_m"))
    v = v.join(total, keys).withColumn("_x", F.least(F.col(p) * F.col("_m") / F.col("_i"), F.lit(1.0)))
    v = running(blocked(v, keys, -F.col(p)), keys, [F.col(p).desc()], F.col("_x"), "q", "min")
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate([*keys, p])]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.join(v.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, p])), "q"), cond, "left").drop(*(f"_r{i}" for i in range(len(keys) + 1)))


def serial(df: DataFrame, order: str, name: str = "serial") -> DataFrame:
    """df with a dense number from 1 along distinct values of order (nulls get none)."""
    v = df.select(order).where(F.col(order).isNotNull()).distinct().withColumn("_all", F.lit(0))
    v = running(blocked(v, ["_all"], F.col(order)), ["_all"], [F.col(order)], F.lit(1), name)
    return df.join(v.select(order, name), order, "left")


def min_max(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with value scaled to [0, 1] within the key; 1 where all are equal, null for null."""
    m = df.groupBy(*keys).agg(F.min(number(value)).alias("_lo"), F.max(number(value)).alias("_hi"))
    v = number(value)
    return df.join(m, keys).withColumn(name, F.when(v.isNotNull(), F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))).drop("_lo", "_hi")


def rank_normalise(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with (average rank - 1) / (n - 1) within the key; 0.5 for a single row, null for null."""
    r = average_ranks(df, keys, value).select(*keys, F.col(value).alias("_v"), F.when(F.col("total") == 1, 0.5).otherwise((F.col("rank") - 1) / (F.col("total") - 1)).alias(name))
    return df.withColumn("_v", number(value)).join(r, [*keys, "_v"], "left").drop("_v")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: an aggregate that combines before the shuffle, not a window.

    order are ascending sort keys; nulls come first, as in a struct comparison, so pass coalesced keys for nulls last.
    """
    cols = df.columns
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*(f"`{c}`" for c in cols)), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_x"))
    return picked.select("_x.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; row_number with a limit, which Spark prunes before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, equal in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0
