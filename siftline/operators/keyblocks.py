"""Ordered work on keys of any size: the rows of a large key are cut into blocks along their order.

A window over a key runs in one task. Where one key may hold a third of all rows, that task would be the
whole job. Here every key with more rows than a block should have is cut: into as many blocks as its rows
fill, by borders taken from a random sample of its rows (about SAMPLED a block). The sample only places the
borders; all rows are worked on, and equal values of the order never part. All other keys have the one block 0.

A block has about ``min_rows`` rows; only where that made more than MOST_BLOCKS blocks, blocks grow in
proportion to the table. So there are never more than 2 x MOST_BLOCKS blocks, nor cut keys, which is the bound
of every broadcast here: borders, and one row a block for what crosses its border.

The order may be of any type that sorts: numbers, times, texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import beside, cut

MIN_ROWS, MOST_BLOCKS, SAMPLED = 8_000, 50_000, 32
#: Steps of a binary search among up to 2 x MOST_BLOCKS borders.
_STEPS = [1 << k for k in reversed(range(17))]


def hot_splits(rows: DataFrame, keys: list[str], order: Column, min_rows: int = MIN_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """keys, ``_splits`` (array of the order's type): the inner borders of each key that is cut."""
    rows = rows.select(*keys, order.alias("_o")).where(F.col("_o").isNotNull())
    counts = rows.groupBy(*keys).count()
    target = F.greatest(F.lit(min_rows), F.ceil(F.col("all_rows") / most_blocks))
    # keys over the target: at most most_blocks
    hot = beside(counts.where(F.col("count") > min_rows), counts.agg(F.sum("count").alias("all_rows"))).where(F.col("count") > target)
    hot = hot.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (SAMPLED / target).alias("_share"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(hot[f"_k{i}"]) for i, k in enumerate(keys)])
    picked = rows.join(F.broadcast(hot), same).where(F.rand(7) < F.col("_share")).groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_picked"))
    at = F.sequence(F.lit(SAMPLED), F.greatest(F.size("_picked"), F.lit(SAMPLED)), F.lit(SAMPLED))
    splits = F.filter(F.array_distinct(F.transform(at, lambda i: F.get("_picked", i - 1))), lambda x: x.isNotNull())
    # written once: a sample drawn again could differ, and all uses must see the same borders
    return cut(picked.select(*keys, splits.alias("_splits")).where(F.size("_splits") > 0))


def _position(splits: Column, o: Column) -> Column:
    """The number of borders below o, by binary search."""
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) < o, at + step).otherwise(at))


def with_block(df: DataFrame, splits: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """df with ``_blk`` (int, 0 for keys that aren't cut) and ``_hot``; a null order is in block 0."""
    s = splits.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_splits")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(s[f"_k{i}"]) for i, k in enumerate(keys)])
    r = df.join(F.broadcast(s), same, "left").withColumn("_hot", F.col("_splits").isNotNull())
    return r.withColumn("_blk", F.when(F.col("_hot"), _position(F.col("_splits"), order)).otherwise(0)).drop("_splits", *(f"_k{i}" for i in range(len(keys))))


def neighbour(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """df (from with_block) with ``name``: the value of the row before, or with ahead after, it in the key's order.

    Value must not be a null struct; a key's first (last) row gets null. Ties follow the whole order list,
    which should be total for a defined result.
    """
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    step = (F.lead if ahead else F.lag)(F.struct(value.alias("v")))
    if "_hot" not in df.columns:
        return df.withColumn(name, step.over(w)["v"])
    df = df.withColumn("_n", step.over(w))
    at = F.struct(*order)
    pick = (F.min_by if ahead else F.max_by)(F.struct(value.alias("v")), at)
    ends = df.where("_hot").groupBy(*keys, "_blk").agg(pick.alias("_e"))
    over = Window.partitionBy(*keys).orderBy("_blk")
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_blk").alias("_b"), (F.lead if ahead else F.lag)("_e").over(over).alias("_c"))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]) & (df["_blk"] == ends["_b"])
    return df.join(F.broadcast(ends), same, "left").withColumn(name, F.coalesce("_n", "_c")["v"]).drop("_n", "_c", "_b", *(f"_k{i}" for i in range(len(keys))))


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, how: str = "sum", itself: bool = True) -> DataFrame:
    """df (from with_block) with ``name``: the sum, min or max of value over the key's rows up to each row (without it, if not itself)."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    if "_hot" not in df.columns:
        return df.withColumn(name, f(value).over(w))
    df = df.withColumn("_n", f(value).over(w))
    ends = df.where("_hot").groupBy(*keys, "_blk").agg(f(value).alias("_e"))
    over = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_blk").alias("_b"), f("_e").over(over).alias("_c"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) & (F.col("_blk") == F.col("_b"))
    both = F.coalesce(F.col("_n") + F.col("_c"), "_n", "_c") if how == "sum" else (F.least if how == "min" else F.greatest)("_n", "_c")
    return df.join(F.broadcast(ends), same, "left").withColumn(name, both).drop("_n", "_c", "_b", *(f"_k{i}" for i in range(len(keys))))


def blocked(df: DataFrame, keys: list[str], order: Column, **bounds: int) -> DataFrame:
    """df with ``_blk``, its large keys found in itself.

    df is written to the checkpoint folder once, as it is read several times from here on. Where no key is cut
    there is one block and no ``_hot``, and what follows needs neither summaries nor joins.
    """
    df = cut(df)
    hot = hot_splits(df, keys, order, **bounds)
    return df.withColumn("_blk", F.lit(0)) if hot.isEmpty() else with_block(df, hot, keys, order)
