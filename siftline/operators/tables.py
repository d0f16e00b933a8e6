"""Projections, filters and joins of contract and measurement tables.

Defined cases, unless an operator says otherwise: nulls stay null and never match a key; NaN is read as null;
of repeated rows each is kept; empty tables give empty results; columns that aren't named are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.notation import micros
from siftline.operators.ranks import serial
from siftline.operators.statistics import z_scores
from siftline.session import beside, number


def point_head(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target, with ``y``, ``grp`` and the class codes of site and scanner (order of their names).

    target: conversion (0 or 1), dx_binary (AD against CN, others dropped), site or scanner (class codes). For
    outcomes grp is the site, with one group for all rows without; else it is null.
    """
    for c in ("site", "scanner"):
        codes = serial(df.select(c).distinct(), c, f"{c}_code").select(c, (F.col(f"{c}_code") - 1).alias(f"{c}_code"))
        df = df.join(codes.where(F.col(c).isNotNull()), c, "left")
    y = {"conversion": F.col("conversion").cast("int"), "dx_binary": F.when(F.col("dx") == "AD", 1).when(F.col("dx") == "CN", 0), "site": F.col("site_code"), "scanner": F.col("scanner_code")}[target]
    grp = F.coalesce("site", F.lit("__na__")) if target in ("conversion", "dx_binary") else F.lit(None).cast("string")
    return df.withColumns({"y": y, "grp": grp}).where("y is not null")


def restrict(df: DataFrame, dims: list[int], emb: str = "emb") -> DataFrame:
    """The embedding reduced to some dimensions, in the order given; dimensions it lacks are null."""
    return df.withColumn(emb, F.transform(F.array(*map(F.lit, dims)), lambda i: F.get(emb, i)))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (number(c).isNotNull() for c in cols)))


def mask_sentinels(df: DataFrame, cols: list[str], codes: list[float] | None = None) -> DataFrame:
    """Codes for "missing" (any negative number, or those given) and NaN as null."""
    bad = lambda v: v.isin(codes) if codes else v < 0
    return df.withColumns({c: F.when(~bad(number(c)), number(c)) for c in cols})


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def covered_rows(df: DataFrame, cols: list[str], above: float) -> DataFrame:
    """Rows of which more than the share ``above`` of cols is there, with their number as ``present``."""
    n = reduce(lambda a, b: a + b, (number(c).isNotNull().cast("int") for c in cols))
    return df.withColumn("present", n).where(F.col("present") / len(cols) > above)


def column_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, coverage: one pass over all columns."""
    one = df.agg(*(F.avg(number(c).isNotNull().cast("double")).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("coverage")) for c in cols))).alias("x")).select("x.*")


def covered_columns_z(df: DataFrame, keep: list[str], cols: list[str], above: float) -> DataFrame:
    """keep and the z-scores of columns whose coverage is over ``above``, gaps as 0. One row of coverages comes to the driver."""
    got = {r["column_name"]: r["coverage"] for r in column_coverage(df, cols).collect()}
    use = [c for c in cols if (got[c] or 0) > above]
    z = z_scores(df.select(*keep, *use), use)
    return z.select(*keep, *(F.coalesce(f"{c}_z", F.lit(0.0)).alias(f"{c}_z") for c in use))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null for null, unlike least and greatest alone, which skip nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def slug(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "-")))


def nearest_to_anchor(anchor: DataFrame, rows: DataFrame, key: str, at: str, time: str, id_: str) -> DataFrame:
    """For each key of anchor the row nearest in time to it, of equal distances the earlier, then the smaller id; without an anchor time the earliest row. Adds gap_days."""
    j = rows.join(anchor.select(key, F.col(at).alias("_at")), key)
    gap = F.coalesce(F.abs(micros(j, time) - micros(j, "_at")), F.lit(0))
    first = F.min_by(F.struct(id_, time, "_at"), F.struct(gap.alias("g"), F.col(time), F.col(id_)))
    return j.where(F.col(time).isNotNull()).groupBy(key).agg(first.alias("x")).select(key, f"x.{id_}", f"x.{time}", F.abs(F.date_diff(F.col(f"x.{time}"), F.col("x._at"))).alias("gap_days"))


def ensemble(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, ensemble (mean of the z-scores of the columns' key means, over those present) and assays (their number)."""
    m = df.groupBy(key).agg(*(F.avg(number(c)).alias(c) for c in cols))
    z = z_scores(m, cols, ddof=1)
    arr = F.filter(F.array(*(f"{c}_z" for c in cols)), F.isnotnull)
    return z.withColumn("_z", arr).where(F.size("_z") > 0).select(key, (F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / F.size("_z")).alias("ensemble"), F.size("_z").alias("assays"))


def conversion(df: DataFrame, key: str, at: str, tie: str, state: str, start: float, end: float) -> DataFrame:
    """key, first (state of its first row), visits, conversion: for first = start and a later row, whether any later row is end."""
    g = df.groupBy(key).agg(F.min_by(state, F.struct(at, tie)).alias("first"), F.count("*").alias("visits"), F.sum((F.col(state) == end).cast("int")).alias("_e"))
    return g.withColumn("conversion", F.when((F.col("first") == start) & (F.col("visits") > 1), (F.col("_e") > 0).cast("int"))).drop("_e")


def evenly(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows, evenly spaced in a unique order."""
    v = serial(df, order, "_i")
    v = beside(v, df.agg(F.count("*").alias("_n")))
    return v.where((F.col("_i") - 1) % F.greatest(F.ceil(F.col("_n") / most), F.lit(1)) == 0).select(order)


def paired_mean(df: DataFrame, left: str, right: str) -> DataFrame:
    """df with <base>, the mean of <base><left> and <base><right> over those that aren't null, for bases that have both columns."""
    bases = [c.removesuffix(left) for c in df.columns if c.endswith(left) and c.removesuffix(left) + right in df.columns]
    for b in bases:
        both = F.filter(F.array(number(b + left), number(b + right)), F.isnotnull)
        df = df.withColumn(b, F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both)))
    return df


def left_chain(base: DataFrame, key: str, feeders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """(base with the columns of each feeder joined by key, why feeders were left out).

    A feeder gives a table with one row a key (of several the one of smallest values counts). One that fails, when its
    plan is made or when its first row is read, is left out with its error; its name's columns don't appear.
    """
    out, failed = base, {}
    for name, feeder in feeders.items():
        try:
            f = feeder()
            cols = [c for c in f.columns if c != key]
            f = f.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(f"`{c}`" for c in cols))).alias("_x")).select(key, *(F.col(f"_x.`{c}`").alias(f"{name}_{c}") for c in cols))
            f.limit(1).collect()
        except Exception as e:  # noqa: BLE001 - any failing feeder is left out
            failed[name] = f"{type(e).__name__}: {e}"[:200]
            continue
        out = out.join(f, key, "left")
    return out, failed


def rois(df: DataFrame, prefix: str = "roi_") -> tuple[DataFrame, dict[str, list[int]]]:
    """(df with ``emb``, its columns with the prefix in the order of their names, as numbers; the places in it of each region).

    A region is a column's name without prefix and side, and "left" and "right" are all columns of a side.
    """
    cols = sorted(c for c in df.columns if c.startswith(prefix))
    places: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        side = re.search(r"(?:^|_)(left|right|lh|rh)(?:_|$)", c.removeprefix(prefix))
        region = re.sub(r"(?:^|_)(left|right|lh|rh)(?=_|$)", "", c.removeprefix(prefix)).strip("_")
        for k in [region, *([{"lh": "left", "rh": "right"}.get(side[1], side[1])] if side else [])]:
            places.setdefault(k, []).append(i)
    return df.withColumn("emb", F.array(*(number(c) for c in cols))), places


def amyloid(suvr: Column, csf: Column) -> Column:
    """1 or 0 by the tracer's uptake (1.11 or more), where that is missing by the protein in the fluid (under 980), else null."""
    return F.when(number(suvr).isNotNull(), (number(suvr) >= 1.11).cast("int")).when(number(csf).isNotNull(), (number(csf) < 980).cast("int"))


def left_to_do(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The grid's distinct combinations without a result yet; null keys compare equal."""
    d = done.select(*(F.col(k).alias(f"_k{k}") for k in keys)).distinct()
    return grid.select(*keys).distinct().join(d, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys)), "left_anti")
