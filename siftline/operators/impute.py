"""Filling missing values from records of the same group, with masks of what was filled.

Numbers: a mixed-effects model, value = mean + slope * time + group effect + error. The slope is the pooled
within-group slope; the variances between and within groups come from the analysis of variance of the
residuals; each group's effect is its mean residual, shrunk towards 0 by n / (n + within / between) (best
linear unbiased prediction).

Categories: a multinomial model per group with a time effect. The group's category shares are shrunk towards
the overall shares (Dirichlet prior, whose weight is estimated from how much groups differ), and time enters by
a normal model per category with common variance, which makes the log-odds linear in time. The likeliest
category is filled, of equal ones the smallest.

All estimates are sums by group and by category, so any number of rows costs one aggregation each and nothing
but one row of totals is shared. A cell is filled where its group holds at least one valid value of the
field; otherwise it stays null and unmarked.

Defined cases: null, NaN and values outside [low, high] are missing and come out as null if not filled; a
null in a group column means no group; repeated rows count once in the estimates and each comes out filled; a
null time counts as the mean time of the valid rows; an empty table comes out empty; a field named like a mask
(<field>_filled) is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import beside, number


@dataclass(frozen=True)
class Field:
    """A field to fill; kind is "number" or "category" (categories are whole numbers from low to high)."""

    name: str
    low: float
    high: float
    kind: str = "number"


def _valid(f: Field) -> Column:
    v = number(f"`{f.name}`")
    return F.when((v >= f.low) & (v <= f.high), v)


def fill(df: DataFrame, group: dict[str, Column], time: Column, fields: list[Field]) -> DataFrame:
    """df with each field filled (double) and a boolean <field>_filled."""
    for f in fields:
        if f"{f.name}_filled" in df.columns:
            raise ValueError(f"{f.name}_filled is a column of the input already")
    keys = [f"_g{i}" for i in range(len(group))]
    has = F.lit(True)
    for c in group.values():
        has = has & c.isNotNull()
    rows = df.withColumns({k: F.when(has, c) for k, c in zip(keys, group.values(), strict=True)} | {"_t": number(time)})
    for i, f in enumerate(fields):
        rows = rows.withColumn(f"_v{i}", _valid(f))
    known = rows.where(F.col(keys[0]).isNotNull()).dropDuplicates(df.columns)
    for i, f in enumerate(fields):
        part = known.where(F.col(f"_v{i}").isNotNull()).select(*keys, "_t", F.col(f"_v{i}").alias("_v"))
        model = (_numbers if f.kind == "number" else _categories)(part, keys, f)
        rows = _look_up(rows, model.withColumnRenamed("_m", f"_m{i}"), keys)
        guess = _predict_number(f"_m{i}", f) if f.kind == "number" else F.col(f"_m{i}.score")
        if f.kind == "category":
            score = F.transform(f"_m{i}.score", lambda s: F.struct((s["a"] + s["b"] * F.coalesce(F.col("_t"), s["mid"])).alias("s"), (-s["k"]).alias("k")))
            guess = -F.array_max(score)["k"]
        fills = F.col(f"_v{i}").isNull() & F.col(f"_m{i}").isNotNull()
        rows = rows.withColumns({f.name: F.when(fills, guess).otherwise(F.col(f"_v{i}")), f"{f.name}_filled": fills}).drop(f"_m{i}")
    return rows.drop(*keys, "_t", *(f"_v{i}" for i in range(len(fields))))


def _look_up(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the model of their group. The model has one row a group: small ones are broadcast by their size at run time, a hot group of the rows is split by the skew handling of the join."""
    return rows.join(model, keys, "left")


def _numbers(part: DataFrame, keys: list[str], f: Field) -> DataFrame:
    """By group: ``_m``, struct of mean, slope, mid (mean time) and effect."""
    sums = part.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_v").alias("sv"), F.sum(F.col("_v") ** 2).alias("svv"), F.count("_t").alias("nt"), F.sum(F.coalesce("_t", F.lit(0.0))).alias("st"), F.sum(F.coalesce(F.col("_t") ** 2, F.lit(0.0))).alias("stt"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_v")).otherwise(0.0)).alias("svt1"), F.sum(F.coalesce(F.col("_v") * F.col("_t"), F.lit(0.0))).alias("svt"))
    totals = sums.agg(
        F.sum("n").alias("all_n"), F.count("*").alias("all_j"), (F.sum("sv") / F.sum("n")).alias("mu"), F.coalesce(F.sum("st") / F.sum("nt"), F.lit(0.0)).alias("mid"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("nt") > 0, F.col("svt") - F.col("st") * F.col("svt1") / F.col("nt")).otherwise(0.0)), F.nullif(F.sum(F.when(F.col("nt") > 0, F.col("stt") - F.col("st") ** 2 / F.col("nt")).otherwise(0.0)), F.lit(0.0))), F.lit(0.0)).alias("slope"),
        F.sum(F.col("n") ** 2).alias("nn"), F.sum(F.col("svv") - F.col("sv") ** 2 / F.col("n")).alias("within"),
        F.sum(F.when(F.col("nt") > 0, F.col("svt") - F.col("st") * F.col("svt1") / F.col("nt")).otherwise(0.0)).alias("sxy"),
    )
    rest = F.col("sv") / F.col("n") - F.col("mu") - F.col("slope") * F.coalesce(F.try_divide("st", "nt") - F.col("mid"), F.lit(0.0))
    m = beside(sums, totals).withColumn("rest", rest)
    m = beside(m, m.agg((F.sum(F.col("n") * F.col("rest") ** 2) - F.sum(F.col("n") * F.col("rest")) ** 2 / F.sum("n")).alias("between")))
    e2 = F.greatest((F.col("within") - F.col("slope") * F.col("sxy")) / F.greatest(F.col("all_n") - F.col("all_j") - 1, F.lit(1)), F.lit(1e-9))
    size = (F.col("all_n") - F.col("nn") / F.col("all_n")) / F.greatest(F.col("all_j") - 1, F.lit(1))
    u2 = F.greatest((F.col("between") / F.greatest(F.col("all_j") - 1, F.lit(1)) - e2) / F.greatest(size, F.lit(1.0)), F.lit(0.0))
    effect = F.col("n") * u2 / (F.col("n") * u2 + e2) * F.col("rest")
    return m.select(*keys, F.struct(F.col("mu"), F.col("slope"), F.col("mid"), effect.alias("effect")).alias("_m"))


def _predict_number(m: str, f: Field) -> Column:
    v = F.col(f"{m}.mu") + F.col(f"{m}.slope") * (F.coalesce(F.col("_t"), F.col(f"{m}.mid")) - F.col(f"{m}.mid")) + F.col(f"{m}.effect")
    return F.least(F.greatest(F.round(v, 6), F.lit(float(f.low))), F.lit(float(f.high)))


def _categories(part: DataFrame, keys: list[str], f: Field) -> DataFrame:
    """By group: ``_m``, struct of score, array over categories of {k, a, b, mid}: score a + b * time."""
    part = part.withColumn("_v", F.round("_v"))
    by = part.groupBy(*keys, "_v").agg(F.count("*").alias("c"), F.count("_t").alias("ct"), F.sum("_t").alias("st"), F.sum(F.col("_t") ** 2).alias("stt"))
    # categories lie between low and high, so these are few rows
    cats = by.groupBy("_v").agg(F.sum("c").alias("C"), F.sum("ct").alias("CT"), F.sum("st").alias("ST"), F.sum("stt").alias("STT"))
    one = cats.agg(F.sum("C").alias("all_n"), F.collect_list(F.struct(F.col("_v").alias("k"), F.col("C").cast("double").alias("C"), F.coalesce(F.try_divide("ST", "CT"), F.lit(0.0)).alias("m"))).alias("cats"), F.coalesce(F.sum("ST") / F.sum("CT"), F.lit(0.0)).alias("mid"), F.coalesce(F.try_divide(F.sum(F.col("STT") - F.coalesce(F.try_divide(F.col("ST") ** 2, "CT"), F.lit(0.0))), F.sum("CT")), F.lit(0.0)).alias("s2"))
    groups = by.groupBy(*keys).agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("_v", F.col("c").cast("double")))).alias("have"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    # chance that two records of one group agree, against that of any two records, gives the prior's weight
    agree = groups.agg((F.sum("same") / F.nullif(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))).alias("agree"))
    g = beside(beside(groups, one), agree)
    chance = F.aggregate("cats", F.lit(0.0), lambda a, x: a + (x["C"] / F.col("all_n")) ** 2)
    rho = F.least(F.greatest((F.coalesce("agree", chance) - chance) / F.greatest(1 - chance, F.lit(1e-9)), F.lit(0.001)), F.lit(0.999))
    g = g.withColumns({"alpha": (1 - rho) / rho, "cats": F.array_sort("cats")})
    s2 = F.greatest("s2", F.lit(1e-9))
    score = F.transform(
        "cats",
        lambda x: F.struct(
            x["k"].alias("k"),
            (F.log((F.coalesce(F.try_element_at("have", x["k"]), F.lit(0.0)) + F.col("alpha") * x["C"] / F.col("all_n")) / (F.col("n") + F.col("alpha"))) - x["m"] ** 2 / (2 * s2) * F.when(F.col("s2") > 0, 1).otherwise(0)).alias("a"),
            (x["m"] / s2 * F.when(F.col("s2") > 0, 1).otherwise(0)).alias("b"),
            F.col("mid").alias("mid"),
        ),
    )
    return g.select(*keys, F.struct(score.alias("score")).alias("_m"))
