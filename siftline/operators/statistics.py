"""Effect sizes, associations and summaries. Each is one or two grouped aggregations.

Defined cases: rows with a null or NaN in a variable of a measure are left out of that measure; measures that
aren't defined (no variance, one group, too few rows) are null; an empty table gives no row for a grouped
measure and a row of nulls for a global one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import beside, number

Z95 = 1.959963984540054  # fixed value: the normal quantile of a two-sided 95 % interval


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate over rows that have both; null without variance, where corr would fail."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def eta_squared(df: DataFrame, group: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, groups, eta2: share of the value's variance that lies between groups."""
    keys = keys or []
    g = df.select(*keys, F.col(group).alias("_g"), number(value).alias("_v")).where("_g is not null and _v is not null").groupBy(*keys, "_g").agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") ** 2).alias("ss"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), (F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("_b"), (F.sum("ss") - F.sum("s") ** 2 / F.sum("n")).alias("_t"))
    return t.select(*keys, "n", "groups", F.when((F.col("_t") > 1e-12) & (F.col("groups") > 1), F.least(F.greatest(F.col("_b") / F.col("_t"), F.lit(0.0)), F.lit(1.0))).alias("eta2"))


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 20) -> DataFrame:
    """keys, n, r, lo, hi: correlation of complete pairs with Fisher's 95 % interval, from ``least`` pairs on; r2 from 3 on."""
    keys = keys or []
    p = df.select(*keys, number(x).alias("_x"), number(y).alias("_y")).where("_x is not null and _y is not null").groupBy(*keys).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("_r"))
    r = F.col("_r")
    z, half = F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999))), F.lit(Z95) / F.sqrt(F.col("n") - 3)
    ok = F.col("n") >= least
    return p.select(*keys, "n", F.when(F.col("n") >= 3, r * r).alias("r2"), F.when(ok, r).alias("r"), F.when(ok, F.tanh(z - half)).alias("lo"), F.when(ok, F.tanh(z + half)).alias("hi"))


def cohens_d(df: DataFrame, flag: Column, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n1, n0, d (pooled deviation) with 95 % interval, smd (deviation of all), difference of means."""
    keys = keys or []
    v, f = number(value), flag.cast("boolean")
    a = df.select(*keys, v.alias("_v"), f.alias("_f")).where("_v is not null and _f is not null").groupBy(*keys).agg(
        F.count(F.when(F.col("_f"), 1)).alias("n1"), F.count(F.when(~F.col("_f"), 1)).alias("n0"), F.avg(F.when(F.col("_f"), F.col("_v"))).alias("m1"), F.avg(F.when(~F.col("_f"), F.col("_v"))).alias("m0"),
        F.var_samp(F.when(F.col("_f"), F.col("_v"))).alias("v1"), F.var_samp(F.when(~F.col("_f"), F.col("_v"))).alias("v0"), F.stddev_samp("_v").alias("sd"),
    )
    diff = F.col("m1") - F.col("m0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") > 1) & (F.col("n0") > 1) & (pooled > 0), diff / pooled)
    se = F.sqrt((F.col("n1") + F.col("n0")) / (F.col("n1") * F.col("n0")) + d * d / (2 * (F.col("n1") + F.col("n0"))))
    return a.select(*keys, "n1", "n0", diff.alias("difference"), d.alias("d"), (d - Z95 * se).alias("lo"), (d + Z95 * se).alias("hi"), F.when(F.col("sd") > 0, diff / F.col("sd")).alias("smd"))


def point_biserial(df: DataFrame, flag: Column, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, difference (mean of the flagged less the others'), r (correlation of flag and value)."""
    keys = keys or []
    v = df.select(*keys, flag.cast("double").alias("_f"), number(value).alias("_v")).where("_f is not null and _v is not null")
    return v.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(F.when(F.col("_f") == 1, F.col("_v"))) - F.avg(F.when(F.col("_f") == 0, F.col("_v")))).alias("difference"), correlation("_f", "_v").alias("r"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, v: association of two categories, without continuity correction."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("o"))
    ra, rb = t.groupBy("_a").agg(F.sum("o").alias("na")), t.groupBy("_b").agg(F.sum("o").alias("nb"))
    tot = t.agg(F.sum("o").alias("n"), F.countDistinct("_a").alias("ka"), F.countDistinct("_b").alias("kb"))
    # chi2 / n = sum of o^2 / (na nb) - 1: cells without rows add nothing, so no cross join is needed
    x = beside(t.join(ra, "_a").join(rb, "_b").agg(F.sum(F.col("o") ** 2 / (F.col("na") * F.col("nb"))).alias("s")), tot)
    k = F.least("ka", "kb") - 1
    return x.select("n", F.when(k > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / k)).alias("v"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share."""
    p, z2 = k / n, Z95 * Z95
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def calibration(df: DataFrame, p: str, label: Column, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """keys, n, brier, ece, mce: with equal bins of [0, 1], the last one closed."""
    keys = keys or []
    v = df.select(*keys, number(p).alias("_p"), label.cast("double").alias("_y")).where("_p is not null and _y is not null").withColumn("_bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    b = v.groupBy(*keys, "_bin").agg(F.count("*").alias("c"), F.abs(F.avg("_p") - F.avg("_y")).alias("gap"), F.sum((F.col("_p") - F.col("_y")) ** 2).alias("se"))
    return b.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum("se") / F.sum("c")).alias("brier"), (F.sum(F.col("c") * F.col("gap")) / F.sum("c")).alias("ece"), F.max("gap").alias("mce"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, ari: agreement of two partitions, corrected for chance; 1 where both are trivial."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    x = beside(beside(t.agg(pairs("c").alias("ij"), F.sum("c").alias("n")), t.groupBy("_a").agg(F.sum("c").alias("c")).agg(pairs("c").alias("i"))), t.groupBy("_b").agg(F.sum("c").alias("c")).agg(pairs("c").alias("j")))
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("i") + F.col("j")) / 2
    return x.select("n", F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def log_factorial(n: Column) -> Column:
    """log n!: a table up to 9, from there Stirling's series, which is exact to 1e-13."""
    few = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10)))
    z = n.cast("double") + 1
    return F.when(n < 10, F.get(few, n.cast("int"))).otherwise((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mi, nmi, ami: information (in nats) that two partitions share; by their mean entropy; and corrected for chance.

    The expected information sums the hypergeometric law of each pair of distinct class sizes over the counts
    within 12 deviations of the mean, outside of which less than 1e-15 lies; so the work depends on the number of
    classes and the root of the rows, not on the rows. The first partition's sizes meet the second's as an array,
    which holds the distinct sizes only. Rows with a null on either side don't count; two trivial partitions have ami 1.
    """
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    ra, rb = t.groupBy("_a").agg(F.sum("c").alias("na")), t.groupBy("_b").agg(F.sum("c").alias("nb"))
    n = t.agg(F.sum("c").alias("n"))
    mi = beside(t.join(ra, "_a").join(rb, "_b"), n).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("n") * F.col("c") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda r, c: beside(r, n).agg((-F.sum(F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n")))).alias(f"h{c}"))
    sizes = rb.groupBy("nb").agg(F.count("*").alias("kb")).agg(F.collect_list(F.struct("nb", "kb")).alias("bs"))
    pairs = beside(beside(ra.groupBy("na").agg(F.count("*").alias("ka")), sizes), n).select("na", "ka", "n", F.inline("bs"))
    mean = F.col("na") * F.col("nb") / F.col("n")
    wide = 12 * F.sqrt(mean * (1 - F.col("na") / F.col("n")) * (F.col("n") - F.col("nb")) / F.greatest(F.col("n") - 1, F.lit(1))) + 12
    lo = F.greatest(F.lit(1), F.col("na") + F.col("nb") - F.col("n"), F.floor(mean - wide)).cast("bigint")
    hi = F.least("na", "nb", F.ceil(mean + wide)).cast("bigint")
    e = pairs.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    lf = log_factorial
    law = lf(F.col("na")) + lf(F.col("nb")) + lf(F.col("n") - F.col("na")) + lf(F.col("n") - F.col("nb")) - lf(F.col("n")) - lf(F.col("k")) - lf(F.col("na") - F.col("k")) - lf(F.col("nb") - F.col("k")) - lf(F.col("n") - F.col("na") - F.col("nb") + F.col("k"))
    expected = e.agg(F.sum(F.col("ka") * F.col("kb") * F.col("k") / F.col("n") * F.log(F.col("n") * F.col("k") / (F.col("na") * F.col("nb"))) * F.exp(law)).alias("emi"))
    x = beside(beside(beside(beside(n, mi), h(ra, "na")), h(rb, "nb")), expected)
    mid = (F.col("hna") + F.col("hnb")) / 2
    return x.select("n", "mi", F.when(mid > 0, F.col("mi") / mid).otherwise(1.0).alias("nmi"), F.when(F.abs(mid - F.col("emi")) > 1e-12, (F.col("mi") - F.col("emi")) / (mid - F.col("emi"))).otherwise(1.0).alias("ami"))


def z_scores(df: DataFrame, values: list[str], keys: list[str] | None = None, ddof: int = 0, zero: float | None = None) -> DataFrame:
    """df with <value>_z; where the deviation is 0 it counts as 1 if zero is 0.0, else the score is null."""
    keys = keys or []
    dev = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = [x for v in values for x in (F.avg(number(v)).alias(f"_m_{v}"), dev(number(v)).alias(f"_s_{v}"))]
    m = df.groupBy(*keys).agg(*aggs)
    out = df.join(m, keys) if keys else beside(df, m)
    for v in values:
        z = F.when(F.col(f"_s_{v}") > 0, (number(v) - F.col(f"_m_{v}")) / F.col(f"_s_{v}"))
        out = out.withColumn(f"{v}_z", z if zero is None else F.coalesce(z, F.when(number(v).isNotNull(), F.lit(zero))))
    return out.drop(*(f"_{k}_{v}" for v in values for k in "ms"))
