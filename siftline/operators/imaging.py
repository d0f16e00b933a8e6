"""Quality checks of image volumes: DataFrame of volumes in (siftline.sources.files.volumes), flags out.

A check is registered with ``@check`` and gives (path, severity, message); the runner joins all of them, and one
that fails becomes a flag itself. Per-scan checks are column expressions; the cohort check is one aggregation
by site. Registration and skull stripping need image libraries that aren't here and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FLAG = "path string, severity string, message string"


def check(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    CHECKS[f.__name__] = f
    return f


def _flags(v: DataFrame, *rules: tuple[Column, str, str]) -> DataFrame:
    hits = F.filter(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for c, s, m in rules)), F.isnotnull)
    return v.select("path", F.explode(hits).alias("x")).select("path", "x.severity", "x.message")


@check
def readable(v: DataFrame) -> DataFrame:
    return v.where("problem is not null").select("path", F.lit("error").alias("severity"), F.col("problem").alias("message"))


@check
def orientation(v: DataFrame) -> DataFrame:
    ok = v.where("problem is null")
    return _flags(ok, ((F.col("sform") == 0) & (F.col("qform") == 0), "error", "no orientation"), ((F.col("sform") == 0) != (F.col("qform") == 0), "warn", "one orientation is missing"), (F.col("axes") != F.col("qaxes"), "error", "orientations disagree"))


@check
def sanity(v: DataFrame) -> DataFrame:
    ok = v.where("problem is null")
    sp = F.slice("spacing", 1, 3)
    return _flags(
        ok, (F.size("dims") != 3, "error", "not three-dimensional"), (F.array_min("dims") < 8, "error", "a side under 8 voxels"), ((F.array_min(sp) < 0.3) | (F.array_max(sp) > 5), "warn", "spacing outside 0.3 to 5 mm"),
        (F.array_max(sp) / F.nullif(F.array_min(sp), F.lit(0.0)) > 8, "warn", "spacing very uneven"), (~F.col("finite"), "error", "values that aren't finite"), (F.col("constant"), "error", "constant"), (F.col("dead_slices") > 0, "error", "dead slices inside"),
    )


@check
def intensity(v: DataFrame) -> DataFrame:
    """Do the sites' medians differ by more than a tenth of their mean?"""
    s = v.where("median is not null and site is not null").groupBy("site").agg(F.percentile("median", 0.5).alias("m"))
    c = s.agg((F.stddev_pop("m") / F.avg("m")).alias("cov"), F.count("*").alias("n"))
    return c.where("n > 1 and cov > 0.1").select(F.lit(None).cast("string").alias("path"), F.lit("warn").alias("severity"), F.concat(F.lit("intensity differs by site: "), F.round("cov", 3).cast("string")).alias("message"))


def run(v: DataFrame, names: list[str] | None = None) -> DataFrame:
    """path, check, severity, message of all checks, errors first."""
    out = None
    for name in names or list(CHECKS):
        try:
            f = CHECKS[name](v)
        except Exception as e:  # noqa: BLE001 - a failing check is a flag
            f = v.sparkSession.createDataFrame([(None, "error", f"check failed: {e}"[:200])], FLAG)
        f = f.withColumn("check", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2), "check", "path")


def overlap(a: Column, b: Column) -> Column:
    """Dice overlap of two masks given as arrays of voxel numbers; 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / both)
