"""Cohorts: a contract table (a row a subject) with its metadata, the catalogue that loads them by name, and validation.

Names follow a small grammar: ``oasis``, ``oasis:longitudinal``, ``oasis:cross-sectional``, ``adni``, then a
slice such as ``adni:3t`` or the harmonised view ``adni:combat``. Feeders read raw columns by candidate names;
all turn NaN into null at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.ranks import first_per_key
from siftline.operators.statistics import z_scores
from siftline.session import number, table

#: Columns of the contract table and the domains of its categories.
COLUMNS = ["subject_id", "dx", "conversion", "age", "sex", "site", "scanner", "amyloid", "p_tau217", "gfap", "nfl", "apoe4"]
DOMAINS = {"dx": ["CN", "MCI", "AD"], "sex": ["M", "F"], "conversion": ["0", "1"], "amyloid": ["0", "1"], "apoe4": ["0", "1", "2"]}


@dataclass
class Cohort:
    """A contract DataFrame and what is known about it."""

    df: DataFrame
    name: str
    substrate: str
    meta: dict = field(default_factory=dict)


def contract(spark: SparkSession, d: str) -> DataFrame:
    """adni_contract without repeated rows and with NaN as null."""
    t = table(spark, d, "adni_contract").distinct()
    return t.select(*(number(c).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


def cdr_band(cdr: Column) -> Column:
    """CN for 0, MCI for 0.5, AD for any other known value."""
    return F.when(cdr == 0, "CN").when(cdr == 0.5, "MCI").when(cdr.isNotNull(), "AD")


def field_strength(s: Column) -> Column:
    """1.5T, 3T from numbers in any notation; other texts stay."""
    n = s.try_cast("double")
    return F.coalesce(F.concat(F.regexp_replace(F.regexp_replace(n.cast("decimal(6,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("T")), s)


def feed_cross_sectional(spark: SparkSession, d: str) -> DataFrame:
    """Cross-sectional scans with a known CDR."""
    t = table(spark, d, "oasis_cross_sectional").distinct()
    return t.select(F.concat(F.lit("oas1:"), "ID").alias("subject_id"), number("CDR").alias("cdr"), F.col("Age").cast("double").alias("age"), F.col("M/F").alias("sex"), F.col("eTIV").cast("double").alias("etiv"), number("nWBV").alias("nwbv"), number("ASF").alias("asf"), F.lit(None).cast("string").alias("grp"), F.lit("oasis1").alias("site")).where("cdr is not null and subject_id is not null")


def feed_longitudinal(spark: SparkSession, d: str) -> DataFrame:
    """The first visit of each longitudinal subject, of repeated rows the first MRI ID."""
    t = table(spark, d, "oasis_longitudinal").where("Visit = 1 and `MRI ID` is not null")
    t = t.select(F.regexp_extract("MRI ID", r"^(OAS2_\d+)", 1).alias("s"), "MRI ID", number("CDR").alias("cdr"), F.col("Age").cast("double").alias("age"), F.col("M/F").alias("sex"), F.col("eTIV").cast("double").alias("etiv"), number("nWBV").alias("nwbv"), number("ASF").alias("asf"), F.col("Group").alias("grp"))
    t = first_per_key(t, ["s"], [F.col("MRI ID"), F.coalesce("cdr", F.lit(99.0))])
    return t.select(F.concat(F.lit("oas2:"), "s").alias("subject_id"), "cdr", "age", "sex", "etiv", "nwbv", "asf", "grp", F.lit("oasis2").alias("site"))


def oasis(spark: SparkSession, d: str) -> DataFrame:
    """Both OASIS feeders: three features and two ratios z-scored over all, diagnosis from the CDR, conversion from the group."""
    u = feed_cross_sectional(spark, d).unionByName(feed_longitudinal(spark, d))
    u = u.withColumns({"brain": F.col("nwbv") * F.col("etiv"), "ratio": F.col("nwbv") / F.col("asf"), "dx": cdr_band(F.col("cdr")), "conversion": F.when(F.col("grp") == "Converted", 1).when(F.col("grp") == "Nondemented", 0).cast("tinyint")})
    return z_scores(u, ["etiv", "nwbv", "asf", "brain", "ratio"], zero=0.0)


def embedding_z(c: DataFrame) -> DataFrame:
    """subject_id, dim, z: each dimension of emb z-scored over all subjects (population deviation, 0 counts as 1)."""
    e = c.select("subject_id", F.posexplode("emb").alias("dim", "x"))
    m = e.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    # a row a dimension
    return e.join(F.broadcast(m), "dim").select("subject_id", "dim", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))


def pick_column(df: DataFrame, candidates: list[str]) -> Column | None:
    """The first candidate that is a column, names compared without case; null if none is."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{have[c.lower()]}`") for c in candidates if c.lower() in have), None)


def map_values(c: Column, values: dict[str, str]) -> Column:
    """Values by a map whose keys are compared in lower case; 1.0 also matches "1"."""
    s = F.lower(F.trim(c.cast("string")))
    whole = F.regexp_replace(s, r"\.0+$", "")
    m = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(m, s), F.try_element_at(m, whole))


def map_export(df: DataFrame, names: dict[str, list[str]], values: dict[str, dict[str, str]]) -> DataFrame:
    """An export as contract columns: the first candidate name that exists, with mapped values; columns not found are null."""
    out = []
    for want, candidates in names.items():
        c = pick_column(df, candidates)
        c = F.lit(None).cast("string") if c is None else map_values(c, values[want]) if want in values else c
        out.append(c.alias(want))
    return df.select(*out)


def validate(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """problem, n: missing columns, null or repeated keys, values outside their domain; no row if all is well."""
    missing = [c for c in COLUMNS if c not in df.columns]
    rows = df.groupBy(key).agg(F.count("*").alias("c")).agg(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("repeated keys"), F.sum(F.when(F.col(key).isNull(), F.col("c")).otherwise(0)).alias("null keys"))
    doms = {k: v for k, v in DOMAINS.items() if k in df.columns}
    dom = df.agg(*(F.sum(F.when(~F.col(k).cast("string").isin(v), 1).otherwise(0)).alias(f"{k} outside its domain") for k, v in doms.items()))
    stack = lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias("n")) for c in t.columns))).alias("x")).select("x.*")
    out = stack(rows).unionByName(stack(dom)).where("n > 0")
    if missing:
        out = out.unionByName(df.sparkSession.createDataFrame([(f"no column {c}", 1) for c in missing], "problem string, n bigint"))
    return out


def combat(spark: SparkSession, d: str) -> DataFrame:
    from siftline.operators.harmonize import combat as fit

    return fit(contract(spark, d), "subject_id", "emb", "site", ["age", "sex"])


LOADERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "adni": (contract, "embeddings of scans (8 dimensions)"),
    "adni:combat": (combat, "embeddings of scans, harmonised by site"),
    "oasis": (oasis, "whole-brain volumes, z-scored"),
    "oasis:cross-sectional": (feed_cross_sectional, "whole-brain volumes"),
    "oasis:longitudinal": (feed_longitudinal, "whole-brain volumes at the first visit"),
}


def load(spark: SparkSession, d: str, name: str) -> Cohort:
    """A cohort by name; ``adni:<scanner>`` keeps one field strength, compared without case."""
    if name in LOADERS:
        f, what = LOADERS[name]
        return Cohort(f(spark, d), name, what)
    base, _, part = name.partition(":")
    if base == "adni" and part:
        return Cohort(contract(spark, d).where(F.lower(field_strength(F.col("scanner"))) == part.lower()), name, f"{LOADERS['adni'][1]}, {part}", {"slice": part})
    raise KeyError(f"no cohort is called {name}; there are {', '.join(LOADERS)}")
