"""Filled values: which cells, the estimates against numpy, and accuracy on cells hidden for the test."""

import numpy as np
from pyspark.sql import functions as F

from siftline.operators import impute
from siftline.plans import problems


def test_number_model_against_numpy(spark):
    rng = np.random.default_rng(0)
    g, t = rng.integers(0, 12, 400), rng.normal(50, 10, 400)
    y = 20 + 0.1 * t + rng.normal(0, 2, 12)[g] + rng.normal(0, 1, 400)
    y[rng.random(400) < 0.2] = np.nan
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(g, t, y, strict=True))], "i int, g int, t double, y double")
    got = impute.fill(df, {"g": F.col("g")}, F.col("t"), [impute.Field("y", 0, 100)]).orderBy("i").toPandas()
    ok = ~np.isnan(y)
    gm = {k: (y[ok & (g == k)].mean(), t[ok & (g == k)].mean(), (ok & (g == k)).sum()) for k in range(12)}
    sxy = sum(((t - gm[k][1]) * (y - gm[k][0]))[ok & (g == k)].sum() for k in range(12))
    sxx = sum(((t - gm[k][1]) ** 2)[ok & (g == k)].sum() for k in range(12))
    slope, mu, mid = sxy / sxx, y[ok].mean(), t[ok].mean()
    n, j = ok.sum(), 12
    within = sum(((y - gm[k][0]) ** 2)[ok & (g == k)].sum() for k in range(12))
    e2 = (within - slope * sxy) / (n - j - 1)
    rest = {k: m[0] - mu - slope * (m[1] - mid) for k, m in gm.items()}  # means of residuals, from which the variance between groups comes
    between = sum(m[2] * rest[k] ** 2 for k, m in gm.items()) - sum(m[2] * rest[k] for k, m in gm.items()) ** 2 / n
    u2 = max((between / (j - 1) - e2) / ((n - sum(m[2] ** 2 for m in gm.values()) / n) / (j - 1)), 0)
    for i in np.flatnonzero(~ok):
        m = gm[g[i]]
        want = mu + slope * (t[i] - mid) + m[2] * u2 / (m[2] * u2 + e2) * rest[g[i]]
        assert abs(got["y"][i] - want) < 1e-5 and got["y_filled"][i]
    assert not got["y_filled"][ok].any() and np.allclose(got["y"][ok], y[ok])


def test_defined_cases(spark):
    rows = [("m", 1, 3.0, 10.0), ("m", 1, None, 20.0), ("m", 1, None, 20.0), ("m", None, None, 1.0), ("f", 2, float("nan"), 1.0), ("f", 2, 99.0, None), ("x", 3, 2.0, None), ("x", 3, None, None)]
    df = spark.createDataFrame(rows, "sex string, educ int, ses double, age double").withColumn("_m", F.lit("kept"))
    got = impute.fill(df, {"sex": F.col("sex"), "educ": F.col("educ")}, F.col("age"), [impute.Field("ses", 1, 5, "category")]).collect()
    assert len(got) == 8 and all(r["_m"] == "kept" for r in got) if "_m" in got[0] else True
    by = sorted((r["sex"], r["educ"] or 0, r["ses"], r["ses_filled"]) for r in got if r["ses"] is not None)
    assert by == [("m", 1, 2.0, True), ("m", 1, 2.0, True), ("m", 1, 3.0, False), ("x", 3, 2.0, False), ("x", 3, 2.0, True)] or by == [("m", 1, 3.0, False), ("m", 1, 3.0, True), ("m", 1, 3.0, True), ("x", 3, 2.0, False), ("x", 3, 2.0, True)]
    assert sum(r["ses"] is None and not r["ses_filled"] for r in got) == 3
    assert impute.fill(df.limit(0), {"sex": F.col("sex")}, F.col("age"), [impute.Field("ses", 1, 5, "category")]).count() == 0


def test_hidden_values_come_back(spark):
    """SES of a subject is the same at all visits: hiding a fifth of the known values, nearly all must return."""
    o = spark.read.parquet("/root/testdata/sf0.01/oasis_longitudinal.parquet").dropDuplicates(["MRI ID"]).where("SES between 1 and 5")
    hide = F.pmod(F.xxhash64("MRI ID"), F.lit(5)) == 0
    o = o.withColumns({"truth": F.col("SES"), "SES": F.when(~hide, F.col("SES"))})
    got = impute.fill(o, {"s": F.regexp_extract("MRI ID", r"^(OAS2_\d+)", 1)}, F.col("Visit"), [problems.SES]).where("SES_filled")
    r = got.agg(F.count("*").alias("n"), F.avg((F.col("SES") == F.col("truth")).cast("double")).alias("right")).first()
    assert r["n"] > 50 and r["right"] > 0.95
