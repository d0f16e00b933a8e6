"""Queries over feeders, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import ranks, tables
from siftline.session import number, table
from siftline.sources import cohort as co
from siftline.sources.clinical import current_visits

R = lambda c, n=6: F.round(c, n)
_C = """c AS (SELECT DISTINCT subject_id, dx, conversion, CASE WHEN NOT isnan(age) THEN age END AS age, sex, site, scanner, amyloid, CASE WHEN NOT isnan(p_tau217) THEN p_tau217 END AS p_tau217,
 CASE WHEN NOT isnan(gfap) THEN gfap END AS gfap, CASE WHEN NOT isnan(nfl) THEN nfl END AS nfl, apoe4, emb FROM adni_contract)"""
_NUM = "CASE WHEN NOT isnan({0}) THEN {0} END"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_OASIS = """
x AS (SELECT 'oas1:' || ID AS subject_id, CASE WHEN NOT isnan(CDR) THEN CDR END AS cdr, Age AS age, "M/F" AS sex, eTIV AS etiv, nWBV AS nwbv, ASF AS asf, NULL AS grp, 'oasis1' AS site FROM (SELECT DISTINCT * FROM oasis_cross_sectional) WHERE CDR IS NOT NULL AND NOT isnan(CDR)),
l AS (SELECT 'oas2:' || regexp_extract("MRI ID", '^(OAS2_[0-9]+)', 1) AS subject_id, CASE WHEN NOT isnan(CDR) THEN CDR END AS cdr, Age AS age, "M/F" AS sex, eTIV AS etiv, nWBV AS nwbv, ASF AS asf, "Group" AS grp, 'oasis2' AS site,
 row_number() OVER (PARTITION BY regexp_extract("MRI ID", '^(OAS2_[0-9]+)', 1) ORDER BY "MRI ID", coalesce(CASE WHEN NOT isnan(CDR) THEN CDR END, 99)) AS k FROM oasis_longitudinal WHERE Visit = 1),
u AS (SELECT *, nwbv * etiv AS brain, nwbv / asf AS ratio FROM (SELECT * FROM x UNION ALL SELECT * EXCLUDE k FROM l WHERE k = 1))
"""


@query("feed_oasis", f"""WITH {_OASIS}, m AS (SELECT avg(etiv) a, stddev_pop(etiv) b, avg(nwbv) c, stddev_pop(nwbv) d, avg(asf) e, stddev_pop(asf) f, avg(brain) g, stddev_pop(brain) h, avg(ratio) i, stddev_pop(ratio) j FROM u)
SELECT subject_id, site, CASE WHEN cdr = 0 THEN 'CN' WHEN cdr = 0.5 THEN 'MCI' WHEN cdr IS NOT NULL THEN 'AD' END AS dx, CASE WHEN grp = 'Converted' THEN 1 WHEN grp = 'Nondemented' THEN 0 END AS conversion,
 round((etiv - a) / b, 6) AS etiv_z, round((nwbv - c) / d, 6) AS nwbv_z, round((asf - e) / f, 6) AS asf_z, round((brain - g) / h, 6) AS brain_z, round((ratio - i) / j, 6) AS ratio_z FROM u, m""")
def feed_oasis(spark: SparkSession, d: str) -> DataFrame:
    return co.load(spark, d, "oasis").df.select("subject_id", "site", "dx", F.col("conversion").cast("int").alias("conversion"), *(R(f"{c}_z").alias(f"{c}_z") for c in ("etiv", "nwbv", "asf", "brain", "ratio")))


@query("feed_embedding_z", f"""WITH {_C}, e AS (SELECT subject_id, unnest(emb) AS x, generate_subscripts(emb, 1) - 1 AS dim FROM c), m AS (SELECT dim, avg(x) AS a, stddev_pop(x) AS s FROM e GROUP BY dim)
SELECT subject_id, CAST(dim AS INT) AS dim, round((x - a) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM e JOIN m USING (dim)""")
def feed_embedding_z(spark: SparkSession, d: str) -> DataFrame:
    return co.embedding_z(co.contract(spark, d)).withColumn("z", R("z"))


@query("feed_slice_3t", f"WITH {_C} SELECT subject_id, '3T' AS strength FROM c WHERE CAST(scanner AS DOUBLE) = 3")
def feed_slice_3t(spark: SparkSession, d: str) -> DataFrame:
    return co.load(spark, d, "adni:3T").df.select("subject_id", co.field_strength(F.col("scanner")).alias("strength"))


@query("feed_mapped_export", """SELECT CAST(RID AS VARCHAR) AS subject_id, CASE WHEN DIAGNOSIS = 1 THEN 'CN' WHEN DIAGNOSIS = 2 THEN 'MCI' WHEN DIAGNOSIS = 3 THEN 'AD' END AS dx, CAST(SITEID AS VARCHAR) AS site, CAST(NULL AS VARCHAR) AS scanner, count(*) AS n FROM dxsum GROUP BY ALL""")
def feed_mapped_export(spark: SparkSession, d: str) -> DataFrame:
    names = {"subject_id": ["PTNUM", "rid"], "dx": ["DX", "diagnosis"], "site": ["SITE", "SITEID"], "scanner": ["FIELD_STRENGTH"]}
    m = co.map_export(table(spark, d, "dxsum"), names, {"dx": {"1": "CN", "2": "MCI", "3": "AD", "Dementia": "AD", "CN": "CN", "MCI": "MCI"}})
    return m.select(*(F.col(c).cast("string").alias(c) for c in m.columns)).groupBy(*m.columns).agg(F.count("*").alias("n"))


@query("feed_validation", """WITH k AS (SELECT subject_id, count(*) c FROM adni_contract GROUP BY 1)
SELECT 'repeated keys' AS problem, count(*) AS n FROM k WHERE c > 1 HAVING count(*) > 0""")
def feed_validation(spark: SparkSession, d: str) -> DataFrame:
    return co.validate(table(spark, d, "adni_contract"))


@query("feed_deidentified", "SELECT printf('AR%07d', dense_rank() OVER (ORDER BY RID)) AS code, RID, count(*) AS visits FROM dxsum WHERE RID IS NOT NULL GROUP BY RID")
def feed_deidentified(spark: SparkSession, d: str) -> DataFrame:
    """A dense serial number by RID, with the crosswalk apart from the visits."""
    v = table(spark, d, "dxsum").where("RID is not null").groupBy("RID").agg(F.count("*").alias("visits"))
    return ranks.serial(v, "RID").select(F.format_string("AR%07d", "serial").alias("code"), "RID", "visits")


@query("project_target", f"""WITH {_C}, s AS (SELECT site, dense_rank() OVER (ORDER BY site) - 1 AS code FROM (SELECT DISTINCT site FROM c WHERE site IS NOT NULL)), n AS (SELECT scanner, dense_rank() OVER (ORDER BY scanner) - 1 AS code FROM (SELECT DISTINCT scanner FROM c WHERE scanner IS NOT NULL))
SELECT subject_id, CASE dx WHEN 'AD' THEN 1 ELSE 0 END AS y, s.code AS site_code, n.code AS scanner_code, coalesce(c.site, '__na__') AS grp FROM c LEFT JOIN s USING (site) LEFT JOIN n USING (scanner) WHERE dx IN ('AD', 'CN')""")
def project_target(spark: SparkSession, d: str) -> DataFrame:
    return tables.point_head(co.contract(spark, d), "dx_binary").select("subject_id", "y", "site_code", "scanner_code", "grp")


@query("project_region", f"WITH {_C} SELECT subject_id, round(emb[1], 6) AS r0, round(emb[4], 6) AS r1, round(emb[8], 6) AS r2 FROM c")
def project_region(spark: SparkSession, d: str) -> DataFrame:
    r = tables.restrict(co.contract(spark, d), [0, 3, 7])
    return r.select("subject_id", *(R(F.col("emb")[i]).alias(f"r{i}") for i in range(3)))


@query("project_complete_cases", f"WITH {_C} SELECT dx, count(*) AS n, count(DISTINCT site) AS sites FROM c WHERE p_tau217 IS NOT NULL AND gfap IS NOT NULL AND nfl IS NOT NULL AND dx IN ('AD', 'CN') GROUP BY dx")
def project_complete_cases(spark: SparkSession, d: str) -> DataFrame:
    return tables.complete_cases(co.contract(spark, d), ["p_tau217", "gfap", "nfl"]).where(F.col("dx").isin("AD", "CN")).groupBy("dx").agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))


_MEASURES = ["pT217_F", "AB42_AB40_F", "GFAP_Q", "GFAP_F", "NfL_Q", "NfL_F"]
_HAVE = " + ".join(f"CASE WHEN {m} >= 0 AND NOT isnan({m}) THEN 1 ELSE 0 END" for m in _MEASURES)


@query("filter_row_coverage", f"SELECT DRAW_ID, ({_HAVE}) AS present FROM upenn_plasma WHERE ({_HAVE}) / 6.0 > 0.6")
def filter_row_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = tables.mask_sentinels(table(spark, d, "upenn_plasma"), _MEASURES)
    return tables.covered_rows(t, _MEASURES, 0.6).select("DRAW_ID", F.col("present"))


@query("filter_column_coverage", "SELECT name AS column_name, round(avg(CASE WHEN v >= 0 AND NOT isnan(v) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS name, {m} AS v FROM upenn_plasma" for m in _MEASURES) + ") GROUP BY name")
def filter_column_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = tables.mask_sentinels(table(spark, d, "upenn_plasma"), _MEASURES)
    return tables.column_coverage(t, tables.columns_like(t, r"^[A-Za-z0-9]+(_AB40)?_[QF]$")).withColumn("coverage", R("coverage"))


@query("filter_covered_columns_z", """WITH p AS (SELECT DRAW_ID, CASE WHEN pT217_F >= 0 AND NOT isnan(pT217_F) THEN pT217_F END AS v FROM upenn_plasma), m AS (SELECT avg(v) a, stddev_pop(v) s FROM p)
SELECT DRAW_ID, round(coalesce((v - a) / s, 0), 6) AS "pT217_F_z" FROM p, m""")
def filter_covered_columns_z(spark: SparkSession, d: str) -> DataFrame:
    """Columns covered well enough, z-scored, gaps as 0."""
    t = tables.mask_sentinels(table(spark, d, "upenn_plasma"), _MEASURES)
    out = tables.covered_columns_z(t, ["DRAW_ID"], ["pT217_F"], 0.5)
    return out.select("DRAW_ID", *(R(c).alias(c) for c in out.columns if c != "DRAW_ID"))


@query("scalar_plasma", """SELECT DRAW_ID, coalesce(CASE WHEN GFAP_Q >= 0 AND NOT isnan(GFAP_Q) THEN GFAP_Q END, CASE WHEN GFAP_F >= 0 AND NOT isnan(GFAP_F) THEN GFAP_F END) AS gfap,
 coalesce(CASE WHEN NfL_Q >= 0 AND NOT isnan(NfL_Q) THEN NfL_Q END, CASE WHEN NfL_F >= 0 AND NOT isnan(NfL_F) THEN NfL_F END) AS nfl,
 CASE WHEN pT217_F >= 0 AND NOT isnan(pT217_F) THEN least(1, pT217_F) END AS clamped, CASE WHEN AB42_AB40_F >= 0 AND NOT isnan(AB42_AB40_F) THEN CAST(AB42_AB40_F < 0.06 AS INT) END AS low_ratio FROM upenn_plasma""")
def scalar_plasma(spark: SparkSession, d: str) -> DataFrame:
    """Codes below 0 as null, one assay in place of the other, values clamped, a threshold that keeps nulls."""
    t = tables.mask_sentinels(table(spark, d, "upenn_plasma"), _MEASURES)
    return t.select("DRAW_ID", F.coalesce("GFAP_Q", "GFAP_F").alias("gfap"), F.coalesce("NfL_Q", "NfL_F").alias("nfl"), tables.clamp(F.col("pT217_F")).alias("clamped"), (F.col("AB42_AB40_F") < 0.06).cast("int").alias("low_ratio"))


@query("scalar_text", r"""SELECT ID, split_part(PTID, '_S_', 1) AS site_prefix, lower(trim(regexp_replace(PHASE, '[^A-Za-z0-9]+', '-', 'g'))) AS slug, length(PTID) - length(replace(PTID, '4', '')) AS fours, PTID LIKE '127%' AS hub,
 year(EXAMDATE) AS y, CAST(date_diff('day', CAST(EXAMDATE AS DATE), CAST(update_stamp AS DATE)) AS INT) AS late_days FROM dxsum""")
def scalar_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dxsum")
    return t.select("ID", F.split_part("PTID", F.lit("_S_"), F.lit(1)).alias("site_prefix"), tables.slug(F.col("PHASE")).alias("slug"), (F.length("PTID") - F.length(F.replace("PTID", F.lit("4"), F.lit("")))).alias("fours"), F.col("PTID").startswith("127").alias("hub"), F.year("EXAMDATE").alias("y"), F.date_diff(F.to_date("update_stamp"), F.to_date("EXAMDATE")).alias("late_days"))


_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID, VISCODE2 ORDER BY update_stamp DESC, ID) k FROM dxsum) WHERE k = 1 AND EXAMDATE IS NOT NULL)"


@query("join_nearest_draw", f"""WITH {_CUR}, a AS (SELECT RID, min(EXAMDATE) AS t0 FROM cur GROUP BY RID),
p AS (SELECT a.RID, DRAW_ID, abs(date_diff('day', CAST(u.EXAMDATE AS DATE), CAST(t0 AS DATE))) AS gap, row_number() OVER (PARTITION BY a.RID ORDER BY abs(epoch_us(u.EXAMDATE) - epoch_us(t0)), epoch_us(u.EXAMDATE), DRAW_ID) AS k FROM a JOIN upenn_plasma u USING (RID) WHERE u.EXAMDATE IS NOT NULL)
SELECT RID, DRAW_ID AS draw_id, CAST(gap AS INT) AS gap_days FROM p WHERE k = 1""")
def join_nearest_draw(spark: SparkSession, d: str) -> DataFrame:
    """For each RID the draw nearest in time to its first visit: an equi-join on RID and a minimum, so a frequent RID is combined before the shuffle."""
    anchor = current_visits(table(spark, d, "dxsum")).groupBy("RID").agg(F.min("EXAMDATE").alias("at"))
    draws = table(spark, d, "upenn_plasma").where("EXAMDATE is not null").select("RID", "DRAW_ID", "EXAMDATE")
    return tables.nearest_to_anchor(anchor, draws, "RID", "at", "EXAMDATE", "DRAW_ID").select("RID", F.col("DRAW_ID").alias("draw_id"), "gap_days")


@query("join_left_first", """WITH f AS (SELECT RID, pT217_F FROM (SELECT RID, CASE WHEN pT217_F >= 0 AND NOT isnan(pT217_F) THEN pT217_F END AS pT217_F, row_number() OVER (PARTITION BY RID ORDER BY coalesce(EXAMDATE, TIMESTAMP '9999-01-01'), DRAW_ID) k FROM upenn_plasma) WHERE k = 1),
v AS (SELECT RID, count(*) AS visits FROM dxsum WHERE RID IS NOT NULL GROUP BY RID) SELECT RID, visits, pT217_F AS first_value, f.RID IS NOT NULL AS drawn FROM v LEFT JOIN f USING (RID)""")
def join_left_first(spark: SparkSession, d: str) -> DataFrame:
    """Left join with the right side reduced to its first row a key."""
    p = tables.mask_sentinels(table(spark, d, "upenn_plasma"), _MEASURES)
    first = ranks.first_per_key(p.where("RID is not null").select("RID", "DRAW_ID", "EXAMDATE", "pT217_F"), ["RID"], [F.coalesce("EXAMDATE", F.lit("9999-01-01").cast("timestamp_ntz")), F.col("DRAW_ID")])
    v = table(spark, d, "dxsum").where("RID is not null").groupBy("RID").agg(F.count("*").alias("visits"))
    return v.join(first.select("RID", F.col("pT217_F").alias("first_value"), F.lit(True).alias("drawn")), "RID", "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))


_ENS = "".join(f", {n} AS (SELECT RID, avg(v) AS v FROM (SELECT RID, CASE WHEN {c} >= 0 AND NOT isnan({c}) THEN {c} END AS v FROM upenn_plasma WHERE RID IS NOT NULL) WHERE v IS NOT NULL GROUP BY RID), z{n} AS (SELECT RID, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM {n})" for n, c in (("a", "GFAP_Q"), ("b", "GFAP_F")))


@query("join_assay_ensemble", f"WITH {_ENS[2:]} SELECT RID, round((coalesce(za.z, 0) + coalesce(zb.z, 0)) / ((za.z IS NOT NULL)::INT + (zb.z IS NOT NULL)::INT), 6) AS ensemble, (za.z IS NOT NULL)::INT + (zb.z IS NOT NULL)::INT AS assays FROM za FULL JOIN zb USING (RID)")
def join_assay_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Assays averaged by subject, z-scored (sample deviation), joined in full and averaged over those present."""
    p = tables.mask_sentinels(table(spark, d, "upenn_plasma").where("RID is not null"), _MEASURES)
    return tables.ensemble(p, "RID", ["GFAP_Q", "GFAP_F"]).select("RID", R("ensemble").alias("ensemble"), "assays")


@query("join_ensemble_upgrade", f"""WITH {_C}, {_ENS[2:]}, e AS (SELECT CAST(RID AS VARCHAR) AS subject_id, coalesce(za.z, 0) + coalesce(zb.z, 0) AS s, (za.z IS NOT NULL)::INT + (zb.z IS NOT NULL)::INT AS k FROM za FULL JOIN zb USING (RID))
SELECT subject_id, gfap AS native, round(coalesce(s / k, gfap), 6) AS upgraded FROM c LEFT JOIN e USING (subject_id)""")
def join_ensemble_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """The contract with the ensemble where there is one, else its own value, which is kept."""
    p = tables.mask_sentinels(table(spark, d, "upenn_plasma").where("RID is not null"), _MEASURES)
    e = tables.ensemble(p, "RID", ["GFAP_Q", "GFAP_F"]).select(F.col("RID").cast("string").alias("subject_id"), "ensemble")
    return co.contract(spark, d).join(e, "subject_id", "left").select("subject_id", F.col("gfap").alias("native"), R(F.coalesce("ensemble", "gfap")).alias("upgraded"))


@query("join_anti_gap", "SELECT DISTINCT RID FROM upenn_plasma WHERE RID IS NOT NULL AND RID NOT IN (SELECT RID FROM dxsum WHERE RID IS NOT NULL)")
def join_anti_gap(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of one table that the other lacks."""
    return table(spark, d, "upenn_plasma").select("RID").where("RID is not null").distinct().join(table(spark, d, "dxsum").select("RID"), "RID", "left_anti")


@query("join_semi", "SELECT RID, count(*) AS n FROM dxsum WHERE RID IN (SELECT RID FROM upenn_plasma WHERE pT217_F >= 0.2 AND NOT isnan(pT217_F)) GROUP BY RID")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    high = table(spark, d, "upenn_plasma").where("pT217_F >= 0.2 and not isnan(pT217_F)").select("RID").distinct()
    return table(spark, d, "dxsum").join(high, "RID", "left_semi").groupBy("RID").agg(F.count("*").alias("n"))


_TRAJ = "t AS (SELECT RID, DIAGNOSIS AS g, row_number() OVER (PARTITION BY RID ORDER BY EXAMDATE, ID) AS k FROM cur WHERE DIAGNOSIS IN (1, 2, 3))"


@query("trajectory_conversion", f"WITH {_CUR}, {_TRAJ} SELECT RID, CAST(max(CASE WHEN k = 1 THEN g END) AS INT) AS first_state, count(*) AS visits, CASE WHEN max(CASE WHEN k = 1 THEN g END) = 2 AND count(*) > 1 THEN max(CASE WHEN k > 1 AND g = 3 THEN 1 ELSE 0 END) END AS conversion FROM t GROUP BY RID")
def trajectory_conversion(spark: SparkSession, d: str) -> DataFrame:
    """From MCI at the first visit to dementia at a later one; null without a later visit."""
    v = current_visits(table(spark, d, "dxsum"), "DIAGNOSIS").where("DIAGNOSIS in (1, 2, 3)")
    return tables.conversion(v, "RID", "EXAMDATE", "ID", "DIAGNOSIS", 2, 3).select("RID", F.col("first").cast("int").alias("first_state"), "visits", "conversion")


@query("trajectory_any_dementia", f"WITH {_CUR} SELECT RID, CAST(max(CASE WHEN DIAGNOSIS = 3 THEN 1 ELSE 0 END) AS INT) AS ever, min(CASE WHEN DIAGNOSIS = 3 THEN EXAMDATE END) AS since FROM cur GROUP BY RID HAVING count(CASE WHEN VISCODE2 IN ('bl', 'sc', 'q0', 'm0') THEN 1 END) > 0")
def trajectory_any_dementia(spark: SparkSession, d: str) -> DataFrame:
    """The variant that needs a baseline visit and takes any row of dementia."""
    v = current_visits(table(spark, d, "dxsum"), "DIAGNOSIS", "VISCODE2")
    g = v.groupBy("RID").agg(F.max(F.when(F.col("DIAGNOSIS") == 3, 1).otherwise(0)).alias("ever"), F.min(F.when(F.col("DIAGNOSIS") == 3, F.col("EXAMDATE"))).alias("since"), F.count(F.when(F.col("VISCODE2").isin("bl", "sc", "q0", "m0"), 1)).alias("b"))
    return g.where("b > 0").select("RID", "ever", "since")


@query("set_operations", """WITH a AS (SELECT DISTINCT RID FROM dxsum WHERE RID IS NOT NULL), b AS (SELECT DISTINCT RID FROM upenn_plasma WHERE RID IS NOT NULL)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("RID").where("RID is not null") for t in ("dxsum", "upenn_plasma"))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))


@query("edges_dedup", "SELECT least(subject_a, subject_b) AS a, greatest(subject_a, subject_b) AS b, max(noted_at) AS last_noted, count(*) AS n FROM subject_xref WHERE subject_a <> subject_b GROUP BY 1, 2")
def edges_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges once each, with the latest note; loops dropped."""
    return table(spark, d, "subject_xref").where("subject_a <> subject_b").groupBy(F.least("subject_a", "subject_b").alias("a"), F.greatest("subject_a", "subject_b").alias("b")).agg(F.max("noted_at").alias("last_noted"), F.count("*").alias("n"))


@query("sample_per_site", f"""WITH {_C}, s AS (SELECT site FROM c WHERE site IS NOT NULL GROUP BY site ORDER BY count(*) DESC, site LIMIT 10),
r AS (SELECT site, subject_id, row_number() OVER (PARTITION BY site ORDER BY md5(subject_id || ':7'), subject_id) AS k FROM c WHERE site IN (SELECT site FROM s)) SELECT site, subject_id FROM r WHERE k <= 5""")
def sample_per_site(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest sites, five subjects of each by hash."""
    c = co.contract(spark, d).where("site is not null").select("site", "subject_id")
    top = c.groupBy("site").count().orderBy(F.col("count").desc(), "site").limit(10)
    return ranks.top_k(c.join(F.broadcast(top.select("site")), "site", "left_semi"), ["site"], [F.md5(F.concat("subject_id", F.lit(":7"))), F.col("subject_id")], 5).select("site", "subject_id")


@query("downsample_even", f"WITH {_C}, r AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS i, count(*) OVER () AS n FROM c) SELECT subject_id FROM r WHERE i % CAST(greatest(ceil(n / 240.0), 1) AS BIGINT) = 0")
def downsample_even(spark: SparkSession, d: str) -> DataFrame:
    """At most 240 evenly spaced subjects in order."""
    return tables.evenly(co.contract(spark, d).select("subject_id"), "subject_id", 240)


@query("pairs_both_hemispheres", """SELECT "MRI ID" AS id, Visit AS visit, round((eTIV + nWBV * 1000) / 2, 6) AS paired FROM (SELECT DISTINCT "MRI ID", Visit, eTIV, CASE WHEN NOT isnan(nWBV) THEN nWBV END AS nWBV FROM oasis_longitudinal) WHERE nWBV IS NOT NULL""")
def pairs_both_hemispheres(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of one region kept only if both exist and averaged, by names found at plan time."""
    t = table(spark, d, "oasis_longitudinal").select(F.col("MRI ID").alias("id"), F.col("Visit").alias("visit"), F.col("eTIV").cast("double").alias("vol_left"), (number("nWBV") * 1000).alias("vol_right"), F.lit(1.0).alias("odd_left")).distinct()
    return tables.paired_mean(t, "_left", "_right").where("vol_right is not null").select("id", "visit", R("vol").alias("paired"))


@query("field_strength_fallback", f"WITH {_C} SELECT subject_id, CASE WHEN scanner IS NOT NULL THEN CASE WHEN CAST(scanner AS DOUBLE) = 3 THEN '3T' ELSE '1.5T' END ELSE CASE WHEN apoe4 = 1 THEN '3T' ELSE 'unknown' END END AS strength FROM c")
def field_strength_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The label where there is one, else a coded value."""
    return co.contract(spark, d).select("subject_id", F.coalesce(co.field_strength(F.col("scanner")), F.when(F.col("apoe4") == 1, "3T"), F.lit("unknown")).alias("strength"))
