"""Studies composed of the operators: dissociation, other heads, strata, power, enrichment, temporal validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import heads, linear, ranks, resample, tables
from siftline.plans.measures import _C, _U
from siftline.session import beside, cut, table
from siftline.sources import cohort as co

R = lambda c, n=6: F.round(c, n)
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    return cut(tables.point_head(co.contract(spark, d), "dx_binary"))


@query("study_dissociation")
def study_dissociation(spark: SparkSession, d: str) -> DataFrame:
    """Areas of outcome and scanner after the scanner's directions are projected out within each training set."""
    return dissociation(_outcome(spark, d))


def dissociation(p: DataFrame) -> DataFrame:
    """target, features, classes, auc of rows from point_head; rows without a scanner are a class of their own, "__na__".

    The scanner's area is the mean over all scanners, one against the rest; ``classes`` says how many have one, as
    a scanner whose rows share a fold (it is at one site only) can't be learned from the others.
    """
    v = p.select(F.col("subject_id").alias("id"), "y", F.col("grp"), F.col("emb").cast("array<double>").alias("x"), F.array().cast("array<double>").alias("c"), F.coalesce(F.col("scanner").cast("string"), F.lit("__na__")).alias("b")).where("x is not null")
    codes = ranks.serial(v.select("b").distinct(), "b", "s").select("b", (F.col("s") - 1).cast("int").alias("s"))
    f = cut(linear.folds(v.join(codes, "b"), "id", "y", "grp", 5))
    width, most = f.agg(F.max(F.size("x")), F.max("s")).first()
    dirs = linear.batch_directions(f, width, 5)
    out = None
    for what, y, classes in (("outcome", "y", [1]), ("scanner", "s", list(range(most + 1)) if most > 1 else [1])):
        g = cut(f.withColumn("y", F.col(y)))
        for name, without in (("plain", None), ("projected", lambda r, j: dirs[j])):
            m = linear.fit_logistic(g, width, 0, 5, 1, classes, without=without)
            o = linear.out_of_fold(g.select("id", "y", "x", "c", "fold"), m, width, 0, "id string, y int", some=True)
            o = o.select("y", F.posexplode("p").alias("i", "s")).withColumn("cls", F.array(*map(F.lit, classes))[F.col("i")])
            a = ranks.rank_auc(o, ["cls"], "s", (F.col("y") == F.col("cls")).cast("int"))
            a = a.agg(F.count("auc").alias("classes"), F.avg("auc").alias("auc")).select(F.lit(what).alias("target"), F.lit(name).alias("features"), "classes", "auc")
            out = a if out is None else out.unionByName(a)
    return out


@query("study_mlp_head")
def study_mlp_head(spark: SparkSession, d: str) -> DataFrame:
    """A perceptron (32 hidden units) and a discriminant against the linear head, on the same folds."""
    p, out = _outcome(spark, d), None
    for name, head in (("perceptron", heads.perceptron()), ("discriminant", heads.discriminant), ("linear", None)):
        o = linear.probe(p, "subject_id", "emb", "y", "grp", head=head).select(F.lit(name).alias("head"), "y", "score")
        out = o if out is None else out.unionByName(o)
    return ranks.rank_auc(cut(out), ["head"], "score", F.col("y")).select("head", "auc")


@query("study_marker_prediction")
def study_marker_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Does the embedding tell who is above the median of a marker, and who has amyloid?"""
    c = co.contract(spark, d)
    out = None
    for m in ("p_tau217", "gfap", "nfl", "amyloid"):
        v = c.where(F.col(m).isNotNull())
        v = v.withColumn("y", F.col("amyloid").cast("int")) if m == "amyloid" else beside(v, v.agg(F.percentile(m, 0.5).alias("_m"))).withColumn("y", (F.col(m) > F.col("_m")).cast("int"))
        a = ranks.rank_auc(linear.probe(v, "subject_id", "emb", "y", "site", k=3), [], "score", F.col("y")).select(F.lit(m).alias("marker"), (F.col("pos") + F.col("neg")).alias("n"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


_STRATA = {"all": "true", "amyloid": "amyloid = 1", "no amyloid": "amyloid = 0", "carrier": "apoe4 > 0", "older": "age > 72"}


@query("study_strata", f"WITH {_C}, v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS stratum, nfl AS s, (dx = 'AD')::INT AS y FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL AND {w}" for n, w in _STRATA.items()) + """), r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY s) + (count(*) OVER (PARTITION BY stratum, s) - 1) / 2 AS k FROM v)
SELECT stratum, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY stratum HAVING sum(y) >= 5 AND sum(1 - y) >= 5""")
def study_strata(spark: SparkSession, d: str) -> DataFrame:
    """A score's area in overlapping strata, in one job: each row is exploded into its strata."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and nfl is not null")
    s = F.filter(F.array(*(F.when(F.expr(w), F.lit(n)) for n, w in _STRATA.items())), F.isnotnull)
    return ranks.rank_auc(c.select("nfl", (F.col("dx") == "AD").cast("int").alias("y"), F.explode(s).alias("stratum")), ["stratum"], "nfl", F.col("y")).where("pos >= 5 and neg >= 5").withColumn("auc", R("auc"))


_MID = lambda s, by: f"rank() OVER (PARTITION BY share, rep{by} ORDER BY {s}) + (count(*) OVER (PARTITION BY share, rep{by}, {s}) - 1) / 2"


@query("study_power", f"""WITH {_C}, s AS (SELECT subject_id, nfl AS a, gfap AS b, (dx = 'AD')::INT AS y FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL AND gfap IS NOT NULL), r AS (SELECT a, b, y, rep, k / 8 AS share FROM s, (SELECT unnest(range(20)) AS rep), (SELECT unnest(range(1, 9)) AS k) WHERE {_U.format("subject_id || ':' || rep")} < k / 8),
m AS (SELECT *, ({_MID("a", "")}) - ({_MID("a", ", y")}) AS pa, ({_MID("b", "")}) - ({_MID("b", ", y")}) AS pb, sum(y) OVER (PARTITION BY share, rep) AS m, sum(1 - y) OVER (PARTITION BY share, rep) AS n FROM r),
v AS (SELECT *, CASE WHEN y = 1 THEN pa / n ELSE 1 - pa / m END AS va, CASE WHEN y = 1 THEN pb / n ELSE 1 - pb / m END AS vb FROM m),
z AS (SELECT share, rep, avg(va) FILTER (y = 1) AS aa, avg(vb) FILTER (y = 1) AS ab, var_samp(va - vb) FILTER (y = 1) / max(m) + var_samp(va - vb) FILTER (y = 0) / max(n) AS vr FROM v GROUP BY ALL)
SELECT share, count(*) FILTER (vr > 1e-18) AS replicates, round(avg(aa), 4) AS auc_a, round(avg(ab), 4) AS auc_b, round(avg(CASE WHEN vr > 1e-18 THEN ((aa - ab) / sqrt(vr) > 1.6448536269514722)::INT END), 4) AS power FROM z GROUP BY share""")
def study_power(spark: SparkSession, d: str) -> DataFrame:
    """How often the paired test tells two markers' areas apart in subsamples of growing share."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and nfl is not null and gfap is not null").select("subject_id", "nfl", "gfap", (F.col("dx") == "AD").cast("int").alias("y"))
    r = resample.replicate(c, 20).withColumn("share", F.explode(F.array(*(F.lit(k / 8) for k in range(1, 9)))))
    r = r.where(ranks.hash_unit(F.col("subject_id"), F.col("rep").cast("string")) < F.col("share"))
    z = resample.delong(cut(r), ["share", "rep"], F.col("y"), "nfl", "gfap")
    return z.groupBy("share").agg(F.count("z").alias("replicates"), R(F.avg("auc_a"), 4).alias("auc_a"), R(F.avg("auc_b"), 4).alias("auc_b"), R(F.avg((F.col("z") > 1.6448536269514722).cast("double")), 4).alias("power"))


@query("enrich_set_overlap", "WITH q AS (SELECT l_partkey AS item FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) >= 0.5) SELECT p_brand AS set_id, count(*) AS overlap FROM part WHERE p_partkey IN (SELECT item FROM q) GROUP BY 1")
def enrich_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r")).where("r >= 0.5")
    return table(spark, d, "part").join(q, "p_partkey", "left_semi").groupBy(F.col("p_brand").alias("set_id")).agg(F.count("*").alias("overlap"))


@query("rank_temporal_validation", f"""WITH v AS (SELECT SITEID, EXAMDATE, DIAGNOSIS = 3 AS h FROM dxsum WHERE SITEID IS NOT NULL AND EXAMDATE IS NOT NULL AND DIAGNOSIS IN (1, 2, 3)),
s AS (SELECT SITEID, avg(h::INT) FILTER (EXAMDATE < TIMESTAMP '2015-01-01') AS score, avg(h::INT) FILTER (EXAMDATE >= TIMESTAMP '2015-01-01') AS later FROM v GROUP BY SITEID), m AS (SELECT quantile_cont(later, 0.5) q FROM s), t AS (SELECT score, (later > q)::INT y FROM s, m WHERE score IS NOT NULL AND later IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM t) SELECT count(*) AS n, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def rank_temporal_validation(spark: SparkSession, d: str) -> DataFrame:
    """Does a ranking made of what was known before a date foresee what came after it?"""
    v = table(spark, d, "dxsum").where("SITEID is not null and EXAMDATE is not null and DIAGNOSIS in (1, 2, 3)")
    old = F.col("EXAMDATE") < F.lit("2015-01-01").cast("timestamp_ntz")
    h = (F.col("DIAGNOSIS") == 3).cast("double")
    s = cut(v.groupBy("SITEID").agg(F.avg(F.when(old, h)).alias("score"), F.avg(F.when(~old, h)).alias("later")))
    t = beside(s, s.agg(F.percentile("later", 0.5).alias("q"))).where("score is not null and later is not null")
    a = ranks.rank_auc(t, [], "score", (F.col("later") > F.col("q")).cast("int"))
    return a.select((F.col("pos") + F.col("neg")).cast("bigint").alias("n"), R("auc").alias("auc"))


@query("rank_decoys", f"""WITH {_C}, s AS (SELECT subject_id, nfl, (dx = 'AD')::INT y, ({_U.format("subject_id || ':d'")} < 0.3)::INT decoy FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL), v AS (SELECT 'truth' AS gold, nfl, y FROM s UNION ALL SELECT 'decoy', nfl, decoy FROM s), r AS (SELECT *, rank() OVER (PARTITION BY gold ORDER BY nfl) + (count(*) OVER (PARTITION BY gold, nfl) - 1) / 2 AS k FROM v)
SELECT gold, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY gold""")
def rank_decoys(spark: SparkSession, d: str) -> DataFrame:
    """Negative control: a score's area for the true set and for one drawn at random."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and nfl is not null")
    gold = F.explode(F.create_map(F.lit("truth"), F.col("dx") == "AD", F.lit("decoy"), ranks.hash_unit(F.col("subject_id"), F.lit("d")) < 0.3)).alias("gold", "y")
    return ranks.rank_auc(c.select("nfl", gold), ["gold"], "nfl", F.col("y").cast("int")).select("gold", R("auc").alias("auc"))


@query("study_before_after", f"""WITH {_C}, v AS (SELECT coalesce(site, '__na__') AS site, nfl, nfl - avg(nfl) OVER (PARTITION BY coalesce(site, '__na__')) + avg(nfl) OVER () AS h FROM c WHERE nfl IS NOT NULL), g AS (SELECT site, count(*) n, avg(nfl) a, avg(h) b FROM v GROUP BY site)
SELECT round(max(a) - min(a), 6) AS range_before, round(max(b) - min(b), 6) AS range_after, round((max(b) - min(b)) - (max(a) - min(a)), 6) AS delta FROM g""")
def study_before_after(spark: SparkSession, d: str) -> DataFrame:
    """How far site means lie apart before and after centring by site."""
    v = co.contract(spark, d).where("nfl is not null").select(F.coalesce("site", F.lit("__na__")).alias("site"), "nfl")
    m = v.groupBy("site").agg(F.avg("nfl").alias("m"))
    h = beside(v.join(m, "site"), v.agg(F.avg("nfl").alias("all"))).withColumn("h", F.col("nfl") - F.col("m") + F.col("all"))
    g = h.groupBy("site").agg(F.avg("nfl").alias("a"), F.avg("h").alias("b"))
    before, after = F.max("a") - F.min("a"), F.max("b") - F.min("b")
    return g.agg(R(before).alias("range_before"), R(after).alias("range_after"), R(after - before).alias("delta"))


@query("study_slices", f"WITH {_C}, v AS (SELECT CASE WHEN p_tau217 IS NOT NULL AND amyloid IS NOT NULL THEN 'both' WHEN p_tau217 IS NOT NULL THEN 'plasma' WHEN amyloid IS NOT NULL THEN 'amyloid' ELSE 'imaging only' END AS slice, dx, conversion FROM c) SELECT slice, count(*) AS n, count(conversion) AS followed, round(avg(conversion), 6) AS converted, count(DISTINCT dx) AS states FROM v GROUP BY slice")
def study_slices(spark: SparkSession, d: str) -> DataFrame:
    """Subjects by which data they have."""
    s = F.when(F.col("p_tau217").isNotNull() & F.col("amyloid").isNotNull(), "both").when(F.col("p_tau217").isNotNull(), "plasma").when(F.col("amyloid").isNotNull(), "amyloid").otherwise("imaging only")
    return co.contract(spark, d).groupBy(s.alias("slice")).agg(F.count("*").alias("n"), F.count("conversion").alias("followed"), R(F.avg("conversion")).alias("converted"), F.count_distinct("dx").alias("states"))


@query("study_shared_columns", """WITH a AS (SELECT "M/F" AS sex, CAST(Age AS DOUBLE) AS age, CAST(eTIV AS DOUBLE) AS etiv, CASE WHEN NOT isnan(nWBV) THEN nWBV END AS nwbv FROM oasis_cross_sectional UNION ALL SELECT "M/F", Age, eTIV, CASE WHEN NOT isnan(nWBV) THEN nWBV END FROM oasis_longitudinal)
SELECT sex, count(*) AS n, round(avg(age), 6) AS age, round(avg(etiv), 6) AS etiv, round(avg(nwbv), 6) AS nwbv FROM a GROUP BY sex""")
def study_shared_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two cohorts joined on the columns they share, found at plan time."""
    a, b = table(spark, d, "oasis_cross_sectional"), table(spark, d, "oasis_longitudinal")
    u = a.select(*(f"`{c}`" for c in a.columns if c in b.columns)).unionByName(b.select(*(f"`{c}`" for c in a.columns if c in b.columns)))
    return u.groupBy(F.col("M/F").alias("sex")).agg(F.count("*").alias("n"), R(F.avg("Age")).alias("age"), R(F.avg("eTIV")).alias("etiv"), R(F.avg(F.when(~F.isnan("nWBV"), F.col("nWBV")))).alias("nwbv"))


@query("graph_components", """WITH RECURSIVE e AS (SELECT DISTINCT subject_a AS a, subject_b AS b FROM subject_xref WHERE subject_a IS NOT NULL AND subject_b IS NOT NULL), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a)
SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    from siftline.operators.components import components

    return components(table(spark, d, "subject_xref"), "subject_a", "subject_b")
