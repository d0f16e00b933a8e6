"""Queries over statistics, ranks, resampling, graphs and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import graphs, ranks, resample, statistics
from siftline.session import beside, cut, number, table
from siftline.sources import cohort as co

R = lambda c, n=6: F.round(c, n)
QUERIES, SQL = {}, {}
_C = """c AS (SELECT DISTINCT subject_id, dx, conversion, CASE WHEN NOT isnan(age) THEN age END AS age, sex, site, scanner, amyloid, CASE WHEN NOT isnan(p_tau217) THEN p_tau217 END AS p_tau217,
 CASE WHEN NOT isnan(gfap) THEN gfap END AS gfap, CASE WHEN NOT isnan(nfl) THEN nfl END AS nfl, apoe4, emb FROM adni_contract)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, n) for c in cols})


@query("stat_cohort_summary", f"""WITH {_C} SELECT coalesce(dx, '(none)') AS dx, count(*) AS n, count(DISTINCT site) AS sites, count(DISTINCT scanner) AS scanners, round(avg(age), 1) AS mean_age, round(100 * avg(CASE WHEN sex = 'F' THEN 1.0 ELSE 0 END), 1) AS female_percent, round(avg(CASE WHEN p_tau217 IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage FROM c GROUP BY 1""")
def stat_cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d)
    return c.groupBy(F.coalesce("dx", F.lit("(none)")).alias("dx")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"), F.count_distinct("scanner").alias("scanners"), R(F.avg("age"), 1).alias("mean_age"), R(100 * F.avg(F.coalesce((F.col("sex") == "F").cast("double"), F.lit(0.0))), 1).alias("female_percent"), R(F.avg(F.col("p_tau217").isNotNull().cast("double"))).alias("coverage"))


@query("stat_eta_squared", f"""WITH {_C}, v AS (SELECT 'gfap' AS marker, site, gfap AS x FROM c UNION ALL SELECT 'nfl', site, nfl FROM c), g AS (SELECT marker, site, count(*) n, sum(x) s, sum(x * x) ss FROM v WHERE site IS NOT NULL AND x IS NOT NULL GROUP BY ALL)
SELECT marker, CAST(sum(n) AS BIGINT) AS n, count(*) AS "groups", round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g GROUP BY marker""")
def stat_eta_squared(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).select("site", F.explode(F.create_map(F.lit("gfap"), "gfap", F.lit("nfl"), "nfl")).alias("marker", "x"))
    return _round(statistics.eta_squared(c, "site", "x", ["marker"]), "eta2")


@query("stat_pearson", f"""WITH {_C}, p AS (SELECT dx, count(*) n, corr(p_tau217, gfap) r FROM c WHERE p_tau217 IS NOT NULL AND gfap IS NOT NULL AND dx IS NOT NULL GROUP BY dx)
SELECT dx, n, CASE WHEN n >= 3 THEN round(r * r, 6) END AS r2, CASE WHEN n >= 20 THEN round(r, 6) END AS r, CASE WHEN n >= 20 THEN round(tanh(atanh(r) - {statistics.Z95} / sqrt(n - 3)), 6) END AS lo, CASE WHEN n >= 20 THEN round(tanh(atanh(r) + {statistics.Z95} / sqrt(n - 3)), 6) END AS hi FROM p""")
def stat_pearson(spark: SparkSession, d: str) -> DataFrame:
    return _round(statistics.pearson(co.contract(spark, d).where("dx is not null"), "p_tau217", "gfap", ["dx"]), "r2", "r", "lo", "hi")


@query("stat_cohens_d", f"""WITH {_C}, v AS (SELECT sex, dx = 'AD' AS f, nfl AS x FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL AND sex IS NOT NULL), a AS (SELECT sex, count(*) FILTER (f) n1, count(*) FILTER (NOT f) n0, avg(x) FILTER (f) m1, avg(x) FILTER (NOT f) m0, var_samp(x) FILTER (f) v1, var_samp(x) FILTER (NOT f) v0, stddev_samp(x) sd FROM v GROUP BY sex),
b AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS e FROM a), s AS (SELECT *, sqrt((n1 + n0) / (n1 * n0) + e * e / (2 * (n1 + n0))) AS se FROM b)
SELECT sex, n1, n0, round(m1 - m0, 6) AS difference, round(e, 6) AS d, round(e - {statistics.Z95} * se, 6) AS lo, round(e + {statistics.Z95} * se, 6) AS hi, round((m1 - m0) / sd, 6) AS smd FROM s""")
def stat_cohens_d(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and sex is not null")
    return _round(statistics.cohens_d(c, F.col("dx") == "AD", "nfl", ["sex"]), "difference", "d", "lo", "hi", "smd")


@query("stat_cramers_v", f"""WITH {_C}, t AS (SELECT dx, site, count(*) o FROM c WHERE dx IS NOT NULL AND site IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY dx) a, sum(o) OVER (PARTITION BY site) b, sum(o) OVER () n FROM t)
SELECT CAST(max(n) AS BIGINT) AS n, round(sqrt((sum(o * o / (a * b)) - 1) / (least(count(DISTINCT dx), count(DISTINCT site)) - 1)), 6) AS v FROM m""")
def stat_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    return _round(statistics.cramers_v(co.contract(spark, d), "dx", "site"), "v")


_Z2 = statistics.Z95**2


@query("stat_wilson", f"""WITH {_C}, g AS (SELECT site, count(*) n, sum(amyloid) k FROM c WHERE site IS NOT NULL AND amyloid IS NOT NULL GROUP BY site), p AS (SELECT *, k / n AS s FROM g)
SELECT site, n, CAST(k AS BIGINT) AS k, round(greatest((s + {_Z2} / (2 * n)) / (1 + {_Z2} / n) - {statistics.Z95} * sqrt(s * (1 - s) / n + {_Z2} / (4 * n * n)) / (1 + {_Z2} / n), 0), 6) AS lo, round(least((s + {_Z2} / (2 * n)) / (1 + {_Z2} / n) + {statistics.Z95} * sqrt(s * (1 - s) / n + {_Z2} / (4 * n * n)) / (1 + {_Z2} / n), 1), 6) AS hi FROM p""")
def stat_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = co.contract(spark, d).where("site is not null and amyloid is not null").groupBy("site").agg(F.count("*").alias("n"), F.sum("amyloid").alias("k"))
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    return g.withColumns({"lo": R(lo), "hi": R(hi)})


@query("stat_crosstab", f"WITH {_C} SELECT coalesce(dx, '(none)') AS dx, count(*) FILTER (sex = 'F') AS F, count(*) FILTER (sex = 'M') AS M FROM c GROUP BY 1")
def stat_crosstab(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).groupBy(F.coalesce("dx", F.lit("(none)")).alias("dx")).pivot("sex", ["F", "M"]).agg(F.count(F.lit(1)))
    return c.select("dx", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("M", F.lit(0)).alias("M"))


@query("stat_value_counts", f"WITH {_C} SELECT site, count(*) AS n FROM c GROUP BY site")
def stat_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return co.contract(spark, d).groupBy("site").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "site")


@query("stat_mode", f"WITH {_C}, k AS (SELECT site, dx, count(*) n FROM c WHERE site IS NOT NULL AND dx IS NOT NULL GROUP BY ALL) SELECT site, arg_min(dx, struct_pack(n := -n, dx := dx)) AS top FROM k GROUP BY site")
def stat_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the smallest."""
    k = co.contract(spark, d).where("site is not null and dx is not null").groupBy("site", "dx").agg(F.count("*").alias("n"))
    return k.groupBy("site").agg(F.min_by("dx", F.struct(-F.col("n"), F.col("dx"))).alias("top"))


@query("stat_calibration", f"""WITH {_C}, v AS (SELECT site, 1 / (1 + exp(-(nfl - 25) / 8)) AS p, (dx = 'AD')::INT AS y FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL AND site IS NOT NULL), b AS (SELECT site, least(floor(p * 10), 9) AS bin, count(*) c, abs(avg(p) - avg(y)) gap, sum((p - y) * (p - y)) se FROM v GROUP BY ALL)
SELECT site, CAST(sum(c) AS BIGINT) AS n, round(sum(se) / sum(c), 6) AS brier, round(sum(c * gap) / sum(c), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY site""")
def stat_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and site is not null").withColumn("p", 1 / (1 + F.exp(-(F.col("nfl") - 25) / 8)))
    return _round(statistics.calibration(c, "p", (F.col("dx") == "AD").cast("int"), keys=["site"]), "brier", "ece", "mce")


@query("stat_max_by", f"WITH {_C} SELECT site, max(gfap) AS best, arg_max(subject_id, struct_pack(g := gfap, s := subject_id)) AS subject_id, count(gfap) AS n FROM c WHERE site IS NOT NULL AND gfap IS NOT NULL GROUP BY site")
def stat_max_by(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).where("site is not null and gfap is not null")
    return c.groupBy("site").agg(F.max("gfap").alias("best"), F.max_by("subject_id", F.struct("gfap", "subject_id")).alias("subject_id"), F.count("gfap").alias("n"))


@query("stat_signed_extreme", f"WITH {_C}, e AS (SELECT subject_id, unnest(emb) x FROM c) SELECT subject_id, arg_max(x, struct_pack(a := abs(x), x := x)) AS extreme FROM e GROUP BY subject_id")
def stat_signed_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Of each subject the signed value of largest size; a maximum over the array, without a shuffle."""
    return co.contract(spark, d).select("subject_id", F.array_max(F.transform("emb", lambda x: F.struct(F.abs(x).alias("a"), x.alias("x"))))["x"].alias("extreme"))


@query("stat_adjusted_rand", f"""WITH {_C}, t AS (SELECT dx, scanner, count(*) c FROM c WHERE dx IS NOT NULL AND scanner IS NOT NULL GROUP BY ALL), s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM t) ij, (SELECT sum(c) FROM t) n, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) c FROM t GROUP BY dx)) i, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) c FROM t GROUP BY scanner)) j)
SELECT CAST(n AS BIGINT) AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def stat_adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return _round(statistics.adjusted_rand(co.contract(spark, d), "dx", "scanner"), "ari")


@query("rank_average", f"WITH {_C}, v AS (SELECT dx, age FROM c WHERE dx IS NOT NULL AND age IS NOT NULL), r AS (SELECT dx, age, rank() OVER (PARTITION BY dx ORDER BY age) r, count(*) OVER (PARTITION BY dx, age) n, count(*) OVER (PARTITION BY dx) total FROM v) SELECT DISTINCT dx, age, n, r + (n - 1) / 2 AS rank, total FROM r")
def rank_average(spark: SparkSession, d: str) -> DataFrame:
    return ranks.average_ranks(co.contract(spark, d).where("dx is not null"), ["dx"], "age")


@query("rank_auc_by_supplier", """WITH v AS (SELECT l_suppkey, l_extendedprice AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY s) + (count(*) OVER (PARTITION BY l_suppkey, s) - 1) / 2 AS k FROM v)
SELECT l_suppkey, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg, round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END, 6) AS auc FROM r GROUP BY l_suppkey""")
def rank_auc_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Does a score separate two classes, within batches?"""
    return _round(ranks.rank_auc(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", (F.col("l_returnflag") == "R").cast("int")), "auc")


@query("rank_auc_macro", f"""WITH {_C}, k AS (SELECT DISTINCT dx AS cls FROM c WHERE dx IS NOT NULL), v AS (SELECT cls, nfl AS s, (dx = cls)::INT y FROM c, k WHERE dx IS NOT NULL AND nfl IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2 AS k FROM v),
a AS (SELECT cls, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY cls) SELECT count(*) AS classes, round(avg(auc), 6) AS macro_auc FROM a""")
def rank_auc_macro(spark: SparkSession, d: str) -> DataFrame:
    """One class against the rest, averaged; null if any class has no area."""
    c = co.contract(spark, d).where("dx is not null and nfl is not null").select("nfl", "dx", F.explode(F.array(*map(F.lit, co.DOMAINS["dx"]))).alias("cls"))
    a = ranks.rank_auc(c, ["cls"], "nfl", (F.col("dx") == F.col("cls")).cast("int"))
    return a.agg(F.count("*").alias("classes"), R(F.when(F.count("auc") == F.count("*"), F.avg("auc"))).alias("macro_auc"))


_P = "2 * exp(-abs(r) * sqrt(n))"


@query("rank_benjamini_hochberg", f"""WITH {_C}, e AS (SELECT site, generate_subscripts(emb, 1) - 1 AS dim, unnest(emb) AS x, nfl FROM c WHERE site IS NOT NULL), t AS (SELECT site, dim, count(*) n, corr(x, nfl) r FROM e WHERE nfl IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT site, CAST(dim AS INT) AS dim, round(least(1, {_P}), 9) AS p FROM t WHERE NOT isnan(r) AND r IS NOT NULL),
i AS (SELECT *, count(*) OVER (PARTITION BY dim) m, rank() OVER (PARTITION BY dim ORDER BY p) + count(*) OVER (PARTITION BY dim, p) - 1 AS i FROM p)
SELECT site, dim, p, round(min(least(1, p * m / i)) OVER (PARTITION BY dim ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM i""")
def rank_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).where("site is not null and nfl is not null").select("site", "nfl", F.posexplode("emb").alias("dim", "x"))
    t = c.groupBy("site", "dim").agg(F.count("*").alias("n"), statistics.correlation("x", "nfl").alias("r")).where("n >= 3 and r is not null")
    t = t.select("site", "dim", R(F.least(F.lit(1.0), 2 * F.exp(-F.abs("r") * F.sqrt("n"))), 9).alias("p"))
    return _round(ranks.benjamini_hochberg(t, ["dim"], "p"), "q")


@query("rank_min_max", f"WITH {_C} SELECT subject_id, site, CASE WHEN gfap IS NOT NULL THEN CASE WHEN max(gfap) OVER w = min(gfap) OVER w THEN 1 ELSE round((gfap - min(gfap) OVER w) / (max(gfap) OVER w - min(gfap) OVER w), 6) END END AS scaled FROM c WHERE site IS NOT NULL WINDOW w AS (PARTITION BY site)")
def rank_min_max(spark: SparkSession, d: str) -> DataFrame:
    return ranks.min_max(co.contract(spark, d).where("site is not null"), ["site"], "gfap", "scaled").select("subject_id", "site", R("scaled").alias("scaled"))


@query("rank_normalised", f"WITH {_C}, v AS (SELECT *, rank() OVER (PARTITION BY dx ORDER BY gfap) + (count(*) OVER (PARTITION BY dx, gfap) - 1) / 2 AS r, count(gfap) OVER (PARTITION BY dx) AS n FROM c WHERE dx IS NOT NULL) SELECT subject_id, CASE WHEN gfap IS NOT NULL THEN CASE WHEN n = 1 THEN 0.5 ELSE round((r - 1) / (n - 1), 6) END END AS u FROM v")
def rank_normalised(spark: SparkSession, d: str) -> DataFrame:
    return ranks.rank_normalise(co.contract(spark, d).where("dx is not null"), ["dx"], "gfap", "u").select("subject_id", R("u").alias("u"))


@query("rank_strata", f"""WITH {_C}, e AS (SELECT list_distinct(quantile_cont(age, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM c) SELECT len(list_filter(q, lambda x: x < age)) AS stratum, count(*) AS n FROM c, e WHERE age IS NOT NULL GROUP BY 1""")
def rank_strata(spark: SparkSession, d: str) -> DataFrame:
    return resample.quantile_strata(co.contract(spark, d), "age").where("stratum is not null").groupBy(F.col("stratum").cast("bigint").alias("stratum")).agg(F.count("*").alias("n"))


@query("rank_precision_at_k", """WITH s AS (SELECT p_partkey, p_brand, coalesce(sum(l_extendedprice * (1 - l_discount)), 0) AS v FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_partkey) k FROM s)
SELECT 100 AS k, count(*) FILTER (k <= 100 AND p_brand = 'Brand#11') AS hits, round(count(*) FILTER (k <= 100 AND p_brand = 'Brand#11') / least(100, count(*)), 6) AS precision, round(count(*) FILTER (k <= 100 AND p_brand = 'Brand#11') / nullif(count(*) FILTER (p_brand = 'Brand#11'), 0), 6) AS recall FROM r""")
def rank_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    p, v = table(spark, d, "part"), table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    s = cut(p.join(v, p["p_partkey"] == v["l_partkey"], "left").select("p_partkey", F.coalesce("v", F.lit(0.0)).alias("v")))
    return _round(graphs.at_k(s, "v", "p_partkey", p.where("p_brand = 'Brand#11'").select("p_partkey"), 100), "precision", "recall")


_U = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0"
_REPS = resample.DRAWS
_P31 = resample.PRIME
_POIS = "(" + " + ".join(f"(u >= {e})::INT" for e in resample._edges().tolist()) + ")"
_CODE = lambda text, at=1: f"CAST(('0x' || substr(md5({text}), {at}, 8)) AS BIGINT)"


def _affine(tag: str, groups: str, size: str) -> str:
    """SQL of g(rep, grp, n, a, b): the affine map of each replicate and group; groups has grp and the rows ``size``."""
    return f"""ab AS (SELECT rep, {_CODE(f"'{tag}a:' || rep")} % {_P31 - 1} + 1 AS a1, {_CODE(f"'{tag}a:' || rep", 9)} % {_P31} AS b1, {_CODE(f"'{tag}b:' || rep")} % {_P31 - 1} + 1 AS a2, {_CODE(f"'{tag}b:' || rep", 9)} % {_P31} AS b2 FROM reps),
 gx AS (SELECT rep, grp, {size} AS n, ((a1 * x + b1) % {_P31}) % {size} + 1 AS cand, ((a2 * x + b2) % {_P31}) % {size} AS b FROM (SELECT *, {_CODE("grp::VARCHAR")} % {_P31} AS x FROM {groups}), ab),
 gm AS (SELECT rep, grp, n, cand + list_filter(range(64), lambda j: gcd(cand + j, n) = 1)[1] AS a, b FROM gx)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return co.contract(spark, d).where("dx in ('AD', 'CN') and nfl is not null").select("subject_id", "nfl", "site", F.when(F.col("dx") == "AD", 1).otherwise(0).alias("y"))


_SC = f"{_C}, s AS (SELECT subject_id, nfl, site, (dx = 'AD')::INT AS y FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL), reps AS (SELECT unnest(range({_REPS})) AS rep)"


_AUC = "w AS (SELECT rep, nfl, sum(p) p, sum(q) q FROM l GROUP BY rep, nfl), x AS (SELECT rep, p, q, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY nfl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w), a AS (SELECT rep, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM x GROUP BY rep)"


@query("resample_bootstrap", f"""WITH {_SC}, ab AS (SELECT rep, {_CODE("'b:' || rep")} % {_P31 - 1} + 1 AS a, {_CODE("'b:' || rep", 9)} % {_P31} AS b FROM reps), b AS (SELECT rep, nfl, y, (a * ({_CODE("subject_id")} % {_P31}) + b) % {_P31} AS u FROM s, ab), l AS (SELECT rep, nfl, y * {_POIS} AS p, (1 - y) * {_POIS} AS q FROM b), {_AUC}
SELECT count(*) AS reps, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a""")
def resample_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.interval(resample.bootstrap_auc(_scored(spark, d), "subject_id", "nfl", F.col("y")), "auc"), "lo", "hi")


@query("resample_permutation", f"""WITH {_SC}, v AS (SELECT nfl, y, coalesce(site, '__na__') AS grp, row_number() OVER (PARTITION BY coalesce(site, '__na__') ORDER BY {_U.format("subject_id || ':p'")}, subject_id) - 1 AS i FROM s), gs AS (SELECT grp, sum(y) AS k, count(*) AS size FROM v GROUP BY 1), {_affine("p", "gs", "size")},
l AS (SELECT rep, nfl, ((a * i + b) % n < k)::INT AS p, 1 - ((a * i + b) % n < k)::INT AS q FROM v JOIN gs USING (grp) JOIN gm USING (grp) UNION ALL SELECT -1, nfl, y, 1 - y FROM v), {_AUC}
SELECT round(max(auc) FILTER (rep = -1), 6) AS auc, round((1 + count(*) FILTER (rep >= 0 AND auc >= (SELECT auc FROM a WHERE rep = -1) - 1e-12)) / {_REPS + 1}, 6) AS p FROM a""")
def resample_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Labels shuffled within sites, scores frozen."""
    s = _scored(spark, d)
    seen = ranks.rank_auc(s, [], "nfl", F.col("y")).select("auc")
    return _round(resample.p_value(resample.permuted_auc(s, "subject_id", "nfl", F.col("y"), "site"), seen, "auc", _REPS), "auc", "p")


@query("resample_matched_null", f"""WITH {_C}, reps AS (SELECT unnest(range({_REPS})) AS rep), d AS (SELECT subject_id, (dx IS NOT NULL AND dx = 'AD')::INT AS y, CAST(round(age / 10) AS INT) AS grp, nfl FROM c WHERE age IS NOT NULL AND nfl IS NOT NULL), v AS (SELECT nfl, y, grp, row_number() OVER (PARTITION BY grp ORDER BY {_U.format("subject_id || ':m'")}, subject_id) - 1 AS i FROM d WHERE subject_id IS NOT NULL),
gs AS (SELECT grp, sum(y) AS k, count(*) AS size FROM v GROUP BY 1), {_affine("m", "gs", "size")} SELECT CAST(rep AS INT) AS rep, round(avg(nfl), 6) AS mean FROM v JOIN gs USING (grp) JOIN gm USING (grp) WHERE (a * i + b) % n < k GROUP BY rep""")
def resample_matched_null(spark: SparkSession, d: str) -> DataFrame:
    """Means of random sets that match a set's strata."""
    c = co.contract(spark, d).where("age is not null and nfl is not null").withColumn("stratum", F.round(F.col("age") / 10).cast("int"))
    return _round(resample.matched_null(c, "subject_id", F.col("dx") == "AD", "stratum", "nfl"), "mean")


@query("resample_delong", f"""WITH {_C}, s AS (SELECT subject_id, (dx = 'AD')::INT y, nfl a, gfap b FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL AND gfap IS NOT NULL), n AS (SELECT sum(y) m, sum(1 - y) n FROM s),
v AS (SELECT x.y, avg(CASE WHEN (x.a > z.a) = (x.y = 1) AND x.a <> z.a THEN 1.0 WHEN x.a = z.a THEN 0.5 ELSE 0 END) va, avg(CASE WHEN (x.b > z.b) = (x.y = 1) AND x.b <> z.b THEN 1.0 WHEN x.b = z.b THEN 0.5 ELSE 0 END) vb FROM s x JOIN s z ON x.y <> z.y GROUP BY x.subject_id, x.y)
SELECT round(avg(va) FILTER (y = 1), 6) AS auc_a, round(avg(vb) FILTER (y = 1), 6) AS auc_b, round((avg(va) FILTER (y = 1) - avg(vb) FILTER (y = 1)) / sqrt(var_samp(va - vb) FILTER (y = 1) / max(m) + var_samp(va - vb) FILTER (y = 0) / max(n)), 6) AS z FROM v, n""")
def resample_delong(spark: SparkSession, d: str) -> DataFrame:
    c = co.contract(spark, d).where("dx in ('AD', 'CN')").withColumn("all", F.lit(0))
    return _round(resample.delong(c, ["all"], F.when(F.col("dx") == "AD", 1).otherwise(0), "nfl", "gfap"), "auc_a", "auc_b", "z").drop("all")


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"


@query("enrich_over_representation", f"""WITH q AS (SELECT l_partkey AS item FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) >= 0.5), s AS (SELECT p_brand AS set_id, p_partkey AS item FROM part),
u AS (SELECT count(*) AS universe FROM (SELECT item FROM s UNION SELECT item FROM q)), n AS (SELECT set_id, count(*) AS size, count(q.item) AS overlap FROM s LEFT JOIN q USING (item) GROUP BY set_id HAVING count(q.item) > 0), x AS (SELECT n.*, universe, (SELECT count(*) FROM q) AS drawn FROM n, u),
t AS (SELECT *, unnest(range(overlap, least(size, drawn) + 1)) AS i FROM x), p AS (SELECT set_id, size, overlap, universe, drawn, least(1, sum(exp({_LC.format('size', 'i')} + {_LC.format('(universe - size)', '(drawn - i)')} - {_LC.format('universe', 'drawn')}))) AS p FROM t WHERE drawn - i <= universe - size GROUP BY ALL),
k AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i FROM p)
SELECT set_id, size, overlap, universe, drawn, round(p, 6) AS p, round(greatest(p, min(least(1, p * m / i)) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS q,
 round(CASE WHEN (size - overlap) * (drawn - overlap) = 0 THEN 'inf'::DOUBLE ELSE overlap * (universe - size - drawn + overlap) / ((size - overlap) * (drawn - overlap)) END, 6) AS odds FROM k""")
def enrich_over_representation(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts against the parts of much returned lines."""
    li = table(spark, d, "lineitem")
    q = li.groupBy("l_partkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r")).where("r >= 0.5").select(F.col("l_partkey").alias("item"))
    sets = table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("item"))
    return _round(graphs.over_representation(sets, q), "p", "q", "odds")


@query("rank_composite", f"""WITH {_C}, s AS (SELECT subject_id, p_tau217 / 0.5 AS a, gfap / 300 AS b, nfl / 40 AS e, apoe4 / 2.0 AS f FROM c)
SELECT subject_id, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT AS signals, round((coalesce(0.3 * a, 0) + coalesce(0.35 * b, 0) + coalesce(0.2 * e, 0) + coalesce(0.15 * f, 0)) / nullif((a IS NOT NULL)::INT * 0.3 + (b IS NOT NULL)::INT * 0.35 + (e IS NOT NULL)::INT * 0.2 + (f IS NOT NULL)::INT * 0.15, 0), 9) AS score FROM s""")
def rank_composite(spark: SparkSession, d: str) -> DataFrame:
    """Weights are shared out over the signals that are present."""
    c = co.contract(spark, d).select("subject_id", (F.col("p_tau217") / 0.5).alias("a"), (F.col("gfap") / 300).alias("b"), (F.col("nfl") / 40).alias("e"), (F.col("apoe4") / 2.0).alias("f"))
    return graphs.composite(c, {"a": 0.3, "b": 0.35, "e": 0.2, "f": 0.15}).select("subject_id", "signals", R("score", 9).alias("score"))


@query("rank_partition_score", f"WITH {_C} SELECT subject_id, round(CASE WHEN gfap IS NULL AND nfl IS NULL THEN 0 ELSE (coalesce(gfap, 0) + coalesce(nfl, 0)) / ((gfap IS NOT NULL)::INT + (nfl IS NOT NULL)::INT) END, 6) AS score FROM c")
def rank_partition_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the evidence whose kind isn't held out; none left counts 0, unlike a missing signal."""
    ev = F.map_filter(F.create_map(F.lit("gfap"), "gfap", F.lit("nfl"), "nfl", F.lit("tau"), "p_tau217"), lambda _, v: v.isNotNull())
    return co.contract(spark, d).select("subject_id", R(graphs.partition_score(ev, ["tau"])).alias("score"))


def _trade(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    s = table(spark, d, "supplier")
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return x.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b")).agg(F.count("*").alias("w"))


_TRADE = "t AS (SELECT 's' || l_suppkey AS a, 'n' || c_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def _spread(least: int, steps: int, step: str) -> str:
    """CTEs p0 to p<steps>: the seeds' shares pushed along the normalised edges, one CTE a step; step is what one push adds up."""
    out = f"""{_TRADE}, e AS (SELECT a AS src, b AS dst, w FROM t WHERE w >= {least} UNION ALL SELECT b, a, w FROM t WHERE w >= {least}), g AS (SELECT src, sum(w) s, count(*) n FROM e GROUP BY src),
 nw AS MATERIALIZED (SELECT e.src, e.dst, w / sqrt(g.s * h.s) AS w FROM e JOIN g ON e.src = g.src JOIN g h ON e.dst = h.src), p0 AS (SELECT src AS node, 1.0::DOUBLE / count(*) OVER () AS p FROM g WHERE src IN ('n1', 'n7'))"""
    for k in range(steps):
        out += f", p{k + 1} AS MATERIALIZED (SELECT node, sum(p) AS p FROM ({step.format(prev=f'p{k}', k=k + 1)}) GROUP BY node)"
    return out


_WALK = _spread(0, 24, "SELECT dst AS node, w * p * 0.5 AS p FROM nw JOIN {prev} ON src = node UNION ALL SELECT node, p * 0.5 FROM p0")
_WALK2 = _spread(2, 24, "SELECT dst AS node, w * p * 0.5 AS p FROM nw JOIN {prev} ON src = node UNION ALL SELECT node, p * 0.5 FROM p0")
_HEAT = _spread(0, 14, "SELECT dst AS node, w * p * 0.5 / {k} AS p FROM nw JOIN {prev} ON src = node")


@query("graph_walk_with_restart", f"WITH {_WALK} SELECT g.src AS node, round(coalesce(p, 0), 9) AS score FROM g LEFT JOIN p24 ON node = g.src")
def graph_walk_with_restart(spark: SparkSession, d: str) -> DataFrame:
    e = cut(graphs.undirected(_trade(spark, d), "a", "b", "w"))
    seeds = e.where("src in ('n1', 'n7')").select("src").distinct()
    return _round(graphs.walk_with_restart(e, seeds), "score", n=9)


@query("graph_heat", f"WITH {_HEAT}, a AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(15))}) SELECT g.src AS node, round(coalesce(sum(p) * exp(-0.5), 0), 9) AS score FROM g LEFT JOIN a ON node = g.src GROUP BY g.src")
def graph_heat(spark: SparkSession, d: str) -> DataFrame:
    e = cut(graphs.undirected(_trade(spark, d), "a", "b", "w"))
    return _round(graphs.heat_diffusion(e, e.where("src in ('n1', 'n7')").select("src").distinct()), "score", n=9)


@query("graph_hubs", f"""WITH {_WALK2}, sc AS (SELECT g.src AS node, coalesce(p, 0) AS score, n AS degree FROM g LEFT JOIN p24 ON node = g.src), q AS (SELECT quantile_cont(n, 0.75) AS q FROM g),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS k FROM sc WHERE node NOT IN ('n1', 'n7')) SELECT node, round(score, 9) AS score, CAST(k AS INT) AS rank, degree, degree >= q AS hub FROM b, q WHERE k <= 25""")
def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    e = cut(graphs.undirected(_trade(spark, d), "a", "b", "w", 2))
    seeds = e.where("src in ('n1', 'n7')").select("src").distinct()
    return _round(graphs.hubs(e, cut(graphs.walk_with_restart(e, seeds)), seeds), "score", n=9)


@query("graph_degrees", f"WITH {_TRADE}, e AS (SELECT a AS src, b AS dst, w FROM t UNION ALL SELECT b, a, w FROM t), g AS (SELECT src, sum(w) s FROM e GROUP BY src) SELECT e.src, e.dst, round(w / sqrt(g.s * h.s), 9) AS w FROM e JOIN g ON e.src = g.src JOIN g h ON e.dst = h.src")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Edges weighed by the degrees of both ends."""
    return _round(graphs.normalised(graphs.undirected(_trade(spark, d), "a", "b", "w")), "w", n=9)


@query("graph_partners", f"WITH {_TRADE} SELECT a AS node, arg_max(b, struct_pack(w := w, b := b)) AS partner, CAST(max(w) AS DOUBLE) AS w FROM t GROUP BY a")
def graph_partners(spark: SparkSession, d: str) -> DataFrame:
    """Each node's strongest partner."""
    e = graphs.undirected(_trade(spark, d), "a", "b", "w").where("src like 's%'")
    return e.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", F.struct("w", "dst")).alias("partner"), F.max("w").alias("w"))


@query("rank_shortlist_stability", f"""WITH {_C}, s AS (SELECT subject_id, nfl FROM c WHERE nfl IS NOT NULL), m AS (SELECT site, avg(nfl) v FROM c WHERE site IS NOT NULL GROUP BY site), reps AS (SELECT unnest(range(20)) AS rep),
b AS (SELECT rep, site, avg(nfl) v FROM c, reps WHERE site IS NOT NULL AND nfl IS NOT NULL AND {_U.format("subject_id || ':' || rep")} < 0.8 GROUP BY ALL), r AS (SELECT rep, site, row_number() OVER (PARTITION BY rep ORDER BY v DESC, site) k FROM b) SELECT site, round(count(*) FILTER (k <= 10) / 20, 6) AS kept FROM r GROUP BY site""")
def rank_shortlist_stability(spark: SparkSession, d: str) -> DataFrame:
    """How often a site is among the first ten when a fifth of the subjects is left out."""
    c = co.contract(spark, d).where("site is not null and nfl is not null").select("subject_id", "site", "nfl")
    r = resample.replicate(c, 20).where(ranks.hash_unit(F.col("subject_id"), F.col("rep").cast("string")) < 0.8)
    m = ranks.top_k(r.groupBy("rep", "site").agg(F.avg("nfl").alias("v")), ["rep"], [F.col("v").desc(), F.col("site")], 10)
    return c.select("site").distinct().join(m, "site", "left").groupBy("site").agg(R(F.count("rep") / 20).alias("kept"))


@query("ledger_beliefs", """SELECT SITEID AS arm, round(2 + sum(CASE WHEN DIAGNOSIS = 3 THEN w ELSE 0 END), 6) AS alpha, round(2 + sum(CASE WHEN DIAGNOSIS IN (1, 2) THEN w ELSE 0 END), 6) AS beta, count(*) AS experiments FROM (SELECT *, least(2, greatest(0.5, abs(DIAGNOSIS - 1.5))) AS w FROM dxsum WHERE SITEID IS NOT NULL AND DIAGNOSIS IN (1, 2, 3)) GROUP BY SITEID""")
def ledger_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Beta beliefs as a fold over an append-only ledger: prior of strength 4, weights clipped to 0.5 to 2."""
    from siftline.operators.ledger import posterior

    led = table(spark, d, "dxsum").where("SITEID is not null and DIAGNOSIS in (1, 2, 3)").select(F.col("SITEID").alias("arm"), (F.col("DIAGNOSIS") == 3).alias("success"), (F.col("DIAGNOSIS") - 1.5).alias("effect"))
    return _round(posterior(led), "alpha", "beta")


@query("ledger_next", """WITH p AS (SELECT SITEID AS arm, 2 + sum(CASE WHEN DIAGNOSIS = 3 THEN w ELSE 0 END) AS a, 2 + sum(CASE WHEN DIAGNOSIS IN (1, 2) THEN w ELSE 0 END) AS b FROM (SELECT *, least(2, greatest(0.5, abs(DIAGNOSIS - 1.5))) AS w FROM dxsum WHERE SITEID IS NOT NULL AND DIAGNOSIS IN (1, 2, 3)) GROUP BY SITEID),
s AS (SELECT arm, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM p) SELECT 'greedy' AS rule, arg_max(arm, struct_pack(v := mean, k := -arm)) AS arm FROM s UNION ALL SELECT 'uncertainty', arg_max(arm, struct_pack(v := sd, k := -arm)) FROM s UNION ALL SELECT 'ucb', arg_max(arm, struct_pack(v := mean + sd, k := -arm)) FROM s""")
def ledger_next(spark: SparkSession, d: str) -> DataFrame:
    from siftline.operators.ledger import next_arm, posterior

    led = table(spark, d, "dxsum").where("SITEID is not null and DIAGNOSIS in (1, 2, 3)").select(F.col("SITEID").alias("arm"), (F.col("DIAGNOSIS") == 3).alias("success"), (F.col("DIAGNOSIS") - 1.5).alias("effect"))
    return next_arm(posterior(led))


@query("stat_dominant_marker", f"""WITH {_C}, s AS (SELECT site, (avg(gfap) FILTER (dx = 'AD') - avg(gfap) FILTER (dx = 'CN')) / nullif(stddev_samp(gfap), 0) AS gfap, (avg(nfl) FILTER (dx = 'AD') - avg(nfl) FILTER (dx = 'CN')) / nullif(stddev_samp(nfl), 0) AS nfl FROM c WHERE dx IN ('AD', 'CN') AND site IS NOT NULL GROUP BY site)
SELECT site, CASE WHEN gfap IS NULL OR nfl IS NULL THEN NULL WHEN round(abs(gfap), 9) >= round(abs(nfl), 9) THEN 'gfap' ELSE 'nfl' END AS marker FROM s""")
def stat_dominant_marker(spark: SparkSession, d: str) -> DataFrame:
    """The marker of largest standardised difference (to nine decimals), in one aggregation."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN') and site is not null")
    smd = lambda m: ((F.avg(F.when(F.col("dx") == "AD", F.col(m))) - F.avg(F.when(F.col("dx") == "CN", F.col(m)))) / F.nullif(F.stddev_samp(m), F.lit(0.0))).alias(m)
    return c.groupBy("site").agg(smd("gfap"), smd("nfl")).select("site", F.when(F.col("gfap").isNotNull() & F.col("nfl").isNotNull(), F.when(F.round(F.abs("gfap"), 9) >= F.round(F.abs("nfl"), 9), "gfap").otherwise("nfl")).alias("marker"))


@query("stat_gate_weights", f"""WITH {_C}, v AS (SELECT subject_id, (dx = 'AD')::INT y, unnest([p_tau217, gfap, nfl]) s, unnest(['p_tau217', 'gfap', 'nfl']) m FROM c WHERE dx IN ('AD', 'CN')), r AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY s) + (count(*) OVER (PARTITION BY m, s) - 1) / 2 AS k FROM v WHERE s IS NOT NULL),
a AS (SELECT m AS modality, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY m) SELECT modality, round(auc, 6) AS auc, round(exp(greatest(auc - 0.5, 0) / 0.1) / sum(exp(greatest(auc - 0.5, 0) / 0.1)) OVER (), 6) AS weight FROM a""")
def stat_gate_weights(spark: SparkSession, d: str) -> DataFrame:
    """Modalities weighed by the softmax of what their area exceeds chance by."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN')").select((F.col("dx") == "AD").cast("int").alias("y"), F.explode(F.create_map(*(x for m in ("p_tau217", "gfap", "nfl") for x in (F.lit(m), F.col(m))))).alias("modality", "s"))
    a = ranks.rank_auc(c, ["modality"], "s", F.col("y")).withColumn("e", F.exp(F.greatest(F.col("auc") - 0.5, F.lit(0.0)) / 0.1))
    return beside(a, a.agg(F.sum("e").alias("t"))).select("modality", R("auc").alias("auc"), R(F.col("e") / F.col("t")).alias("weight"))


@query("stat_surrogate_logistic", f"WITH {_C} SELECT subject_id, round(1 / (1 + exp(-(-2 + coalesce(0.03 * (age - 70), 0) + coalesce(4 * p_tau217, 0) + coalesce(0.004 * gfap, 0) + coalesce(0.5 * apoe4, 0)))), 6) AS p FROM c")
def stat_surrogate_logistic(spark: SparkSession, d: str) -> DataFrame:
    """A fixed logistic score in which missing features count nothing."""
    terms = {"age": (0.03, 70), "p_tau217": (4, 0), "gfap": (0.004, 0), "apoe4": (0.5, 0)}
    x = F.lit(-2.0)
    for c, (w, at) in terms.items():
        x = x + F.coalesce(w * (number(c) - at), F.lit(0.0))
    return co.contract(spark, d).select("subject_id", R(1 / (1 + F.exp(-x))).alias("p"))
