"""Queries that join several operators: chains of feeders, batteries over sets, enrichment of spread scores, group differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import notation
from siftline.operators import graphs, ranks, resample, statistics, tables
from siftline.plans.measures import _C, _CODE, _LC, _P31, _POIS, _REPS, _U, _WALK, _affine, _round, _trade
from siftline.session import beside, cut, number, scratch, table
from siftline.sources import cohort as co
from siftline.sources import files

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("join_feeder_chain", f"""WITH {_C}, p AS (SELECT CAST(RID AS VARCHAR) AS subject_id, min(DRAW_ID) AS draw FROM upenn_plasma WHERE RID IS NOT NULL GROUP BY 1), v AS (SELECT CAST(RID AS VARCHAR) AS subject_id, count(*) AS n FROM dxsum WHERE RID IS NOT NULL GROUP BY 1)
SELECT subject_id, site, draw AS plasma_draw, n AS visits_n, 'exports' AS failed FROM c LEFT JOIN p USING (subject_id) LEFT JOIN v USING (subject_id)""")
def join_feeder_chain(spark: SparkSession, d: str) -> DataFrame:
    """The contract with what three feeders know; one of them asks for a column that isn't there and is left out."""
    rid = F.col("RID").cast("string").alias("subject_id")
    feeders = {
        "plasma": lambda: table(spark, d, "upenn_plasma").groupBy(rid).agg(F.min("DRAW_ID").alias("draw")),
        "exports": lambda: table(spark, d, "dxsum_exports").select(F.col("RID").cast("string").alias("subject_id"), "record"),
        "visits": lambda: table(spark, d, "dxsum").groupBy(rid).agg(F.count("*").alias("n")),
    }
    out, failed = tables.left_chain(co.contract(spark, d).select("subject_id", "site"), "subject_id", feeders)
    return out.withColumn("failed", F.lit(",".join(sorted(failed))))


@query("join_detected_markers", """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID ORDER BY EXAMDATE, DRAW_ID) AS k FROM upenn_plasma WHERE RID IS NOT NULL AND EXAMDATE IS NOT NULL) WHERE k = 1)
SELECT RID, DRAW_ID, CASE WHEN pT217_F >= 0 AND NOT isnan(pT217_F) THEN pT217_F END AS p_tau217, coalesce(CASE WHEN GFAP_F >= 0 AND NOT isnan(GFAP_F) THEN GFAP_F END, CASE WHEN GFAP_Q >= 0 AND NOT isnan(GFAP_Q) THEN GFAP_Q END) AS gfap, coalesce(CASE WHEN NfL_F >= 0 AND NOT isnan(NfL_F) THEN NfL_F END, CASE WHEN NfL_Q >= 0 AND NOT isnan(NfL_Q) THEN NfL_Q END) AS nfl FROM p""")
def join_detected_markers(spark: SparkSession, d: str) -> DataFrame:
    """Marker columns found by patterns over the names, several of one marker coalesced, at each subject's first draw."""
    t = table(spark, d, "upenn_plasma").where("RID is not null and EXAMDATE is not null")
    first = ranks.first_per_key(t, ["RID"], [F.col("EXAMDATE"), F.col("DRAW_ID")])
    found = {m: sorted(tables.columns_like(t, p)) for m, p in {"p_tau217": r"(?i)^p?t(au)?[-_]?217", "gfap": r"(?i)^gfap", "nfl": r"(?i)^nfl"}.items()}
    first = tables.mask_sentinels(first, [c for cols in found.values() for c in cols])
    return first.select("RID", "DRAW_ID", *(F.coalesce(*cols).alias(m) for m, cols in found.items()))


@query("feed_rois", """SELECT "MRI ID" AS scan, CAST(eTIV AS DOUBLE) AS left_, CASE WHEN NOT isnan(nWBV) THEN nWBV END AS r2, '0,1|0|1,2' AS places FROM (SELECT DISTINCT "MRI ID", eTIV, nWBV FROM oasis_longitudinal)""")
def feed_rois(spark: SparkSession, d: str) -> DataFrame:
    """Region volumes as an embedding in the order of their names, with the places of regions and sides."""
    t = table(spark, d, "oasis_longitudinal").select(F.col("MRI ID").alias("scan"), F.col("eTIV").alias("roi_hippocampus_left"), F.col("ASF").alias("roi_hippocampus_right"), F.col("nWBV").alias("roi_ventricle_right"))
    r, places = tables.rois(t.select("scan", "roi_hippocampus_left", "roi_ventricle_right", F.col("roi_ventricle_right").alias("roi_hippocampus_right")).distinct())
    named = "|".join(",".join(map(str, places[k])) for k in ("hippocampus", "left", "right"))
    return r.select("scan", F.col("emb")[0].alias("left_"), F.col("emb")[2].alias("r2"), F.lit(named).alias("places"))


@query("feed_tissues", """WITH t AS (SELECT DISTINCT ID, eTIV, nWBV, ASF, Educ FROM oasis_cross_sectional), v AS (SELECT ID, CAST(eTIV AS DOUBLE) AS a, CASE WHEN NOT isnan(nWBV) THEN nWBV END * eTIV AS b, CASE WHEN NOT isnan(nWBV) THEN eTIV - nWBV * eTIV END AS c, CASE WHEN NOT isnan(ASF) THEN ASF END AS e, CASE WHEN Educ IS NULL THEN NULL WHEN Educ % 2 = 0 THEN '3T' ELSE '1.5T' END AS strength FROM t)
SELECT ID, strength, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS a, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS b, round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) AS c, round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 6) AS e FROM v""")
def feed_tissues(spark: SparkSession, d: str) -> DataFrame:
    """Four tissue volumes z-scored over all, and the field strength as a name from a number."""
    t = table(spark, d, "oasis_cross_sectional").select("ID", "eTIV", "nWBV", "ASF", "Educ").distinct()
    v = t.select("ID", F.col("eTIV").cast("double").alias("a"), (number("nWBV") * F.col("eTIV")).alias("b"), (F.col("eTIV") - number("nWBV") * F.col("eTIV")).alias("c"), number("ASF").alias("e"), F.when(F.col("Educ") % 2 == 0, "3.0").when(F.col("Educ").isNotNull(), "1.50").alias("s"))
    z = statistics.z_scores(v, ["a", "b", "c", "e"])
    return z.select("ID", co.field_strength(F.col("s")).alias("strength"), *(F.round(f"{c}_z", 6).alias(c) for c in "abce"))


_TRAJ = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID, VISCODE2 ORDER BY update_stamp DESC, ID) AS k0 FROM dxsum) WHERE k0 = 1 AND EXAMDATE IS NOT NULL AND RID IS NOT NULL),
 tr AS (SELECT RID, arg_min(DIAGNOSIS, struct_pack(e := EXAMDATE, i := ID)) AS first, count(*) AS visits, sum((DIAGNOSIS = 3)::INT) AS e FROM cur WHERE DIAGNOSIS IN (1, 2, 3) GROUP BY RID)"""


@query("feed_conversion", f"""WITH {_C}, {_TRAJ} SELECT subject_id, round(emb[1], 6) AS first_dim, CASE WHEN first = 2 AND visits > 1 THEN CAST(e > 0 AS INT) END AS conversion, apoe4 FROM c LEFT JOIN tr ON subject_id = CAST(RID AS VARCHAR)""")
def feed_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with conversion and genotype looked up by id: conversion from the subject's visits, gaps where it has none."""
    from siftline.sources.clinical import current_visits

    v = current_visits(table(spark, d, "dxsum"), "DIAGNOSIS").where("DIAGNOSIS in (1, 2, 3)")
    t = tables.conversion(v, "RID", "EXAMDATE", "ID", "DIAGNOSIS", 2, 3).select(F.col("RID").cast("string").alias("subject_id"), F.col("conversion").alias("looked_up"))
    return co.contract(spark, d).join(t, "subject_id", "left").select("subject_id", F.round(F.col("emb")[0], 6).alias("first_dim"), F.col("looked_up").alias("conversion"), "apoe4")


@query("scalar_amyloid", f"WITH {_C} SELECT subject_id, CASE WHEN p_tau217 IS NOT NULL THEN (p_tau217 * 2 >= 1.11)::INT WHEN gfap IS NOT NULL THEN (gfap * 5 < 980)::INT END AS positive FROM c")
def scalar_amyloid(spark: SparkSession, d: str) -> DataFrame:
    """A status by one measure's threshold, by another's where the first is missing."""
    return co.contract(spark, d).select("subject_id", tables.amyloid(F.col("p_tau217") * 2, F.col("gfap") * 5).alias("positive"))


@query("scalar_dates", "SELECT ID, CAST(date_trunc('month', EXAMDATE) AS DATE) AS month, round(CASE WHEN date_diff('day', EXAMDATE::DATE, update_stamp::DATE) >= 0 THEN date_diff('day', EXAMDATE::DATE, update_stamp::DATE) / 365.25 END, 6) AS years FROM dxsum")
def scalar_dates(spark: SparkSession, d: str) -> DataFrame:
    """Months from texts such as 03/2011, and years between two dates."""
    return table(spark, d, "dxsum").select("ID", notation.month(F.date_format("EXAMDATE", "MM/yyyy")).alias("month"), F.round(notation.years(F.col("EXAMDATE"), F.col("update_stamp")), 6).alias("years"))


@query("rank_related", """WITH n AS (SELECT s_nationkey, 'n' || s_nationkey AS main, s_name, s_suppkey FROM supplier), r AS (SELECT 'n3' AS word, s_suppkey, true AS matched FROM n WHERE s_nationkey IN (3, 4) UNION ALL SELECT 'nowhere', s_suppkey, false FROM n) SELECT * FROM r""")
def rank_related(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a word as main item or in a ";" list; all rows, marked so, for a word that none names."""
    k = F.col("s_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), k.cast("string")).alias("main"), F.concat(F.lit(" x ; N"), (k - 1).cast("string"), F.lit("; y")).alias("others"))
    out = None
    for w in ("n3", "nowhere"):
        r = graphs.related(s, "main", "others", w).select(F.lit(w).alias("word"), "s_suppkey", "matched")
        out = r if out is None else out.unionByName(r)
    return out


@query("rank_binding", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_discount DESC, l_extendedprice, l_orderkey, l_linenumber) AS INT) AS place FROM lineitem QUALIFY place <= 50")
def rank_binding(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 by one number falling, another rising, then the id."""
    order = [F.col("l_discount").desc(), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    top = table(spark, d, "lineitem").orderBy(*order).limit(50)
    return top.withColumn("place", F.row_number().over(ranks.Window.orderBy(*order))).select("l_orderkey", "l_linenumber", "place")  # 50 rows


@query("join_snapshot", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS note FROM part WHERE p_size >= 40")
def join_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A shortlist with what a snapshot file says about each item, null where it says nothing."""
    at, p = scratch(spark), table(spark, d, "part")
    s = p.where("p_partkey % 3 = 0").groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), "p_name"))).alias("complexes"))).alias("value"))  # 500 at most
    s.select("value").write.option("maxRecordsPerFile", 1).text(at)
    known = files.snapshot(spark, at, "complexes").select(F.col("key").cast("bigint").alias("p_partkey"), F.col("value").alias("note"))
    return p.where("p_size >= 40").select("p_partkey").join(known, "p_partkey", "left")


@query("stat_positivity", f"WITH {_C}, v AS (SELECT site, 1 / (1 + exp(-(nfl - 25) / 8)) AS p FROM c WHERE nfl IS NOT NULL) SELECT coalesce(site, '(none)') AS site, count(*) AS n, round(avg(p), 6) AS mean, round(avg((p >= 0.5)::INT), 6) AS positive FROM v GROUP BY 1")
def stat_positivity(spark: SparkSession, d: str) -> DataFrame:
    """How many of a cohort a probability calls positive."""
    v = co.contract(spark, d).where("nfl is not null").select(F.coalesce("site", F.lit("(none)")).alias("site"), (1 / (1 + F.exp(-(F.col("nfl") - 25) / 8))).alias("p"))
    return v.groupBy("site").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg((F.col("p") >= 0.5).cast("double")), 6).alias("positive"))


@query("stat_group_difference", f"""WITH {_C}, s AS (SELECT subject_id, (dx = 'AD')::INT AS f, nfl AS v FROM c WHERE dx IN ('AD', 'CN') AND nfl IS NOT NULL), reps AS (SELECT unnest(range({_REPS})) AS rep),
ab AS (SELECT rep, {_CODE("'b:' || rep")} % {_P31 - 1} + 1 AS a, {_CODE("'b:' || rep", 9)} % {_P31} AS b FROM reps), w AS (SELECT rep, f, v, {_POIS} AS k FROM (SELECT *, (a * ({_CODE("subject_id")} % {_P31}) + b) % {_P31} AS u FROM s, ab)),
r AS (SELECT rep, sum(k * v) FILTER (f = 1) / sum(k) FILTER (f = 1) - sum(k * v) FILTER (f = 0) / sum(k) FILTER (f = 0) AS d FROM w GROUP BY rep)
SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(v) FILTER (f = 1) - avg(v) FILTER (f = 0) FROM s), 6) AS difference, round((SELECT corr(f, v) FROM s), 6) AS r, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM r""")
def stat_group_difference(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two groups' means, its correlation and its bootstrap interval."""
    c, ad = co.contract(spark, d).where("dx in ('AD', 'CN')"), F.col("dx") == "AD"
    ci = resample.interval(resample.bootstrap_difference(c, "subject_id", ad, "nfl"), "difference").select("lo", "hi")
    return _round(beside(statistics.point_biserial(c, ad, "nfl"), ci), "difference", "r", "lo", "hi")


@query("rank_five_signals", f"""WITH {_C}, s AS (SELECT subject_id, p_tau217 / 0.5 AS a, gfap / 300 AS b, nfl / 40 AS e, apoe4 / 2.0 AS f, CAST(amyloid AS DOUBLE) AS g FROM c)
SELECT subject_id, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT + (g IS NOT NULL)::INT AS signals, round((coalesce(0.3 * a, 0) + coalesce(0.25 * b, 0) + coalesce(0.15 * e, 0) + coalesce(0.15 * f, 0) + coalesce(0.15 * g, 0)) / nullif((a IS NOT NULL)::INT * 0.3 + (b IS NOT NULL)::INT * 0.25 + (e IS NOT NULL)::INT * 0.15 + (f IS NOT NULL)::INT * 0.15 + (g IS NOT NULL)::INT * 0.15, 0), 9) AS score FROM s""")
def rank_five_signals(spark: SparkSession, d: str) -> DataFrame:
    """Five signals, whose weights are shared out over those that are present."""
    c = co.contract(spark, d).select("subject_id", (F.col("p_tau217") / 0.5).alias("a"), (F.col("gfap") / 300).alias("b"), (F.col("nfl") / 40).alias("e"), (F.col("apoe4") / 2.0).alias("f"), F.col("amyloid").cast("double").alias("g"))
    return graphs.composite(c, {"a": 0.3, "b": 0.25, "e": 0.15, "f": 0.15, "g": 0.15}).select("subject_id", "signals", F.round("score", 9).alias("score"))


_REVENUE = "v AS (SELECT p_partkey, p_brand, p_size, coalesce(sum(l_extendedprice * (1 - l_discount)), 0) AS s FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"


def _revenue(spark: SparkSession, d: str) -> DataFrame:
    p, v = table(spark, d, "part"), table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    return cut(p.join(v, p["p_partkey"] == v["l_partkey"], "left").select("p_partkey", "p_brand", "p_size", F.coalesce("s", F.lit(0.0)).alias("s")))


@query("rank_universe", f"WITH {_REVENUE}, t AS (SELECT *, row_number() OVER (ORDER BY s DESC, p_partkey) AS k FROM v), g AS (SELECT p_partkey, 100 + row_number() OVER (ORDER BY p_partkey) AS k FROM t WHERE p_size = 50 AND k > 100), u AS (SELECT p_partkey, k FROM t WHERE k <= 100 UNION ALL FROM g) SELECT p_partkey, k AS place, p_brand, p_size FROM u JOIN part USING (p_partkey)")
def rank_universe(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred by score and then the gold items, each once, with their features."""
    v = _revenue(spark, d)
    return graphs.ranked_universe(v, "p_partkey", "s", v.where("p_size = 50").select("p_partkey"), 100).join(v.select("p_partkey", "p_brand", "p_size"), "p_partkey")


_GOLD = {"small": "p_size <= 5", "middle": "p_size BETWEEN 20 AND 25", "large": "p_size >= 45", "control": "p_partkey % 10 = 0"}


@query("rank_battery", f"""WITH {_REVENUE}, reps AS (SELECT unnest(range({_REPS})) AS rep), s AS ({" UNION ALL ".join(f"SELECT '{k}' AS grp, p_partkey, s AS nfl, ({c})::INT AS y FROM v" for k, c in _GOLD.items())}),
i AS (SELECT grp, nfl, y, row_number() OVER (PARTITION BY grp ORDER BY {_U.format("p_partkey || ':p'")}, p_partkey) - 1 AS i FROM s), gs AS (SELECT grp, sum(y) AS k, count(*) AS size FROM s GROUP BY 1), {_affine("p", "gs", "size")},
rk AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY nfl) + (count(*) OVER (PARTITION BY grp, nfl) - 1) / 2 AS r FROM i), ob AS (SELECT grp, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM rk GROUP BY grp),
pe AS (SELECT grp, rep, (sum(r) FILTER ((a * i + b) % n < k) - max(k) * (max(k) + 1) / 2) / (max(k) * (max(n) - max(k))) AS auc FROM rk JOIN gs USING (grp) JOIN gm USING (grp) GROUP BY ALL),
p AS (SELECT grp, any_value(ob.auc) AS auc, (1 + count(*) FILTER (pe.auc >= ob.auc - 1e-12)) / {_REPS + 1} AS p FROM pe JOIN ob USING (grp) GROUP BY grp),
q AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i FROM p WHERE grp <> 'control')
SELECT p.grp AS gold, round(p.auc, 6) AS auc, round(p.p, 6) AS p, round(q.q, 6) AS q FROM p LEFT JOIN (SELECT grp, min(least(1, p * m / i)) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS q FROM q) q USING (grp)""")
def rank_battery(spark: SparkSession, d: str) -> DataFrame:
    """A ranking against several gold sets and a control: areas, permutation p-values, and q over the sets without the control."""
    sets = [F.struct(F.lit(k).alias("gold"), F.expr(c.replace("BETWEEN", "between")).cast("int").alias("y")) for k, c in _GOLD.items()]
    s = cut(_revenue(spark, d).select("p_partkey", "s", F.explode(F.array(*sets)).alias("x")).select("p_partkey", "s", "x.*"))
    a = ranks.rank_auc(s, ["gold"], "s", F.col("y")).select("gold", "auc")
    null = resample.permuted_auc(s, "p_partkey", "s", F.col("y"), "gold", keys=["gold"]).select("gold", F.col("auc").alias("drawn"))
    p = cut(null.join(a, "gold").groupBy("gold", "auc").agg(((1 + F.sum((F.col("drawn") >= F.col("auc") - 1e-12).cast("int"))) / F.lit(_REPS + 1)).alias("p")))
    q = ranks.benjamini_hochberg(p.where("gold <> 'control'").select("gold", "p", F.lit(0).alias("all")), ["all"], "p").select("gold", "q")
    return _round(p.join(q, "gold", "left"), "auc", "p", "q")


_TAIL = f"""n AS (SELECT set_id, count(*) AS size, count(q.item) AS overlap FROM s LEFT JOIN q USING (item) GROUP BY set_id HAVING count(q.item) > 0), u AS (SELECT count(*) AS universe FROM (SELECT item FROM s UNION SELECT item FROM q)), x AS (SELECT n.*, universe, (SELECT count(*) FROM q) AS drawn FROM n, u),
terms AS (SELECT *, unnest(range(overlap, least(size, drawn) + 1)) AS i FROM x), p AS (SELECT set_id, size, overlap, universe, drawn, least(1, sum(exp({_LC.format('size', 'i')} + {_LC.format('(universe - size)', '(drawn - i)')} - {_LC.format('universe', 'drawn')}))) AS p FROM terms WHERE drawn - i <= universe - size GROUP BY ALL),
k AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i FROM p)
SELECT set_id, size, overlap, round(p, 6) AS p, round(greatest(p, min(least(1, p * m / i)) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k"""


@query("enrich_mechanism", f"""WITH s AS (SELECT DISTINCT p_brand AS set_id, p_partkey AS item FROM part), q AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_suppkey = 7), {_TAIL}""")
def enrich_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """Which sets the partners of one node are over-represented in."""
    q = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_partkey").alias("item"))
    sets = table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("item"))
    return _round(graphs.over_representation(sets, q), "p", "q").select("set_id", "size", "overlap", "p", "q")


@query("enrich_propagation", f"""WITH {_WALK}, r AS (SELECT g.src AS item, row_number() OVER (ORDER BY coalesce(p, 0) DESC, g.src) AS k FROM g LEFT JOIN p24 ON node = g.src WHERE g.src NOT IN ('n1', 'n7')), s AS (SELECT 'nation ' || s_nationkey AS set_id, 's' || s_suppkey AS item FROM supplier), q AS (SELECT item FROM r WHERE k <= 30), {_TAIL}""")
def enrich_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Which sets the nodes with most of a score that was spread from seeds, the seeds aside, are over-represented in."""
    e = cut(graphs.undirected(_trade(spark, d), "a", "b", "w"))
    seeds = e.where("src in ('n1', 'n7')").select("src").distinct()
    top = graphs.walk_with_restart(e, seeds).where("node not in ('n1', 'n7')").orderBy(F.col("score").desc(), "node").limit(30).select(F.col("node").alias("item"))
    sets = table(spark, d, "supplier").select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("set_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("item"))
    return _round(graphs.over_representation(sets, cut(top)), "p", "q").select("set_id", "size", "overlap", "p", "q")


@query("grid_left_to_do", f"WITH {_C}, g AS (SELECT DISTINCT site, m AS marker FROM c, (SELECT unnest(['p_tau217', 'gfap', 'nfl']) AS m)), d AS (SELECT DISTINCT site, 'gfap' AS marker FROM c WHERE gfap IS NOT NULL) SELECT * FROM g WHERE NOT EXISTS (FROM d WHERE d.site IS NOT DISTINCT FROM g.site AND d.marker = g.marker)")
def grid_left_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of site and marker that have no result yet."""
    c = co.contract(spark, d)
    grid = c.select("site", F.explode(F.array(*map(F.lit, ["p_tau217", "gfap", "nfl"]))).alias("marker"))
    return tables.left_to_do(grid, c.where("gfap is not null").select("site", F.lit("gfap").alias("marker")), ["site", "marker"])
