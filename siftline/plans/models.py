"""Queries over probes, the referee, harmonising, clusters and fusion. They fit models, which SQL can't; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import clusters, fusion, harmonize, linear, ranks, referee, resample, statistics, tables
from siftline.session import beside, cut, table
from siftline.plans.measures import _C
from siftline.sources import cohort as co

R = lambda c, n=4: F.round(c, n)
QUERIES, SQL = {}, {}


def query(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


def with_sql(sql: str):
    return lambda f: query(f, sql)


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    p = tables.point_head(co.contract(spark, d), "dx_binary")
    return cut(p.withColumn("male", F.when(F.col("sex") == "M", 1.0).when(F.col("sex") == "F", 0.0)))


@query
def probe_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of the diagnosis, sites kept apart."""
    return linear.probe(_outcome(spark, d), "subject_id", "emb", "y", "grp", reps=2).select("id", "y", "grp", R("score").alias("score"))


@query
def probe_effect(spark: SparkSession, d: str) -> DataFrame:
    e, _ = referee.naive_effect(_outcome(spark, d), "subject_id", "emb", "y", "grp")
    return e


@query
def probe_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Areas with age and sex taken out of the features within each training set."""
    p = _outcome(spark, d)
    a = ranks.rank_auc(linear.probe(p, "subject_id", "emb", "y", "grp"), [], "score", F.col("y")).select(F.col("auc").alias("plain"))
    b = ranks.rank_auc(linear.probe(p, "subject_id", "emb", "y", "grp", ["age", "male"]), [], "score", F.col("y")).select(F.col("auc").alias("adjusted"))
    return beside(a, b)


@query
def probe_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Conversion from the embedding, from blood and from both, on the same subjects."""
    c = tables.complete_cases(tables.point_head(co.contract(spark, d), "conversion"), ["p_tau217", "gfap", "nfl"])
    v = cut(fusion.views(c, "subject_id", "y", "grp", {"embedding": F.col("emb"), "plasma": F.array("p_tau217", "gfap", "nfl")}))
    return fusion.compare(v, ["embedding", "plasma"])


@query
def probe_many_classes(spark: SparkSession, d: str) -> DataFrame:
    """Ten classes of the embeddings table, one against the rest, and the mean of their areas."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    o = cut(linear.probe(e, "id", "x", "label", None, k=3))
    s = o.select("id", "y", F.posexplode("scores").alias("cls", "s"))
    return ranks.rank_auc(s, ["cls"], "s", (F.col("y") == F.col("cls")).cast("int")).select("cls", R("auc").alias("auc"))


@query
def probe_label_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Negative control: labels shuffled over all rows, models refitted with sites apart."""
    p = _outcome(spark, d)
    k = p.agg(F.sum("y").alias("k"))
    s = resample.ranked_by_hash(p.withColumn("_all", F.lit(0)), ["_all"], ranks.hash_unit(F.col("subject_id"), F.lit("s")), F.col("subject_id"))
    s = beside(s, k).withColumn("y", (F.col("hash_rank") <= F.col("k")).cast("int"))
    return ranks.rank_auc(linear.probe(s, "subject_id", "emb", "y", "grp"), [], "score", F.col("y"))


@query
def probe_within_strata(spark: SparkSession, d: str) -> DataFrame:
    """The area within each scanner, for strata of 40 rows or more."""
    o = cut(linear.probe(_outcome(spark, d), "subject_id", "emb", "y", "grp", keep=["scanner"]))
    a = ranks.rank_auc(o.where("scanner is not null"), ["scanner"], "score", F.col("y"))
    return a.where("pos + neg >= 40").select("scanner", "pos", "neg", R("auc").alias("auc"))


@query
def probe_region(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of dimensions on its own: which part of the embedding holds the signal."""
    p = _outcome(spark, d)
    out = None
    for i in range(0, 8, 2):
        a = ranks.rank_auc(linear.probe(tables.restrict(p, [i, i + 1]), "subject_id", "emb", "y", "grp", k=3), [], "score", F.col("y")).select(F.lit(f"{i}-{i + 1}").alias("region"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


@query
def referee_tests(spark: SparkSession, d: str) -> DataFrame:
    t, _, _ = referee.referee(_outcome(spark, d), "subject_id", "emb", "y", "site", "scanner", ["age", "male"], ["p_tau217", "gfap"])
    return t


@query
def referee_verdict(spark: SparkSession, d: str) -> DataFrame:
    _, v, _ = referee.referee(_outcome(spark, d), "subject_id", "emb", "y", "site", "scanner", ["age", "male"], ["p_tau217", "gfap"])
    return v


@query
def referee_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Which confounds share variance with the score."""
    o = cut(linear.probe(_outcome(spark, d), "subject_id", "emb", "y", "grp", keep=["site", "scanner", "sex", "age"]))
    return referee.leaderboard(o, ["site", "scanner", "sex"], ["age"])


@query
def harmonize_combat(spark: SparkSession, d: str) -> DataFrame:
    h = co.load(spark, d, "adni:combat").df
    return h.select("subject_id", F.transform("emb", lambda e: F.round(e, 6)).alias("emb"))


@query
def harmonize_leakage(spark: SparkSession, d: str) -> DataFrame:
    """How well the embedding tells the largest site, before and after harmonising."""
    out = None
    largest = co.contract(spark, d).where("site is not null").groupBy("site").count().agg(F.min_by("site", F.struct(-F.col("count"), F.col("site"))).alias("largest"))
    for name, c in (("raw", co.contract(spark, d)), ("combat", co.load(spark, d, "adni:combat").df)):
        c = beside(c.where("site is not null"), largest).withColumn("y", (F.col("site") == F.col("largest")).cast("int"))
        a = ranks.rank_auc(linear.probe(c, "subject_id", "emb", "y"), [], "score", F.col("y")).select(F.lit(name).alias("view"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


@query
def harmonize_area(spark: SparkSession, d: str) -> DataFrame:
    """The outcome's area by fold, each harmonised with parameters of the other folds only, and the area of raw features."""
    p = _outcome(spark, d)
    v = p.select("subject_id", "y", "grp", "site", "age", "sex", "emb")
    f, out, k = cut(linear.folds(v, "subject_id", "y", "grp", 5)), None, 5
    for j in range(k):
        held = F.col("fold")[0] == j
        h = harmonize.combat(f, "subject_id", "emb", "site", ["age", "sex"], ~held)
        # two folds: what is held out, and what both parameters and model come from
        h = cut(h.select(F.col("subject_id").alias("id"), "y", F.col("emb").cast("array<double>").alias("x"), F.array().cast("array<double>").alias("c"), F.array(F.when(held, 0).otherwise(1)).alias("fold")))
        m = linear.fit_logistic(h, 8, 0, 2, 1, [1])
        o = linear.out_of_fold(h.where(F.col("fold")[0] == 0), m, 8, 0, "id string, y int").select(F.lit(j).alias("fold"), "y", F.col("p")[0].alias("score"))
        out = o if out is None else out.unionByName(o)
    a = ranks.rank_auc(cut(out), ["fold"], "score", F.col("y")).select(F.col("fold").cast("string").alias("fold"), F.lit("harmonised").alias("features"), "pos", "neg", "auc")
    raw = linear.probe(p, "subject_id", "emb", "y", "grp")
    return a.unionByName(ranks.rank_auc(raw, [], "score", F.col("y")).select(F.lit("all").alias("fold"), F.lit("raw").alias("features"), "pos", "neg", "auc"))


@query
def harmonize_fold_honest(spark: SparkSession, d: str) -> DataFrame:
    """Harmonised with parameters of one half of the subjects (by hash), the other half only transformed: batch means of both halves."""
    c = co.contract(spark, d)
    half = ranks.hash_unit(F.col("subject_id"), F.lit("h")) < 0.5
    h = harmonize.combat(c, "subject_id", "emb", "site", ["age", "sex"], half).withColumn("trained", half)
    return h.where("site is not null").groupBy("trained", "site").agg(F.count("*").alias("n"), R(F.avg(F.col("emb")[0])).alias("mean"), R(F.stddev_samp(F.col("emb")[0])).alias("deviation"))


@query
def cluster_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with k by silhouette, their stability under subsampling and their silhouette."""
    z, dims = clusters.reduced(co.contract(spark, d), "subject_id", "emb")
    k, centres, lab = clusters.choose_k(z, dims, [2, 3, 4, 5, 6])
    s = clusters.stability(z, dims, centres)
    stab = F.get(F.array(*map(F.lit, s)), F.col("cluster"))
    return lab.groupBy("cluster").agg(F.count("*").alias("n"), R(F.avg("silhouette")).alias("silhouette")).withColumns({"stability": R(stab), "stable": stab >= 0.6})


@query
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    z, dims = clusters.reduced(co.contract(spark, d), "subject_id", "emb")
    return clusters.choose_k(z, dims, [2, 3, 4, 5, 6])[2]


@query
def cluster_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian mixtures over the embeddings table by information criterion."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    z, dims = clusters.reduced(e, "vec_id", "x")
    m = clusters.mixture(z, dims, [1, 2, 3, 4, 6, 8, 10])
    best = min(m, key=lambda k: m[k][3]) if m else None
    return spark.createDataFrame([(k, float(v[3]), k == best) for k, v in m.items()], "k int, bic double, best boolean")


@query
def cluster_recovery(spark: SparkSession, d: str) -> DataFrame:
    """How far clusters of the embeddings table agree with its labels."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    z, dims = clusters.reduced(e, "vec_id", "x")
    c = clusters.kmeans(z, dims, [10])[10][0]
    lab = clusters.labels(z, dims, c).join(e.select(F.col("vec_id").cast("string").alias("id"), "label"), "id")
    return statistics.adjusted_rand(lab, "cluster", "label")


@query
def cluster_referee(spark: SparkSession, d: str) -> DataFrame:
    """What each cluster is like and whether it follows the batch: one pass over rows by cluster."""
    c = co.contract(spark, d)
    z, dims = clusters.reduced(c, "subject_id", "emb")
    lab = clusters.choose_k(z, dims, [2, 3, 4, 5, 6])[2].select(F.col("id").alias("subject_id"), "cluster")
    j = cut(c.join(lab, "subject_id"))
    v = statistics.cramers_v(j, "cluster", "scanner").select(F.col("v").alias("scanner_v"))
    g = j.groupBy("cluster").agg(F.count("*").alias("n"), R(F.avg("age"), 2).alias("age"), R(F.avg((F.col("sex") == "F").cast("double"))).alias("female"), R(F.avg((F.col("dx") == "AD").cast("double"))).alias("ad"), R(F.avg("nfl")).alias("nfl"), R(F.avg("amyloid")).alias("amyloid"))
    return beside(g, v).withColumns({"scanner_v": R("scanner_v"), "batch_artefact": F.col("scanner_v") >= 0.25})


@query
def fusion_attribution(spark: SparkSession, d: str) -> DataFrame:
    c = tables.complete_cases(tables.point_head(co.contract(spark, d), "dx_binary"), ["p_tau217", "gfap", "nfl", "age"])
    v = cut(fusion.views(c, "subject_id", "y", "grp", {"embedding": F.col("emb"), "plasma": F.array("p_tau217", "gfap", "nfl"), "age": F.array("age")}))
    return fusion.attribution(v, ["embedding", "plasma", "age"])


@query
def fusion_attention(spark: SparkSession, d: str) -> DataFrame:
    """Features from attention within each row's embedding."""
    a = fusion.attended(co.contract(spark, d).select("subject_id", "emb"), "emb", 8)
    return a.select("subject_id", F.transform("attended", lambda e: F.round(e, 6)).alias("attended"), F.transform("weights", lambda e: F.round(e, 6)).alias("weights"))


@query
def rank_learned(spark: SparkSession, d: str) -> DataFrame:
    """A learned ranking: rank-normalised signals, gaps as one half, each row scored by the model of all others, with its calibration."""
    c = co.contract(spark, d).where("dx in ('AD', 'CN')").withColumn("y", (F.col("dx") == "AD").cast("int")).withColumn("all", F.lit(0))
    for m in ("p_tau217", "gfap", "nfl"):
        c = cut(ranks.rank_normalise(c, ["all"], m, f"{m}_u"))
    c = c.withColumn("x", F.array(*(F.coalesce(f"{m}_u", F.lit(0.5)) for m in ("p_tau217", "gfap", "nfl"))))
    o = cut(linear.leave_one_out(c, "subject_id", "x", "y"))
    return beside(ranks.rank_auc(o, [], "score", F.col("y")), statistics.calibration(o, "score", F.col("y")))


_HELD_OUT = f"""WITH {_C}, v AS (SELECT (dx = 'AD')::INT AS y, {", ".join(f"CASE WHEN max({m}) OVER () = min({m}) OVER () THEN CASE WHEN {m} IS NOT NULL THEN 1.0 END ELSE ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END AS {m}" for m in ("p_tau217", "gfap", "nfl"))} FROM c WHERE dx IN ('AD', 'CN')),
o AS (SELECT unnest(['none', 'p_tau217', 'gfap', 'nfl']) AS left_out), w AS (SELECT y, left_out, CASE WHEN left_out <> 'p_tau217' THEN p_tau217 END AS a, CASE WHEN left_out <> 'gfap' THEN gfap END AS b, CASE WHEN left_out <> 'nfl' THEN nfl END AS e FROM v, o),
s AS (SELECT left_out, y, (coalesce(0.4 * a, 0) + coalesce(0.3 * b, 0) + coalesce(0.3 * e, 0)) / nullif((a IS NOT NULL)::INT * 0.4 + (b IS NOT NULL)::INT * 0.3 + (e IS NOT NULL)::INT * 0.3, 0) AS s FROM w),
r AS (SELECT *, rank() OVER (PARTITION BY left_out ORDER BY s) + (count(*) OVER (PARTITION BY left_out, s) - 1) / 2 AS k FROM s WHERE s IS NOT NULL)
SELECT left_out, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 4) AS auc FROM r GROUP BY left_out"""


@with_sql(_HELD_OUT)
def rank_held_out_signals(spark: SparkSession, d: str) -> DataFrame:
    """The area of a composite with each signal left out in turn, and of all; one job over exploded variants."""
    from siftline.operators.graphs import composite

    w = {"p_tau217": 0.4, "gfap": 0.3, "nfl": 0.3}
    c = co.contract(spark, d).where("dx in ('AD', 'CN')").withColumn("y", (F.col("dx") == "AD").cast("int")).withColumn("all", F.lit(0))
    for m in w:
        c = cut(ranks.min_max(c, ["all"], m, f"{m}_m"))
    c = c.withColumn("left_out", F.explode(F.array(*map(F.lit, ["none", *w]))))
    c = c.withColumns({f"{m}_m": F.when(F.col("left_out") != m, F.col(f"{m}_m")) for m in w})
    return ranks.rank_auc(composite(c, {f"{m}_m": x for m, x in w.items()}), ["left_out"], "score", F.col("y")).select("left_out", R("auc").alias("auc"))
