"""From a hypothesis in plain text to a refereed card, and what surrounds it: seeds, batches, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import routing
from siftline.operators import clusters, referee, resample, statistics, tables
from siftline.session import beside, cut, table
from siftline.sources import cohort as co

R = lambda c, n=4: F.round(c, n)
QUERIES, SQL = {}, {}
MARKERS = ["p_tau217", "gfap"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def prepared(c: DataFrame) -> DataFrame:
    """A cohort with all contract columns (null where it lacks one), emb and male; z-scored features become emb if there is none."""
    have = c.columns
    c = c.withColumns({k: F.lit(None).cast("string" if k in ("dx", "sex", "site", "scanner", "subject_id") else "double") for k in co.COLUMNS if k not in have})
    if "emb" not in have:
        c = c.withColumn("emb", F.array(*(F.col(k) for k in have if k.endswith("_z"))))
    return c.withColumn("male", F.when(F.col("sex") == "M", 1.0).when(F.col("sex") == "F", 0.0))


def investigate(spark: SparkSession, d: str, hypothesis: str, dataset: str = "adni", anchor: str | None = None, regions: dict[str, list[int]] | None = None, external: bool = False, reps: int = referee.REPEATS, n: int = resample.DRAWS) -> DataFrame:
    """One row, the card: dataset, target, mode, region, n, auc, lo, hi, p, tests (map of result by key), score, verdict, promoted, rung.

    The text names the target and, if ``regions`` maps it to dimensions, the part of the embedding; ``anchor``
    is the marker that the biomarker test tries first. A text without a known target is refused: its verdict
    is "refused" and nothing is fitted. For site and scanner the card holds the mean area over classes and no
    tests. An unsupervised text is answered by ``discover``. reps and n are the work's budget: repeats of the folds, draws.
    """
    t = F.lit(hypothesis)
    said = spark.range(1).select(routing.target(t).alias("target"), routing.mode(t).alias("mode"), routing.region(t).alias("region")).first()
    none = lambda k: F.lit(None).cast(k)
    head = [F.lit(dataset).alias("dataset"), F.lit(said["target"]).cast("string").alias("target"), F.lit(said["mode"]).alias("mode"), F.lit(said["region"]).cast("string").alias("region")]
    if said["target"] is None:
        return spark.range(1).select(*head, none("bigint").alias("n"), *(none("double").alias(c) for c in ("auc", "lo", "hi", "p")), none("map<string,string>").alias("tests"), none("int").alias("score"), F.lit("refused").alias("verdict"), F.lit(False).alias("promoted"), none("string").alias("rung"))
    c = prepared(co.load(spark, d, dataset).df)
    if said["region"] in (regions or {}):
        c = tables.restrict(c, regions[said["region"]])
    if said["target"] in ("site", "scanner"):
        a = referee.batch_areas(cut(c), "subject_id", "emb", [said["target"]])
        return a.select(*head, F.col("n").cast("bigint").alias("n"), "auc", *(none("double").alias(x) for x in ("lo", "hi", "p")), none("map<string,string>").alias("tests"), none("int").alias("score"), none("string").alias("verdict"), F.lit(False).alias("promoted"), none("string").alias("rung"))
    markers = [anchor, *(m for m in MARKERS if m != anchor)] if anchor else MARKERS
    tests, decided, effect = referee.referee(cut(tables.point_head(c, said["target"])), "subject_id", "emb", "y", "site", "scanner", ["age", "male"], markers, reps, n)
    climbed = referee.rung(tests, decided, effect, external=external)
    card = beside(beside(beside(effect, decided), tests.agg(F.map_from_entries(F.collect_list(F.struct("key", "result"))).alias("tests"))), climbed)
    return card.select(*head, F.col("n").cast("bigint").alias("n"), "auc", "lo", "hi", "p", "tests", "score", "verdict", "promoted", "rung")


def discover(spark: SparkSession, d: str, dataset: str = "adni", most: int = 6, target: str = "dx_binary") -> DataFrame:
    """A row a cluster: cluster, n, stability, stable, score, verdict, promoted, rung, scanner_v, artefact.

    Clusters are found without labels, k by silhouette; each one's rows then go before the referee as a cohort
    of their own. A cluster whose membership follows the scanner (Cramer's V of 0.25 or more) and that isn't
    promoted is an artefact. There are at most ``most`` clusters, so the loop over them is short.
    """
    c = cut(prepared(co.load(spark, d, dataset).df))
    z, dims = clusters.reduced(c, "subject_id", "emb")
    k, centres, labels = clusters.choose_k(z, dims, list(range(2, most + 1)))
    steady = clusters.stability(z, dims, centres)
    j = cut(c.join(labels.select(F.col("id").alias("subject_id"), "cluster"), "subject_id"))
    v = statistics.cramers_v(j, "cluster", "scanner").select(F.col("v").alias("scanner_v"))
    out = None
    for i in range(k):
        own = cut(tables.point_head(j.where(F.col("cluster") == i), target))
        tests, decided, effect = referee.referee(own, "subject_id", "emb", "y", "site", "scanner", ["age", "male"], MARKERS)
        card = beside(beside(effect.select("n"), decided), referee.rung(tests, decided, effect, stability=float(steady[i])))
        card = card.select(F.lit(i).alias("cluster"), "n", F.lit(float(steady[i])).alias("stability"), F.lit(bool(steady[i] >= 0.6)).alias("stable"), "score", "verdict", "promoted", "rung")
        out = card if out is None else out.unionByName(card)
    return beside(out, v).withColumn("artefact", (F.col("scanner_v") >= 0.25) & ~F.col("promoted"))


@query
def investigate_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis from the embedding after harmonising, with NfL as the marker of choice."""
    c = investigate(spark, d, "Patients with dementia can be told from controls by their scans", "adni:combat", "nfl")
    return c.withColumns({x: R(x) for x in ("auc", "lo", "hi", "p")})


@query
def investigate_scanner(spark: SparkSession, d: str) -> DataFrame:
    return investigate(spark, d, "The scanner can be read off the embedding", "adni").withColumn("auc", R("auc"))


@query
def referee_seed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How often the verdict flips over seeds."""
    p = cut(tables.point_head(prepared(co.contract(spark, d)), "dx_binary"))
    return referee.seed_sweep(p, [0, 1, 2], "subject_id", "emb", "y", "site", "scanner", ["age", "male"], MARKERS)[1]


@query
def discover_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two to six clusters of the embedding, each before the referee."""
    return discover(spark, d).withColumns({c: R(c) for c in ("stability", "scanner_v")})


@query
def leakage_in_controls(spark: SparkSession, d: str) -> DataFrame:
    """Scanner and site areas among controls only, where no disease can explain them."""
    return referee.batch_areas(cut(co.contract(spark, d).where("dx = 'CN'")), "subject_id", "emb", ["scanner", "site"]).withColumn("auc", R("auc"))


@query
def stat_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Information shared by the diagnosis and the site of visits."""
    v = table(spark, d, "dxsum").where("DIAGNOSIS in (1, 2, 3)")
    return statistics.mutual_information(v, "DIAGNOSIS", "SITEID").withColumns({c: R(c, 6) for c in ("mi", "nmi", "ami")})


SQL["stat_mutual_information"] = """
WITH t AS (SELECT DIAGNOSIS a, SITEID b, count(*)::DOUBLE c FROM dxsum WHERE DIAGNOSIS IN (1, 2, 3) AND SITEID IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(c) na FROM t GROUP BY a), rb AS (SELECT b, sum(c) nb FROM t GROUP BY b), s AS (SELECT sum(c) n FROM t),
m AS (SELECT sum(c / n * ln(n * c / (na * nb))) mi FROM t JOIN ra USING (a) JOIN rb USING (b), s),
h AS (SELECT (SELECT -sum(na / n * ln(na / n)) FROM ra, s) ha, (SELECT -sum(nb / n * ln(nb / n)) FROM rb, s) hb),
p AS (SELECT na, nb, n, unnest(range(greatest(1, na + nb - n)::BIGINT, least(na, nb)::BIGINT + 1))::DOUBLE k FROM ra, rb, s),
e AS (SELECT sum(k / n * ln(n * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(n - na + 1) + lgamma(n - nb + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(n - na - nb + k + 1))) emi FROM p)
SELECT CAST(n AS BIGINT) AS n, round(mi, 6) AS mi, round(mi / ((ha + hb) / 2), 6) AS nmi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM s, m, h, e
"""
