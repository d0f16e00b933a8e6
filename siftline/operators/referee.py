"""Is a signal in an embedding real? A probe's area with its interval, and five tests that try to explain it away.

Tests: adjusting for covariates, batch leakage, brain age, agreement with a biomarker, replication on the
smallest sites. Each gives a row (key, result, detail numbers), and the weighted score follows from the rows.

Every number comes from out-of-fold scores (siftline.operators.linear) and grouped aggregates; a test that
can't be made (too few rows, one class, no variance) is "na" and leaves both sides of the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import linear, ranks, resample, statistics
from siftline.operators.keyblocks import blocked, running
from siftline.session import beside, cut, number

#: The tests' weights and credits, and the score's bands.
WEIGHTS = {"covariates": 15, "batch": 25, "brain_age": 25, "biomarker": 20, "replication": 15}
CREDIT = {"pass": 1.0, "weak": 0.5, "partial": 0.5, "fail": 0.0}
BANDS = [(85, "robust"), (70, "partly robust"), (40, "fragile"), (0, "refuted")]
#: How far the evidence for a pattern goes, from the lowest rung to the highest.
RUNGS = ["raw_pattern", "stable_cluster", "confound_survivor", "severity_anchored", "externally_replicated"]


REPEATS = 8


def naive_effect(df: DataFrame, id_: str, emb: str, y: str, group: str | None, reps: int = REPEATS, n: int = resample.DRAWS) -> tuple[DataFrame, DataFrame]:
    """(one row: n, auc, lo, hi, p; the out-of-fold scores)."""
    o = cut(linear.probe(df, id_, emb, y, group, reps=reps, keep=[c for c in ("site", "age") if c in df.columns]))
    drawn = cut(resample.bootstrap_auc(o, "id", "score", F.col("y"), n, observed=True))
    a = drawn.where("rep = -1").select((F.col("pos") + F.col("neg")).alias("n"), "auc")
    p = resample.p_value(resample.permuted_auc(o, "id", "score", F.col("y"), "grp" if group else None, n), a, "auc", n)
    return beside(p, resample.interval(drawn.where("rep >= 0"), "auc")).select("n", "auc", "lo", "hi", "p"), o


def retained(after: Column, before: Column) -> Column:
    """Share of the area over one half that is left, from 0 to 1.5."""
    return F.least(F.greatest((after - 0.5) / F.greatest(before - 0.5, F.lit(1e-6)), F.lit(0.0)), F.lit(1.5))


def grade(share: Column) -> Column:
    return F.when(share >= 0.7, "pass").when(share >= 0.4, "weak").when(share.isNotNull(), "fail").otherwise("na")


def covariate_test(df: DataFrame, id_: str, emb: str, y: str, group: str, covariates: list[str], before: DataFrame) -> DataFrame:
    """key, result, value: the area after taking the covariates' part out of the features within each training set."""
    o = linear.probe(df, id_, emb, y, group, covariates)
    x = beside(before.select(F.col("auc").alias("b")), ranks.rank_auc(o, [], "score", F.col("y")).select(F.col("auc").alias("a")))
    share = retained(F.col("a"), F.col("b"))
    return x.select(F.lit("covariates").alias("key"), grade(share).alias("result"), share.alias("value"))


def batch_scores(df: DataFrame, id_: str, emb: str, batch: str, site: str | None = None) -> DataFrame:
    """id, y, k (classes), cls, s: out-of-fold scores (ungrouped folds) of each class of ``batch``, or of ``site`` where that has less than two.

    A class of one row is left out, as no model can both learn it and be tried on it. Of two classes one is kept, as both areas are the same.
    """
    v, seen = df.where(F.col(id_).isNotNull() & F.col(emb).isNotNull()), None
    for c in [batch] + ([site] if site else []):
        usual = v.where(F.col(c).isNotNull()).groupBy(c).count().where("count >= 2").select(c)
        seen = _coded(v.join(usual, c, "left_semi"), c)
        if len(usual.limit(2).collect()) == 2:
            break
    b = linear.probe(seen, id_, emb, "_code").select("id", "y", F.size("scores").alias("k"), F.posexplode("scores").alias("cls", "s"))
    return cut(b.where("k > 2 or cls = 1"))


def leakage_margin(scores: DataFrame, batch: DataFrame, group: str | None = None, n: int = resample.DRAWS) -> DataFrame:
    """One row: outcome (area), batch (mean area over classes), margin with lo and hi of paired replicates, p of each and q over the three.

    scores: id, y, score and the group the labels are shuffled within; batch: from batch_scores. The margin's p is the
    share of shuffled outcomes that lie as far above the batch's area. A replicate without one of the batch's classes has no area.
    """
    own = (F.col("y") == F.col("cls")).cast("int")
    macro = F.when(F.count("auc") == F.count("*"), F.avg("auc"))
    outcome = resample.bootstrap_auc(scores, "id", "score", F.col("y"), n, observed=True).select("rep", F.col("auc").alias("a"))
    both = cut(outcome.join(resample.bootstrap_auc(batch, "id", "s", own, n, ["cls"], observed=True).groupBy("rep").agg(macro.alias("b")), "rep").withColumn("m", F.col("a") - F.col("b")))
    seen = both.where("rep = -1")
    x = beside(seen.agg(F.max("a").alias("outcome"), F.max("b").alias("batch"), F.max("m").alias("margin")), resample.interval(both.where("rep >= 0"), "m"))
    null_a, null_b = resample.permuted_auc(scores, "id", "score", F.col("y"), group, n), resample.permuted_macro(batch, n)
    nulls = beside(null_a.select(F.lit("a").alias("of"), "auc").unionByName(null_b.select(F.lit("b").alias("of"), "auc")), x.select("outcome", "batch", "margin"))
    hit = lambda of, c: (1 + F.coalesce(F.sum(((F.col("of") == of) & c).cast("int")), F.lit(0))) / F.lit(n + 1)
    p = nulls.agg(hit("a", F.col("auc") >= F.col("outcome") - 1e-12).alias("outcome_p"), hit("b", F.col("auc") >= F.col("batch") - 1e-12).alias("batch_p"), hit("a", F.col("auc") - F.col("batch") >= F.col("margin") - 1e-12).alias("margin_p"))
    x, ps = beside(x, p), ["outcome_p", "batch_p", "margin_p"]
    # step-up over three values: each value's least p * 3 / rank among those not below it
    ranked = F.array_sort(F.array(*ps))
    q = lambda c: F.array_min(F.transform(F.filter(F.arrays_zip(ranked.alias("p"), F.array(*(F.lit(i) for i in (1, 2, 3))).alias("i")), lambda z: z["p"] >= F.col(c)), lambda z: F.least(z["p"] * 3 / z["i"], F.lit(1.0))))
    return x.withColumns({c.replace("_p", "_q"): q(c) for c in ps})


def batch_test(margin: DataFrame) -> DataFrame:
    """key, result, value: the margin decides, and that its interval is above 0."""
    m = F.col("margin")
    return margin.select(F.lit("batch").alias("key"), F.when(m.isNull(), "na").when(m <= 0, "fail").when(F.col("lo") > 0, "pass").otherwise("weak").alias("result"), m.alias("value"))


def _coded(df: DataFrame, column: str) -> DataFrame:
    codes = ranks.serial(df.select(column).distinct(), column, "_k").select(column, (F.col("_k") - 1).alias("_code"))
    return df.join(codes.where(F.col(column).isNotNull()), column)


def biomarker_test(scores: DataFrame, markers: DataFrame, order: list[str]) -> DataFrame:
    """Correlation of the score with the first marker that has 20 pairs; its interval's lower end decides."""
    j = scores.join(markers.withColumnRenamed(markers.columns[0], "id"), "id")
    out = None
    for i, m in enumerate(order):
        r = statistics.pearson(j, "score", m).select(F.lit(i).alias("i"), F.lit(m).alias("marker"), "n", "r", "lo")
        out = r if out is None else out.unionByName(r)
    best = out.agg(F.min_by(F.struct("r", "lo"), F.when(F.col("r").isNotNull(), F.col("i"))).alias("x"))
    return best.select(F.lit("biomarker").alias("key"), F.when(F.col("x.lo").isNull(), "na").when(F.col("x.lo") >= 0.12, "pass").when(F.col("x.lo") > 0, "weak").otherwise("fail").alias("result"), F.col("x.r").alias("value"))


def brain_age_test(df: DataFrame, id_: str, emb: str, y: str, group: str, before: DataFrame) -> DataFrame:
    """Age predicted from the embedding by ridge regression on controls; is the signal more than the gap to real age?"""
    cn = df.where("dx = 'CN'").select(F.col(id_).alias("id"), number("age").alias("age"), F.col(emb).cast("array<double>").alias("e")).where("age is not null and e is not null")
    s = cn.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("w"), F.stddev_pop("age").alias("s")).first()
    na = df.sparkSession.range(1).select(F.lit("brain_age").alias("key"), F.lit("na").alias("result"), F.lit(None).cast("double").alias("value"))
    if s["n"] < 8 or not s["s"]:
        return na
    f = linear.folds(cn.select("id", F.concat("e", F.array("age")).alias("x"), F.array().cast("array<double>").alias("c"), F.lit(0).alias("y")), "id", "y", None, min(5, s["n"] // 2))
    r2, w, _, at, _ = linear.ridge_r2(cut(f), s["w"], min(5, s["n"] // 2), np.logspace(1, 5, 20))
    if r2 < 0.1:
        return na
    pred = at + F.aggregate(F.zip_with(F.col(emb).cast("array<double>"), F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    g = df.withColumn("_gap", F.coalesce(pred - number("age"), F.lit(0.0)))
    return covariate_test(g, id_, emb, y, group, ["_gap"], before).withColumn("key", F.lit("brain_age"))


def replication_test(scores: DataFrame, site: str = "site", least: int = 40, n: int = resample.DRAWS) -> DataFrame:
    """The area on the smallest sites, pooled until they hold ``least`` rows and both classes; its interval's lower end decides.

    The test isn't made where no pool gets there, or the sites left have under six rows or one class.
    """
    v = scores.where(F.col(site).isNotNull() & F.col("score").isNotNull())
    c = v.groupBy(site).agg(F.count("*").alias("c"), F.sum("y").alias("p")).withColumn("_all", F.lit(0))
    c, order = blocked(c, ["_all"], F.col("c")), [F.col("c"), F.col(site)]
    c = running(running(c, ["_all"], order, F.col("c"), "upto"), ["_all"], order, F.col("p"), "ones")
    c = beside(c, v.agg(F.count("*").alias("rows"), F.sum("y").alias("all_ones")))
    left, left_ones = F.col("rows") - F.col("upto"), F.col("all_ones") - F.col("ones")
    enough = (F.col("upto") >= least) & F.col("ones").between(1, F.col("upto") - 1) & (left >= 6) & left_ones.between(1, left - 1)
    last = c.where(enough).agg(F.min(F.struct(*order)).alias("last"))
    pool = cut(v.join(beside(c, last).where(F.struct(*order) <= F.col("last")).select(site), site, "left_semi"))
    drawn = cut(resample.bootstrap_auc(pool, "id", "score", F.col("y"), n, observed=True))
    x = beside(drawn.where("rep = -1").agg(*(F.max(k).alias(k) for k in ("pos", "neg", "auc"))), resample.interval(drawn.where("rep >= 0"), "auc").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")))
    ok = F.col("auc").isNotNull() & F.col("lo").isNotNull() & ~((F.col("hi") - F.col("lo") < 0.02) & (F.col("pos") + F.col("neg") < 12))
    return x.select(F.lit("replication").alias("key"), F.when(~ok, "na").when(F.col("lo") >= 0.65, "pass").when(F.col("lo") > 0.5, "weak").otherwise("fail").alias("result"), F.col("auc").alias("value"))


def verdict(tests: DataFrame) -> DataFrame:
    """One row: score (half-even, of the tests made), verdict, promoted; capped at 84 with a test missing, at 39 with a batch failure."""
    m = lambda d: F.create_map(*(F.lit(x) for k, v in d.items() for x in (k, v)))
    t = tests.select("key", "result", F.try_element_at(m(WEIGHTS), F.col("key")).alias("w"), F.try_element_at(m(CREDIT), F.col("result")).alias("c"))
    a = t.agg(F.sum(F.when(F.col("c").isNotNull(), F.col("w") * F.col("c"))).alias("got"), F.sum(F.when(F.col("c").isNotNull(), F.col("w"))).alias("of"), F.max((F.col("result") == "na").cast("int")).alias("na"), F.max(((F.col("key") == "batch") & (F.col("result") == "fail")).cast("int")).alias("leak"), F.max(F.when(F.col("key") == "biomarker", F.col("result"))).alias("bio"), F.max(F.when(F.col("key") == "replication", F.col("result"))).alias("rep"), F.max(F.when(F.col("key") == "batch", F.col("result"))).alias("bat"))
    raw = F.coalesce(F.bround(100 * F.col("got") / F.col("of"), 0), F.lit(0.0))
    raw = F.when((F.col("na") == 1) & (raw >= 85), 84.0).otherwise(raw)
    a = a.withColumn("score", F.when(F.col("leak") == 1, F.least(raw, F.lit(39.0))).otherwise(raw).cast("int"))
    v = F.lit(BANDS[-1][1])
    for at, name in reversed(BANDS[:-1]):
        v = F.when(F.col("score") >= at, name).otherwise(v)
    backed = F.col("bio").isin("pass", "weak") | ((F.col("bio") == "na") & (F.col("rep") == "pass") & (F.col("bat") == "pass"))
    return a.select("score", v.alias("verdict"), ((F.col("score") >= 70) & F.coalesce(backed, F.lit(False))).alias("promoted"))


def leaderboard(scores: DataFrame, batches: list[str], numbers: list[str]) -> DataFrame:
    """confound, kind, share: how much of the score's variance each confound holds, from the largest."""
    out = None
    for c in batches:
        r = statistics.eta_squared(scores, c, "score").select(F.lit(c).alias("confound"), F.lit("eta2").alias("kind"), F.col("eta2").alias("share"))
        out = r if out is None else out.unionByName(r)
    for c in numbers:
        r = statistics.pearson(scores, c, "score").select(F.lit(c).alias("confound"), F.lit("r2").alias("kind"), F.col("r2").alias("share"))
        out = r if out is None else out.unionByName(r)
    return out.orderBy(F.col("share").desc_nulls_last(), "confound")


def referee(df: DataFrame, id_: str, emb: str, y: str, site: str, batch: str, covariates: list[str], markers: list[str], reps: int = REPEATS, n: int = resample.DRAWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tests, verdict, effect) of one outcome; df has dx, age and site for the tests that need them. reps and n are the repeats of the folds and the draws."""
    effect, scores = naive_effect(df, id_, emb, y, site, reps, n)
    effect = cut(effect)
    tests = covariate_test(df, id_, emb, y, site, covariates, effect)
    for t in (batch_test(leakage_margin(scores, batch_scores(df, id_, emb, batch, site), "grp", n)), brain_age_test(df, id_, emb, y, site, effect), biomarker_test(scores, df.select(F.col(id_).cast("string").alias("id"), *markers), markers), replication_test(scores, n=n)):
        tests = tests.unionByName(t)
    tests = cut(tests)
    return tests, verdict(tests), effect


def rung(tests: DataFrame, decided: DataFrame, effect: DataFrame, stability: float | None = None, external: bool = False) -> DataFrame:
    """One row, rung: the highest of RUNGS whose evidence, and that of all below it, is there.

    The area is over one half; it is 0.55 or more, or with a stability given that is 0.6 or more; of covariates,
    batch and brain age none failed and one held; the biomarker passed and the claim is promoted; the
    replication passed and ``external`` says that it was made on another cohort. Missing tests neither help nor harm.
    """
    how = lambda *keys, of: F.coalesce(F.max((F.col("key").isin(*keys) & F.col("result").isin(*of)).cast("int")) == 1, F.lit(False))
    confounds = ("covariates", "batch", "brain_age")
    t = tests.agg(how(*confounds, of=["fail"]).alias("sunk"), how(*confounds, of=["pass", "weak", "partial"]).alias("held"), how("biomarker", of=["pass"]).alias("anchored"), how("replication", of=["pass"]).alias("again"))
    x = beside(beside(t, decided.select("promoted")), effect.select("auc"))
    steady = F.lit(stability >= 0.6) if stability is not None else F.col("auc") >= 0.55
    steps = [F.col("auc") > 0.5, steady, F.col("held") & ~F.col("sunk"), F.col("anchored") & F.col("promoted"), F.col("again") & F.lit(external)]
    so_far, level = F.lit(True), F.lit(0)
    for s in steps:
        so_far = so_far & F.coalesce(s, F.lit(False))
        level = level + so_far.cast("int")
    return x.select(F.array(*map(F.lit, RUNGS))[F.greatest(level, F.lit(1)) - 1].alias("rung"))


def batch_areas(df: DataFrame, id_: str, emb: str, columns: list[str]) -> DataFrame:
    """column, classes, n, auc: how well the embedding tells each column's classes, one against the rest, mean over classes.

    Classes under 5 rows are left out, as they can't be in all folds.
    """
    out = None
    for c in columns:
        big = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count >= 5").select(c)
        o = linear.probe(_coded(df.join(big, c, "left_semi"), c), id_, emb, "_code")
        s = o.select("id", "y", F.posexplode("scores").alias("cls", "s"))
        a = ranks.rank_auc(s, ["cls"], "s", (F.col("y") == F.col("cls")).cast("int"))
        r = a.agg(F.count("*").alias("classes"), F.max(F.col("pos") + F.col("neg")).alias("n"), F.avg("auc").alias("auc")).select(F.lit(c).alias("column"), "classes", "n", "auc")
        out = r if out is None else out.unionByName(r)
    return out


def seed_sweep(df: DataFrame, seeds: list[int], id_: str, emb: str, y: str, site: str, batch: str, covariates: list[str], markers: list[str], reps: int = REPEATS, n: int = resample.DRAWS) -> tuple[DataFrame, DataFrame]:
    """(seed, score, verdict, promoted; one row of the commonest verdict, flip_rate and promotion_rate).

    A seed is mixed into the ids and site names that hashes and ties go by, so folds, replicates and
    permutations are drawn anew. Of equally frequent verdicts the first by name counts.
    """
    out = None
    for s in seeds:
        mix = lambda c: F.when(c.isNotNull(), F.md5(F.concat_ws("/", F.lit(str(s)), c.cast("string"))))  # noqa: E731, B023
        _, v, _ = referee(df.withColumns({id_: mix(F.col(id_)), site: mix(F.col(site))}), id_, emb, y, site, batch, covariates, markers, reps, n)
        v = v.select(F.lit(s).alias("seed"), "score", "verdict", "promoted")
        out = v if out is None else out.unionByName(v)
    out = cut(out)
    by = out.groupBy("verdict").agg(F.count("*").alias("c"))
    most = by.agg(F.min_by("verdict", F.struct((-F.col("c")).alias("c"), "verdict")).alias("modal"), F.max("c").alias("c"), F.sum("c").alias("n"))
    return out, beside(most, out.agg(F.avg(F.col("promoted").cast("double")).alias("promotion_rate"))).select("modal", (1 - F.col("c") / F.col("n")).alias("flip_rate"), "promotion_rate")
