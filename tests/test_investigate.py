"""Cards, rungs, batches and shared information, on small fixtures."""

import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from siftline.operators import referee, statistics
from siftline.plans.investigate import QUERIES, investigate, prepared


def climbed(spark, tests, promoted, auc, **more):
    t = spark.createDataFrame(list(tests.items()), "key string, result string")
    return referee.rung(t, spark.createDataFrame([(promoted,)], "promoted boolean"), spark.createDataFrame([(auc,)], "auc double"), **more).first()["rung"]


def test_rungs(spark):
    good = dict.fromkeys(["covariates", "batch", "brain_age", "biomarker", "replication"], "pass")
    assert climbed(spark, good, True, 0.9) == "severity_anchored"
    assert climbed(spark, good, True, 0.9, external=True) == "externally_replicated"
    assert climbed(spark, good, False, 0.9, external=True) == "confound_survivor"
    assert climbed(spark, good | {"batch": "fail"}, True, 0.9) == "stable_cluster"
    assert climbed(spark, good | {"brain_age": "na", "biomarker": "weak"}, True, 0.9) == "confound_survivor"
    assert climbed(spark, good, True, 0.9, stability=0.5) == "raw_pattern"
    assert climbed(spark, good, True, 0.4) == climbed(spark, good, True, None) == climbed(spark, {}, None, None) == "raw_pattern"
    assert climbed(spark, dict.fromkeys(good, "na"), True, 0.9) == "stable_cluster"


def information(pairs):
    """mi, nmi and ami by summing over all pairs of classes and all counts."""
    n, ca, cb, cab = len(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(pairs)
    mi = sum(c / n * math.log(n * c / (ca[a] * cb[b])) for (a, b), c in cab.items())
    mid = -sum(c / n * math.log(c / n) for s in (ca, cb) for c in s.values()) / 2
    emi = 0.0
    for x, y in product(ca.values(), cb.values()):
        for k in range(max(1, x + y - n), min(x, y) + 1):
            emi += k / n * math.log(n * k / (x * y)) * math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x)
    return mi, mi / mid, (mi - emi) / (mid - emi)


@pytest.mark.parametrize("n, f", [(60, lambda i: i % 3), (400, lambda i: i * i % 7), (90, lambda i: i)])
def test_mutual_information(spark, n, f):
    pairs = [(i % 5, f(i)) for i in range(n)]
    df = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a int, b int")
    got = statistics.mutual_information(df, "a", "b").first()
    assert got["n"] == n
    if n != 90:
        assert [got[c] for c in ("mi", "nmi", "ami")] == pytest.approx(information(pairs), abs=1e-9)
    same = statistics.mutual_information(df, "a", "a").first()
    assert (same["nmi"], same["ami"]) == pytest.approx((1, 1))


def test_mutual_information_of_nothing(spark):
    none = statistics.mutual_information(spark.createDataFrame([], "a int, b int"), "a", "b").first()
    assert none["n"] is None and none["mi"] is None
    one = statistics.mutual_information(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b").first()
    assert (one["mi"], one["nmi"], one["ami"]) == (0, 1, 1)


def test_refused(spark, small):
    card = investigate(spark, small, "Bananas are yellow").first()
    assert card["verdict"] == "refused" and not card["promoted"] and card["auc"] is None


def test_prepared(spark):
    c = prepared(spark.createDataFrame([("a", "F", 0.5, 1.0), ("b", None, 0.1, None)], "subject_id string, sex string, etiv_z double, asf_z double"))
    rows = {r["subject_id"]: r for r in c.collect()}
    assert rows["a"]["emb"] == [0.5, 1.0] and rows["a"]["male"] == 0 and rows["b"]["male"] is None and rows["a"]["scanner"] is None


def test_batch_areas(spark):
    rows = [(str(i), [float(i % 3), float((i * 7) % 5)], f"s{i % 3}", None if i else "x") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, emb array<double>, batch string, none string")
    got = {r["column"]: r for r in referee.batch_areas(df, "id", "emb", ["batch", "none"]).collect()}
    assert got["batch"]["classes"] == 3 and got["batch"]["auc"] > 0.7
    assert got["none"]["classes"] == 0 and got["none"]["auc"] is None
    assert df.select(F.lit(1)).count() == 90


@pytest.mark.parametrize("scanners, sites", [(3, 1), (2, 1), (1, 4)])
def test_batch_leaks(spark, scanners, sites):
    """The batch, be it three scanners, two, or sites under one scanner, is told better than the outcome."""
    rows = [(str(i), [float(i % max(scanners, sites) == j) + 0.01 * ((i * 7) % 5) for j in range(4)], f"m{i % scanners}", f"s{i % sites}") for i in range(120)]
    df = spark.createDataFrame([*rows, ("rare", [0.0] * 4, "once", "once")], "id string, emb array<double>, scanner string, site string")
    scores = spark.createDataFrame([(str(i), i // 4 % 2, (i * 37 % 101) / 101 + i // 4 % 2 * 0.3) for i in range(120)], "id string, y int, score double")
    margin = referee.leakage_margin(scores, referee.batch_scores(df, "id", "emb", "scanner", "site"), None, 50).first()
    got = referee.batch_test(spark.createDataFrame([margin])).first()
    assert got["result"] == "fail" and -0.5 < got["value"] < 0
    # the batch is beyond chance, and so is the outcome; q is never below p
    assert margin["batch_p"] < 0.05 and all(0 < margin[f"{k}_p"] <= margin[f"{k}_q"] <= 1 for k in ("outcome", "batch", "margin"))


def test_replication_pools_both_classes(spark):
    """Two small sites hold one class; the pool goes on to the third and leaves the large one out."""
    sizes = {"a": (20, 0), "b": (25, 0), "c": (15, 15), "d": (60, 60)}
    rows = [(f"{s}{y}{i}", y, s, y + i / 100) for s, counts in sizes.items() for y in (0, 1) for i in range(counts[y])]
    scores = spark.createDataFrame(rows, "id string, y int, site string, score double")
    got = referee.replication_test(scores, n=20).first()
    assert got["result"] == "pass" and got["value"] == 1
    assert referee.replication_test(scores.where("site <> 'd'"), n=20).first()["result"] == "na"


def test_discover_clusters_tries_two_to_six(spark, small, monkeypatch):
    class Seen(Exception):
        pass

    def choose(z, dims, ks):
        raise Seen(ks)

    monkeypatch.setattr("siftline.plans.investigate.clusters.choose_k", choose)
    with pytest.raises(Seen) as seen:
        QUERIES["discover_clusters"](spark, small)
    assert seen.value.args[0] == [2, 3, 4, 5, 6]
