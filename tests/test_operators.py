"""Operators without SQL, against numpy or exact results."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import clusters, graphs, harmonize, ledger, linear, ranks, resample, statistics
from siftline.operators.components import components
from siftline.session import cut


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 1), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and b is not None:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a is not None and b is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_probe_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, d = 240, 4
    x, c = rng.normal(size=(n, d)), rng.normal(size=n)
    x[:, 0] += c
    y = (x @ [1, -0.5, 0, 0] + c + rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), float(c[i]), f"s{i % 9}") for i in range(n)], "i int, x array<double>, y int, c double, g string")
    v = df.select(F.col("i").cast("string").alias("id"), "x", "y", F.col("g").alias("grp"), F.array("c").alias("c"))
    f = cut(linear.folds(v, "id", "y", "grp", 4))
    fold = {r["id"]: r["fold"][0] for r in f.collect()}
    groups = {}
    for i in range(n):
        groups.setdefault(f"s{i % 9}", set()).add(fold[str(i)])
    assert all(len(s) == 1 for s in groups.values()) and len(set(fold.values())) == 4
    m = linear.fit_logistic(f, d, 1, 4, 1, [1])
    got = {r["id"]: r["p"][0] for r in linear.out_of_fold(f, m, d, 1, "id string, y int, grp string").collect()}
    fo = np.array([fold[str(i)] for i in range(n)])
    for j in range(4):
        tr = fo != j
        a = np.column_stack([np.ones(n), c])
        b = np.linalg.lstsq(a[tr], x[tr], rcond=None)[0]
        r = x - a @ b
        z = np.column_stack([np.ones(n), r / r[tr].std(0)])
        w = np.where(y == 1, tr.sum() / (2 * y[tr].sum()), tr.sum() / (2 * (1 - y[tr]).sum()))
        beta = np.zeros(d + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[tr] @ beta))
            h = z[tr].T @ (z[tr] * (w[tr] * p * (1 - p))[:, None]) + np.diag([0] + [1] * d)
            beta -= np.linalg.solve(h, z[tr].T @ (w[tr] * (p - y[tr])) + np.array([0] + [1] * d) * beta)
        want = 1 / (1 + np.exp(-z @ beta))
        assert all(abs(got[str(i)] - want[i]) < 1e-5 for i in np.flatnonzero(~tr))


def test_probe_cases(spark):
    rows = [(i, [float(i), float("nan") if i % 7 == 0 else 1.0], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, x array<double>, y int")
    assert linear.probe(df, "i", "x", "y").where("score is not null").count() == 0
    two = df.withColumn("y", (F.col("i") > 9).cast("int"))
    o = linear.probe(two, "i", "x", "y")
    assert ranks.rank_auc(o, [], "score", F.col("y")).first()["auc"] == 1.0
    assert linear.probe(df.limit(0), "i", "x", "y").count() == 0


def test_ridge_is_least_squares_for_small_alpha(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [2, 0, -1] + 5 + rng.normal(size=200) * 0.1
    v = spark.createDataFrame([(str(i), [*map(float, x[i]), float(y[i])], 0) for i in range(200)], "id string, x array<double>, y int").withColumn("c", F.array().cast("array<double>"))
    r2, w, _, at, _ = linear.ridge_r2(cut(linear.folds(v, "id", "y", None, 5)), 3, 5, np.array([1e-6, 1e6]))
    assert r2 > 0.99 and np.allclose(w, [2, 0, -1], atol=0.05) and abs(at - 5) < 0.05


def test_auc_and_delong(spark):
    rng = np.random.default_rng(4)
    y, a, b = rng.integers(0, 2, 150), rng.integers(0, 30, 150) / 10, rng.normal(size=150)
    a = a + y
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(150)], "i int, y int, a double, b double")
    want = np.mean([(p > q) + 0.5 * (p == q) for p in a[y == 1] for q in a[y == 0]])
    assert ranks.rank_auc(df, [], "a", F.col("y")).first()["auc"] == pytest.approx(want)
    one = df.where("y = 1")
    assert ranks.rank_auc(one, [], "a", F.col("y")).first()["auc"] is None
    d = resample.delong(df.withColumn("k", F.lit(0)), ["k"], F.col("y"), "a", "b").first()
    assert d["auc_a"] == pytest.approx(want) and d["z"] > 2


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.04, 1.0]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(p)], "i int, k string, p double")
    got = {r["i"]: r["q"] for r in ranks.benjamini_hochberg(df, ["k"], "p").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    q, low = {}, 1.0
    for n in range(len(known), 0, -1):
        low = min(low, known[n - 1][0] * 6 / n)
        q[known[n - 1][1]] = low
    assert got[4] is None and all(got[i] == pytest.approx(v) for i, v in q.items())


def test_over_representation(spark):
    rng = random.Random(5)
    sets = {f"s{k}": set(rng.sample(range(60), 5 + k)) for k in range(8)}
    query = set(rng.sample(range(70), 15))
    rows = [(s, i) for s, items in sets.items() for i in items]
    got = {r["set_id"]: r for r in graphs.over_representation(spark.createDataFrame(rows + rows[:9], "set_id string, item int"), spark.createDataFrame([(i,) for i in query], "item int")).collect()}
    u = set().union(*sets.values()) | query
    for s, items in sets.items():
        k = len(items & query)
        if not k:
            assert s not in got
            continue
        p = sum(math.comb(len(items), i) * math.comb(len(u) - len(items), len(query) - i) for i in range(k, min(len(items), len(query)) + 1)) / math.comb(len(u), len(query))
        assert got[s]["p"] == pytest.approx(p, rel=1e-8) and got[s]["q"] >= got[s]["p"] - 1e-15


def test_walks(spark):
    rng = np.random.default_rng(6)
    e = [(i, j, float(rng.integers(1, 9))) for i, j in itertools.combinations(range(14), 2) if rng.random() < 0.3] + [(3, 3, 5.0)]
    a = np.zeros((14, 14))
    for i, j, w in e:
        if i != j:
            a[i, j] = a[j, i] = w
    deg = np.where(a.sum(1) > 0, a.sum(1), 1)
    w = a / np.sqrt(np.outer(deg, deg))
    s = np.zeros(14)
    s[[0, 4]] = 0.5
    edges = cut(graphs.undirected(spark.createDataFrame(e, "a int, b int, w double"), "a", "b", "w"))
    seeds = spark.createDataFrame([(0,), (4,), (99,)], "n int")
    got = {r["node"]: r["score"] for r in graphs.walk_with_restart(edges, seeds).collect()}
    want = 0.5 * np.linalg.solve(np.eye(14) - 0.5 * w, s)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got)
    heat = {r["node"]: r["score"] for r in graphs.heat_diffusion(edges, seeds).collect()}
    val, vec = np.linalg.eigh(np.eye(14) - w)
    want = vec @ (np.exp(-0.5 * val) * (vec.T @ s))
    assert all(abs(heat[i] - want[i]) < 1e-6 for i in heat)


def test_combat(spark):
    rng = np.random.default_rng(7)
    n, d = 600, 5
    b, age = rng.integers(0, 4, n), rng.normal(70, 8, n)
    x = rng.normal(size=(n, d)) * (1 + b[:, None] * 0.5) + b[:, None] * 2 + 0.1 * age[:, None]
    rows = [(str(i), x[i].tolist(), f"b{b[i]}" if i else None, float(age[i])) for i in range(n)] + [("z", None, "b0", 1.0)]
    df = spark.createDataFrame(rows, "id string, e array<double>, b string, age double")
    h = harmonize.combat(df, "id", "e", "b", ["age"])
    assert h.count() == n + 1 and h.where("id = 'z'").first()["e"] is None
    got = {r["id"]: r["e"] for r in h.where("e is not null").collect()}
    y = np.array([got[str(i)] for i in range(n)])
    res = y - np.column_stack([np.ones(n), age]) @ np.linalg.lstsq(np.column_stack([np.ones(n), age]), y, rcond=None)[0]
    before = np.ptp([x[b == k].mean() for k in range(4)])
    assert np.ptp([res[b == k].mean() for k in range(4)]) < 0.05 * before
    sd = [res[b == k].std() for k in range(4)]
    assert max(sd) / min(sd) < 1.15
    assert abs(np.polyfit(age, y.mean(1), 1)[0] - 0.1) < 0.03


def test_clusters(spark):
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) * 0.4 + np.array([[0, 0, 0, 0], [5, 5, 0, 0], [0, 5, 5, 5]])[truth]
    df = spark.createDataFrame([(i, x[i].tolist(), int(truth[i])) for i in range(300)], "i int, x array<double>, t int")
    z, dims = clusters.reduced(df, "i", "x")
    k, centres, lab = clusters.choose_k(z, dims, [2, 3, 4, 5])
    both = lab.join(df.select(F.col("i").cast("string").alias("id"), "t"), "id")
    assert k == 3 and statistics.adjusted_rand(both, "cluster", "t").first()["ari"] > 0.95
    assert min(clusters.stability(z, dims, centres, 8)) > 0.7
    m = clusters.mixture(z, dims, [1, 2, 3, 5])
    assert min(m, key=lambda q: m[q][3]) == 3
    assert clusters.reduced(df.limit(0), "i", "x")[1] == 0


def test_ledger_and_composite(spark):
    led = spark.createDataFrame([("a", True, 5.0), ("a", False, 0.1), ("b", True, None), (None, True, 1.0)], "arm string, success boolean, effect double")
    assert {r["arm"]: (r["alpha"], r["beta"], r["experiments"]) for r in ledger.posterior(led).collect()} == {"a": (4.0, 2.5, 2), "b": (2.5, 2.0, 1)}
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 0.5, 1.0)], "i int, a double, b double")
    got = {r["i"]: r["score"] for r in graphs.composite(df, {"a": 0.25, "b": 0.75}).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.875}


def test_statistics_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", None, float("nan"))], "g string, x double, y double")
    assert statistics.eta_squared(df, "g", "x").first()["eta2"] is None
    assert statistics.pearson(df, "x", "y").first()["r"] is None
    assert statistics.cohens_d(df, F.col("g") == "a", "x").first()["d"] is None
