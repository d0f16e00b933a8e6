"""Mixtures and splits: shares, limits and togetherness."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import mixture, splits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 1)), min_size=1, max_size=60), st.integers(0, 99))
def test_flight_keeps_sums(rows, seed):
    x, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    q = mixture.flight(x, p, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()
    assert abs(q.sum() - p.sum()) < 1e-4 and abs((q * x).sum() - (p * x).sum()) < 0.05


def test_flight_is_fair():
    x, p = np.array([5, 9, 2, 7, 7, 30, 1, 4]), np.full(8, 0.4)
    mean = np.mean([mixture.flight(x, p, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert abs(mean - 0.4).max() < 0.04


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3] if i % 17 else None, int(rng.integers(0, 300))) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.15, None), ("none", 0.05, 3)], "source string, weight double, max_repeats int")
    for block in (20_000, 40):
        got = mixture.mix(sizes, targets, block=block).toPandas()
        assert got["id"].is_unique and (got["tokens"] > 0).all()
        r = {x["source"]: x for x in mixture.reached(sizes, targets, mixture.mix(sizes, targets, block=block)).collect()}
        for s, w, k in (("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.15, 1)):
            assert abs(r[s]["share"] - w / 0.95) < 0.002 and got[got["source"] == s]["repeats"].max() <= k
        assert r["none"]["share"] == 0 and r["none"]["used"] == 0
        full = max(r.values(), key=lambda x: x["mixed"] / max(1, x["available"] * x["max_repeats"]))
        assert full["mixed"] == full["available"] * full["max_repeats"]
    assert mixture.mix(sizes.limit(0), targets).count() == 0


SHARES = [0.8, 0.1, 0.1]


def due(them, shares=SHARES):
    rows = {}
    for b in them:
        for x, n in b.profile.items():
            rows[x] = rows.get(x, 0) + n * b.components
    return {(x, k): n * s for x, n in rows.items() for k, s in enumerate(shares)}


def test_quotas_are_near():
    b = [splits.Bundle(f"{s}/{lab}", {lab: s}, n) for s, n, lab in [(1, 101, "p"), (1, 57, "q"), (3, 40, "p"), (7, 9, "q"), (50, 1, "p"), (90, 1, "q")]]
    q = splits.quotas(b, due(b), SHARES)
    assert all(sum(q[x.bundle]) == x.components for x in b)
    rows = [sum(q[x.bundle][k] * x.size for x in b) for k in range(3)]
    assert np.allclose(np.array(rows) / sum(rows), SHARES, atol=0.005)


def test_many_bundles_are_solved_fast():
    """Ten thousand bundles of different sizes and mixed labels, each split within one row of its share."""
    import time

    rng = np.random.default_rng(3)
    b = [splits.Bundle(str(i), {x: int(n) for x, n in zip("pqr", rng.integers(0, 1 + i % 40, 3), strict=True) if n} or {"p": 1}, int(rng.integers(1, 6))) for i in range(10_000)]
    began, q = time.process_time(), splits.quotas(b, due(b), SHARES)
    assert time.process_time() - began < 20
    rows = np.array([sum(q[x.bundle][k] * x.size for x in b) for k in range(3)])
    assert abs(rows - rows.sum() * np.array(SHARES)).max() <= 2
    for x in "pqr":
        own = np.array([sum(q[y.bundle][k] * y.profile.get(x, 0) for y in b) for k in range(3)])
        assert abs(own / own.sum() - SHARES).max() < 0.002


def test_flow_is_optimal():
    """Units of one size against all ways to place them."""
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(30):
        left = [(splits.Bundle(f"b{i}", {"pq"[int(rng.integers(2))]: 2}, 3), int(rng.integers(0, 3))) for i in range(4)]
        lack = {(x, k): float(rng.normal(0, 3)) for x in "pq" for k in range(3)}
        units = [b.label for b, n in left for _ in range(n)]

        def cost(way):
            out = 0.0
            for x in "pq":
                for k in range(3):
                    out += (lack[x, k] - 2 * sum(label == x and w == k for label, w in way)) ** 2
            return out + sum((sum(lack[x, k] for x in "pq") - 2 * sum(w == k for _, w in way)) ** 2 for k in range(3))

        got = splits._flow(left, lack, SHARES, 2)
        assert [sum(q) for _, q in got] == [n for _, n in left]
        best = min(cost(list(zip(units, way, strict=True))) for way in itertools.product(range(3), repeat=len(units)))
        assert cost([(b.label, k) for b, q in got for k, n in enumerate(q) for _ in range(n)]) == pytest.approx(best)


def test_assign(spark):
    rng = np.random.default_rng(4)
    comp = np.concatenate([np.repeat(np.arange(900), rng.integers(1, 5, 900)), np.full(700, 1000)])
    rows = [("c", f"k{c}", None if c % 5 == 0 else "ab"[int(c) % 2]) for c in comp]
    records = spark.createDataFrame(rows, "cohort string, component string, label string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0)], "split string, share double")
    for lot in (splits.LOT, 5):
        got = splits.assign_splits(records, targets, lot=lot).toPandas()
        assert got["component"].is_unique and len(got) == 901 and set(got["split"]) == {"train", "validation", "test"}
        share = got.groupby("split")["rows"].sum() / len(rows)
        assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert splits.assign_splits(records.limit(0), targets).count() == 0


def test_related_rows_share_a_split(spark, small):
    from siftline.llm import queries

    s = queries.p4_splits(spark, small)
    o = spark.read.parquet(f"{small}/oasis_longitudinal.parquet")
    assert s.where("cohort = 'oasis'").count() == o.count()
    assert s.where("subject is not null").groupBy("cohort", "subject").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_null_sides_of_references_link_nothing(spark, small, tmp_path):
    """References with a null side, however many, join no subjects; equal sides and chains of references work."""
    from siftline.llm import queries

    oasis = spark.read.parquet(f"{small}/oasis_longitudinal.parquet")
    base = oasis.where("`Subject ID` is not null").limit(1)
    ids = [("OAS2_0001", "OAS2_0001_MR1"), (" oas2-1 ", "OAS2_0001_MR2"), ("OAS2_0002", "OAS2_0002_MR1"), ("OAS2_0003", "OAS2_0003_MR1"), ("OAS2_0004", "OAS2_0004_MR1"), ("OAS2_0005", "OAS2_0005_MR1"), (None, "OAS2_0006_MR1")]
    rows = base.drop("Subject ID", "MRI ID").crossJoin(spark.createDataFrame(ids, "`Subject ID` string, `MRI ID` string"))
    rows.select(oasis.columns).write.parquet(f"{tmp_path}/oasis_longitudinal.parquet")
    refs = [(1, None, "OAS2_0002"), (2, None, "OAS2_0003"), (3, "OAS2_0004", None), (4, "OAS2_0005", None), (5, None, None), (6, "OAS2_0002", "OAS2_0002"), (7, "OAS2_0003", "OAS2_0099"), (8, "OAS2-99", "oas2_0004")]
    spark.createDataFrame(refs, "xref_id bigint, subject_a string, subject_b string").write.parquet(f"{tmp_path}/subject_xref.parquet")
    for t in ("adni_contract", "split_targets"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    assert got == {(" oas2-1 ", "OAS2_0001"), ("OAS2_0003", "OAS2_0004")}


def test_landing_is_near():
    """One or two changes bring the total to what is due where records allow it; a single record, and none, land too."""
    rng = np.random.default_rng(7)
    x = np.concatenate([[30_000], rng.integers(1, 400, 200)])
    p = np.zeros(len(x))
    p[1:120], p[0] = 1, 0.4
    due = float((p * x).sum())
    w = mixture.land(x, p, due)
    assert set(np.unique(w)) <= {0.0, 1.0} and abs((w * x).sum() - due) < 500
    assert abs((mixture.land(x[1:], p[1:], float((p[1:] * x[1:]).sum()) + 37) * x[1:]).sum() - (p[1:] * x[1:]).sum() - 37) <= 1
    assert mixture.land(np.array([5]), np.array([0.9]), 4.5).tolist() == [1.0]
    assert mixture.land(np.zeros(0), np.zeros(0), 0.0).tolist() == []
