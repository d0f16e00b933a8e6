"""Nearest-time pairs against brute force."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm.nearest import PairTable, XFastTries, nearest_join
from siftline.operators import keyblocks

T0 = datetime.datetime(2020, 1, 1)


def test_pair_table():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(-50, 50, (2000, 2)), axis=0)
    t = PairTable(pairs[:, 0], pairs[:, 1])
    assert (t.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert t.find(np.array([99, 0]), np.array([0, 99])).tolist() == [-1, -1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 9)), max_size=30), st.lists(st.tuples(st.integers(0, 4), st.integers(-5, 50)), max_size=20), st.sampled_from([1, 7, 1_000_000]))
def test_tries(leaves, queries, unit):
    a = np.array(leaves or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    q = np.array(queries or np.zeros((0, 2)), np.int64).reshape(-1, 2)
    t = XFastTries(a[:, 0], a[:, 0] * 0, a[:, 1] * unit, a[:, 2])
    before, after = t.around(q[:, 0], q[:, 0] * 0, q[:, 1] * unit + (unit > 1))
    for (k, x), i, j in zip(queries, before, after, strict=True):
        x = x * unit + (unit > 1)
        low = [(y * unit, -n) for e, y, n in leaves if e == k and y * unit <= x]
        high = [(y * unit, n) for e, y, n in leaves if e == k and y * unit > x]
        assert (t.time[i], -t.ids[i]) == max(low) if low else i == -1
        assert (t.time[j], t.ids[j]) == min(high) if high else j == -1


def frames(spark, left, right):
    at = lambda s: None if s is None else T0 + datetime.timedelta(seconds=s)
    a = spark.createDataFrame([(k, at(t), i, "x") for k, t, i in left], "k bigint, t timestamp, a bigint, gap string")
    b = spark.createDataFrame([(k, at(t), i, "x") for k, t, i in right], "k bigint, t timestamp, b bigint, gap string")
    return a, b


def brute(left, right, tolerance):
    out = []
    for k, t, i in left:
        near = [(abs(t - u), u, j) for e, u, j in right if t is not None and u is not None and k is not None and e == k and abs(t - u) <= tolerance]
        if near:
            out.append((i, min(near)[2]))
    return sorted(out)


@pytest.mark.parametrize("hot", [10**9, 30])
def test_join_as_brute_force(spark, hot, monkeypatch):
    """With and without a key that is cut into blocks."""
    rng = np.random.default_rng(3)
    key = lambda: 7 if rng.random() < 0.4 else int(rng.integers(0, 20))
    right = [(key(), int(rng.integers(0, 3000)), i) for i in range(400)] + [(None, 5, 9000), (7, None, 9001), (7, 100, 9002), (7, 100, 9003)]
    left = [(key(), int(rng.integers(-100, 3100)), i) for i in range(500)] + [(None, 5, 9000), (7, None, 9001), (7, 100, 9002), (7, 100, 9002)]
    from siftline.llm import nearest

    monkeypatch.setattr(nearest, "hot_splits", lambda *a, **k: keyblocks.hot_splits(*a, **(k | {"min_rows": hot})))
    got = nearest_join(*frames(spark, left, right), "k", "t", "a", "b", 60)
    assert sorted((r[0], r[1]) for r in got.collect()) == brute(left, right, 60)


def test_borders_and_empty(spark):
    a, b = frames(spark, [(1, 100, 1), (1, 0, 2), (1, 161, 3)], [(1, 90, 12), (1, 110, 11), (1, 60, 10), (1, 60, 9)])
    assert sorted(tuple(r) for r in nearest_join(a, b, "k", "t", "a", "b", 60).collect()) == [(1, 12, 10_000_000), (2, 9, 60_000_000), (3, 11, 51_000_000)]
    assert nearest_join(a.limit(0), b, "k", "t", "a", "b", 60).count() == 0
    assert nearest_join(a, b.limit(0), "k", "t", "a", "b", 60).count() == 0


@pytest.mark.parametrize("hot", [10**9, 30])
def test_text_keys_and_ids(spark, hot, monkeypatch):
    """Keys that are texts pair by equality, also where a key is cut into blocks; ids that aren't whole numbers are refused."""
    from pyspark.sql import functions as F

    from siftline.llm import nearest

    rng = np.random.default_rng(5)
    right = [(int(rng.integers(0, 5)) if rng.random() < 0.5 else 7, int(rng.integers(0, 3000)), i) for i in range(300)]
    left = [(int(rng.integers(0, 6)) if rng.random() < 0.5 else 7, int(rng.integers(-100, 3100)), i) for i in range(300)]
    monkeypatch.setattr(nearest, "hot_splits", lambda *a, **k: keyblocks.hot_splits(*a, **(k | {"min_rows": hot})))
    a, b = (d.withColumn("k", F.concat(F.lit("subject "), F.col("k").cast("string"))) for d in frames(spark, left, right))
    assert sorted((r[0], r[1]) for r in nearest_join(a, b, "k", "t", "a", "b", 60).collect()) == brute(left, right, 60)
    with pytest.raises(ValueError):
        nearest_join(a.withColumn("a", F.col("a").cast("string")), b, "k", "t", "a", "b", 60)


def chunks(right, left, size):
    """Rows as they come to a task: entity by entity, leaves first, in batches of size rows."""
    cols = np.concatenate([np.stack([2 * x[0] + side, x[0], 0 * x[0], x[1], x[2]]) for side, x in ((0, right), (1, left))], axis=1)
    cols = cols[:, np.argsort(cols[0], kind="stable")]
    for i in range(0, cols.shape[1], size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=["place", "k", "blk", "t", "id"])


def test_memory_of_a_large_partition(monkeypatch):
    """Tries in memory follow CHUNK, not the partition: 300,000 rows of 20,000 entities never stand in them at once."""
    from siftline.llm import nearest

    sizes = []

    class Watched(XFastTries):
        def __init__(self, *a):
            super().__init__(*a)
            sizes.append(len(self.time))

    monkeypatch.setattr(nearest, "XFastTries", Watched)
    n, m, rng = 240_000, 60_000, np.random.default_rng(8)
    right = np.stack([rng.integers(0, 20_000, n), rng.integers(0, 10**9, n), np.arange(n)])
    left = np.stack([rng.integers(0, 20_000, m), rng.integers(0, 10**9, m), np.arange(m)])
    out = pa.Table.from_batches(nearest._pair(10**9)(chunks(right, left, 10_000)))
    assert sum(sizes) >= n * 0.99
    assert max(sizes) <= 60_000
    order = np.lexsort((right[1], right[0]))
    at, want = right[0][order] * 2**40 + right[1][order], left[0] * 2**40 + left[1]
    pos = np.searchsorted(at, want)
    gaps = [np.where((p >= 0) & (p < n) & (right[0][order][np.clip(p, 0, n - 1)] == left[0]), np.abs(right[1][order][np.clip(p, 0, n - 1)] - left[1]), 2**60) for p in (pos - 1, pos)]
    gap = np.minimum(*gaps)
    assert dict(zip(out["left_id"].to_pylist(), out["gap"].to_pylist(), strict=True)) == {i: g for i, g in enumerate(gap.tolist()) if g < 2**60}


@pytest.mark.parametrize("chunk", [1, 7, 40, 10**6])
@pytest.mark.parametrize("size", [1, 10, 1000])
def test_chunks_as_brute_force(chunk, size, monkeypatch):
    """Entities that begin, go on and end anywhere in a chunk, and such without leaves or queries; repeated times stand once in memory."""
    from siftline.llm import nearest

    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    right = [(int(rng.integers(0, 6)) if rng.random() < 0.6 else 3, int(rng.integers(0, 60)), i) for i in range(150)]
    left = [(int(rng.integers(1, 8)) if rng.random() < 0.6 else 3, int(rng.integers(-5, 70)), i) for i in range(120)]
    got = [b.to_pydict() for b in nearest._pair(4)(chunks(np.array(right).T, np.array(left).T, size))]
    assert sorted((i, j) for b in got for i, j in zip(b["left_id"], b["right_id"], strict=True)) == brute(left, right, 4)


def test_join_in_small_chunks(spark, monkeypatch):
    """The order of rows that the join gives its tasks: with chunks of a few rows the pairs are the same."""
    from siftline.llm import nearest

    rng = np.random.default_rng(11)
    right = [(int(rng.integers(0, 40)), int(rng.integers(0, 900)), i) for i in range(400)]
    left = [(int(rng.integers(0, 42)), int(rng.integers(0, 900)), i) for i in range(300)]
    monkeypatch.setattr(nearest, "CHUNK", 5)
    monkeypatch.setattr(nearest, "hot_splits", lambda *a, **k: keyblocks.hot_splits(*a, **(k | {"min_rows": 12})))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = nearest_join(*frames(spark, left, right), "k", "t", "a", "b", 30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sorted((r[0], r[1]) for r in got) == brute(left, right, 30)
