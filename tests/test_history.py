"""Satellites, views and blocks of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import history, keyblocks
from siftline.session import cut


def brute(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        at = {}
        for k, t, s in rows:
            if k == key and t is not None:
                at[t] = s
        last = object()
        for t in sorted(at):
            if at[t] != last:
                out.append((key, t, at[t]))
                last = at[t]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10**9, 20])
def test_satellite_as_brute_force(spark, hot, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), t if rnd.random() > 0.05 else None, rnd.choice(["a", "b", None])) for t in range(300)]
    rows += rows[:50]
    monkeypatch.setattr(history, "blocked", lambda *a, **k: keyblocks.blocked(*a, **(k | {"min_rows": hot})))
    df = spark.createDataFrame(rows, "k int, t int, s string").withColumn("hash_diff_", F.lit(1))
    sat = history.satellite(df, "k", "t", ["s"])
    want = brute(rows)
    assert sorted((tuple(r)[:3] for r in sat.collect()), key=str) == want
    view = {(r["k"], r["valid_from"]): (r["valid_to"], r["is_current"]) for r in history.version_view(sat, "k").collect()}
    for k in (1, 2, 3):
        times = [t for e, t, _ in sorted(want, key=lambda x: (x[0], x[1])) if e == k]
        assert [view[k, t] for t in times] == [(b, False) for b in times[1:]] + [(None, True)]


def versions(spark, batches, tie=None):
    """View of a satellite that the batches were appended to one after another."""
    sat = seen = None
    for rows in batches:
        df = spark.createDataFrame(rows, "k string, t int, s string, i int")
        if sat is None:
            sat, seen = history.satellite(df, "k", "t", ["s"], tie), history.track(df, "k", "t", ["s"], tie)
        else:
            add, more = history.append_snapshot(sat, seen, df, "k", "t", ["s"], tie)
            sat, seen = cut(sat.unionByName(add)), cut(seen.unionByName(more))
    return sorted((tuple(r[c] for c in ("k", "valid_from", "s", "valid_to")) for r in history.version_view(sat, "k").collect()), key=str)


def test_append_of_late_records(spark):
    # A confirmed at 4, but not stored, comes back after a late C at 3
    assert versions(spark, [[("x", 1, "A", 0), ("x", 4, "A", 0)], [("x", 3, "C", 0)]]) == [("x", 1, "A", 3), ("x", 3, "C", 4), ("x", 4, "A", None)]
    # a stored version becomes superfluous by a late record of the same state before it
    assert versions(spark, [[("x", 1, "A", 0), ("x", 5, "B", 0)], [("x", 3, "B", 0), ("y", 1, None, 0), (None, 1, "A", 0)]]) == [("x", 1, "A", 3), ("x", 3, "B", None), ("y", 1, None, None)]
    # a record of a stored time that decides by tie, and one that doesn't
    tie = [F.col("i")]
    assert versions(spark, [[("x", 1, "A", 1), ("x", 5, "B", 1)], [("x", 5, "A", 2)], [("x", 5, "C", 0), ("x", 1, "D", 2)]], tie) == [("x", 1, "D", 5), ("x", 5, "A", None)]
    old = spark.createDataFrame([], "k string, t int, s string")
    assert history.satellite(old, "k", "t", ["s"]).count() == 0


@pytest.mark.parametrize("hot", [10**9, 6])
def test_random_late_batches_equal_a_rebuild(spark, hot, monkeypatch):
    monkeypatch.setattr(history, "blocked", lambda *a, **k: keyblocks.blocked(*a, **(k | {"min_rows": hot})))
    rnd = random.Random(hot)
    rows = [(rnd.choice("xxxy"), rnd.randint(0, 40), rnd.choice(["a", "b", None]), i) for i in range(120)]
    rnd.shuffle(rows)
    at, tie = [0, 40, 75, 120], [F.col("i")]
    assert versions(spark, [rows[a:b] for a, b in zip(at, at[1:])], tie) == versions(spark, [rows], tie)


def test_change_rates(spark):
    df = spark.createDataFrame([(1, t, t, t // 10, "k") for t in range(40)], "k int, t int, fast int, slow int, fixed string")
    assert history.split_by_change_rate(df, "k", "t", ["fast", "slow", "fixed"]) == (["fast"], ["slow", "fixed"])


@pytest.mark.parametrize("hot", [10**9, 25])
def test_running(spark, hot):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.randint(0, 60), i, rnd.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    b = keyblocks.blocked(df, ["k"], F.col("o"), min_rows=hot)
    got = keyblocks.running(b, ["k"], [F.col("o"), F.col("i")], F.col("v"), "s")
    got = keyblocks.running(got, ["k"], [F.col("o"), F.col("i")], F.col("v"), "before", itself=False)
    got = {r["i"]: (r["s"], r["before"], r["lo"]) for r in keyblocks.running(got, ["k"], [F.col("o"), F.col("i")], F.col("v"), "lo", "min").collect()}
    for k, o, i, v in rows:
        up = [x[3] for x in rows if x[0] == k and (x[1], x[2]) <= (o, i)]
        assert got[i] == (sum(up), sum(up) - v if len(up) > 1 else None, min(up))
    assert (b.select("_blk").distinct().count() > 2) == (hot < 100)


def test_blocks_of_many_keys_and_of_texts_with_a_long_prefix(spark):
    """600 large keys, and one key of ids that share their first 12 bytes: every block is near the size asked for."""
    many = spark.range(60_000).select((F.col("id") % 600).alias("k"), F.col("id").alias("o"))
    texts = spark.range(40_000).select(F.lit("x").alias("k"), F.format_string("subject_0000%08d", "id").alias("o"))
    for df, rows, target in ((many, 60_000, 30), (texts, 40_000, 1000)):
        b = keyblocks.blocked(df, ["k"], F.col("o"), min_rows=target)
        sizes = b.groupBy("k", "_blk").agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi"))
        r = sizes.agg(F.max("n"), F.count("*"), F.sum("n")).first()
        assert r[0] < 3.5 * target and r[1] > rows / target / 2 and r[2] == rows
        assert sizes.alias("a").join(sizes.alias("b"), "k").where("a._blk < b._blk and a.hi >= b.lo").count() == 0
    one = keyblocks.running(keyblocks.blocked(texts, ["k"], F.col("o"), min_rows=1000), ["k"], [F.col("o")], F.lit(1), "i")
    assert one.where("i <> cast(substring(o, 13) as bigint) + 1").count() == 0
    few = keyblocks.blocked(texts, ["k"], F.col("o"), min_rows=10, most_blocks=4)
    assert few.select("_blk").distinct().count() <= 8
