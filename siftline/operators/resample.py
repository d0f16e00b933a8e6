"""Bootstrap intervals and permutation p-values of frozen scores; the scores are never refitted.

All replicates are drawn together, as vectors. Rows are ordered by score once, by a range partitioning, and each
task reads its rows in order; for a few hundred rows at a time it makes the matrix of rows by replicates, and what
leaves the task is one row of sums (positives, negatives, pairs won) a replicate. So nothing is repeated before a
shuffle, whatever the number of replicates, and a key or tie of any size is only a stream.

Draws are numbers from hashes, so that a task that is run again draws the same, and any engine can check them:

* bootstrap: a Poisson(1) count of each row from u = (A x + B mod P) / P, with x a 31-bit code of the row's id, A
  and B such codes of the replicate, and P = 2^31 - 1;
* permutation: within a group of n rows with k positives, each row has a rank i by hash, from 0; in a replicate
  those rows are positive for which (a i + b) mod n < k, with a prime to n. Affine maps modulo n form a group of
  permutations, so the test is exact, and each replicate keeps the group's number of positives.

Defined cases: rows with a null id, score or label are left out; a replicate with one class only has no
statistic and is left out of the interval, but counts in the p-value's denominator; an empty table gives an empty
result, or a row of nulls where one row is promised.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.keyblocks import blocked, running
from siftline.operators.ranks import hash_unit
from siftline.session import beside, cut, number

RANGE_ROWS, CHUNK, PRIME = 50_000, 256, 2**31 - 1
DRAWS = 1000


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with ``rep`` from 0."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def code(*parts: Column) -> Column:
    """A number in [0, PRIME) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % PRIME


def _codes(tag: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A (never 0) and B of each replicate."""
    h = [hashlib.md5(f"{tag}:{r}".encode()).hexdigest() for r in range(n)]
    return np.array([int(x[:8], 16) % (PRIME - 1) + 1 for x in h], np.int64), np.array([int(x[8:16], 16) % PRIME for x in h], np.int64)


def _edges(most: int = 6) -> np.ndarray:
    """Borders in [0, PRIME) of the Poisson(1) counts 1 to most."""
    return np.ceil(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)]) * PRIME).astype(np.int64)


def _poisson(n: int) -> Callable[[pd.DataFrame], np.ndarray]:
    """Rows (column _x) by replicates: how often each row is drawn."""
    a, b = _codes("b", n)
    edges = _edges()

    def weights(pdf: pd.DataFrame) -> np.ndarray:
        u = (pdf["_x"].to_numpy(np.int64)[:, None] * a + b) % PRIME
        w = np.zeros(u.shape, np.uint8)
        for e in edges:
            w += u >= e
        return w

    return weights


def _members(tag: str, n: int) -> Callable[[pd.DataFrame], np.ndarray]:
    """Rows (columns _gx: code of the group, _gn: its rows, _gl and _gk: which places to choose, _i: rank from 0) by replicates: whether the row gets a place from _gl (0 without the column) up to, not with, _gk."""
    a1, b1 = _codes(f"{tag}a", n)
    a2, b2 = _codes(f"{tag}b", n)
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def maps(x: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        if (x, size) not in known:
            if len(known) >= 1000:
                known.clear()
            a = (a1 * x + b1) % PRIME % size + 1
            while (bad := np.gcd(a, size) != 1).any():
                a[bad] += 1
            known[x, size] = a, (a2 * x + b2) % PRIME % size
        return known[x, size]

    def chosen(pdf: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(pdf), n), np.uint8)
        for (x, size), at in pdf.groupby(["_gx", "_gn"]).indices.items():
            a, b = maps(int(x), int(size))
            i = pdf["_i"].to_numpy(np.int64)[at][:, None]
            # i in two parts, so that groups of up to 10^14 rows don't overflow
            place = ((a * (i >> 16) % size * 65536 + a * (i & 65535)) + b) % size
            out[at] = place < pdf["_gk"].to_numpy(np.int64)[at][:, None]
            if "_gl" in pdf:
                out[at] &= place >= pdf["_gl"].to_numpy(np.int64)[at][:, None]
        return out

    return chosen


def _areas(rows: DataFrame, keys: list[str], n: int, draw: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], extra: list[str]) -> DataFrame:
    """keys, rep (0 to n - 1), pos, neg, auc: the area of each replicate. rows: keys, _s, and what ``draw`` needs to give (positives, negatives) by row and replicate."""
    kinds = dict(rows.dtypes)
    r = rows.select(F.to_json(F.struct(*keys) if keys else F.struct(F.lit(0).alias("_")), {"ignoreNullFields": "false"}).alias("_key"), "_s", *extra)
    r = r.repartitionByRange("_key", "_s").sortWithinPartitions("_key", "_s").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tie = None
        part = 0
        p, q, won, tp, tq = (np.zeros(n) for _ in range(5))

        def done() -> pd.DataFrame:
            return pd.DataFrame({"_key": [key], "_part": [part], "p": [p + tp], "q": [q + tq], "won": [won + tp * (q + tq / 2)]})

        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                b = batch.iloc[at : at + CHUNK]
                pos, neg = draw(b)
                ks, ss = b["_key"].to_numpy(), b["_s"].to_numpy()
                starts = np.flatnonzero(np.append(True, (ks[1:] != ks[:-1]) | (ss[1:] != ss[:-1])))
                ps, qs = np.add.reduceat(pos, starts, axis=0, dtype=float), np.add.reduceat(neg, starts, axis=0, dtype=float)
                part = int(b["_part"].iloc[0])
                for j, s in enumerate(starts):
                    if ks[s] != key:
                        if key is not None:
                            yield done()
                        key, tie = ks[s], None
                        p, q, won, tp, tq = (np.zeros(n) for _ in range(5))
                    if tie is not None and ss[s] != tie:  # rows of one score are over
                        won += tp * (q + tq / 2)
                        p += tp
                        q += tq
                        tp, tq = np.zeros(n), np.zeros(n)
                    tie = ss[s]
                    tp += ps[j]
                    tq += qs[j]
        if key is not None:
            yield done()

    sums = r.mapInPandas(run, "_key string, _part int, p array<double>, q array<double>, won array<double>")
    x = sums.select("_key", "_part", F.posexplode(F.arrays_zip("p", "q", "won")).alias("rep", "z")).select("_key", "_part", "rep", "z.*")
    # a row a task, key and replicate: the windows are as long as there are tasks
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_key", "rep").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("won", F.col("won") + F.col("p") * below).groupBy("_key", "rep").agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum("won").alias("won"))
    back = F.from_json("_key", ", ".join(f"`{k}` {kinds[k]}" for k in keys) or "_ int")
    return x.select(*(back[k].alias(k) for k in keys), "rep", "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def bootstrap_auc(df: DataFrame, id_: str, score: str, label: Column, n: int = DRAWS, keys: list[str] | None = None, observed: bool = False) -> DataFrame:
    """keys, rep, pos, neg, auc: by Poisson bootstrap; with ``observed`` also the rows as they are, as replicate -1."""
    keys, poisson = keys or [], _poisson(n)
    r = df.select(*keys, code(F.col(id_).cast("string")).alias("_x"), number(score).alias("_s"), label.cast("int").alias("_y")).where(F.col(id_).isNotNull() & F.col("_s").isNotNull() & F.col("_y").isNotNull())

    def draw(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        w, y = poisson(b), b["_y"].to_numpy(np.uint8)[:, None]
        if observed:
            w = np.hstack([np.ones((len(b), 1), np.uint8), w])
        return w * y, w * (1 - y)

    out = _areas(r, keys, n + observed, draw, ["_x", "_y"])
    return out.withColumn("rep", F.col("rep") - 1) if observed else out


def bootstrap_difference(df: DataFrame, id_: str, flag: Column, value: str, n: int = DRAWS) -> DataFrame:
    """rep, difference: mean of the flagged less mean of the other rows, by Poisson bootstrap; sums by task, nothing is ordered."""
    poisson = _poisson(n)
    r = df.select(code(F.col(id_).cast("string")).alias("_x"), number(value).alias("_v"), flag.cast("int").alias("_f")).where(F.col(id_).isNotNull() & F.col("_v").isNotNull() & F.col("_f").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((4, n))
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                b = batch.iloc[at : at + CHUNK]
                w, f, v = poisson(b).astype(float), b["_f"].to_numpy(float), b["_v"].to_numpy(float)
                s += np.stack([f @ w, (f * v) @ w, (1 - f) @ w, ((1 - f) * v) @ w])
        yield pd.DataFrame({c: [x] for c, x in zip("abcd", s, strict=True)})

    s = r.mapInPandas(run, "a array<double>, b array<double>, c array<double>, d array<double>").select(F.posexplode(F.arrays_zip("a", "b", "c", "d")).alias("rep", "z"))
    s = s.groupBy("rep").agg(*(F.sum(f"z.{c}").alias(c) for c in "abcd"))
    return s.select("rep", (F.try_divide("b", "a") - F.try_divide("d", "c")).alias("difference"))


def interval(reps: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, reps, lo, hi: exact percentiles 2.5 and 97.5 over the replicates that have a value."""
    return reps.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(F.count("*").alias("reps"), F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"))


def ranked_by_hash(df: DataFrame, keys: list[str], h: Column, tie: Column) -> DataFrame:
    """df with ``hash_rank``, its exact rank by (h in [0, 1), tie) within the key (not null), and ``hash_rows``, the key's rows.

    Keys are cut into ranges of the hash of about RANGE_ROWS rows, so that none is ordered in one task.
    """
    df = cut(df.withColumn("_h", h))
    counts = df.groupBy(*keys).agg(F.count("*").alias("hash_rows"))
    df = df.join(counts, keys).withColumn("_range", F.floor(F.col("_h") * F.ceil(F.col("hash_rows") / RANGE_ROWS)).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h", tie))
    if (counts.agg(F.max("hash_rows")).first()[0] or 0) <= RANGE_ROWS:  # one range a key: nothing to add up
        return df.withColumn("hash_rank", rank).drop("_range", "_h")
    before = df.groupBy(*keys, "_range").count()
    before = before.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return df.join(before, [*keys, "_range"]).withColumn("hash_rank", F.col("_before") + rank).drop("_before", "_range", "_h")


def _placed(df: DataFrame, tag: str, chosen: Column) -> DataFrame:
    """df (_id, _g, ...) with _gx, _gn, _gk (rows chosen of the group) and _i for ``_members``."""
    r = ranked_by_hash(df, ["_g"], hash_unit(F.col("_id").cast("string"), F.lit(tag)), F.col("_id"))
    k = df.groupBy("_g").agg(F.sum(chosen.cast("long")).alias("_gk"))
    return r.join(k, "_g").withColumns({"_gx": code(F.col("_g").cast("string")), "_gn": F.col("hash_rows"), "_i": F.col("hash_rank") - 1})


def permuted_auc(df: DataFrame, id_: str, score: str, label: Column, group: str | None, n: int = DRAWS, keys: list[str] | None = None) -> DataFrame:
    """keys, rep, auc: labels shuffled within groups (all rows are one group without), keeping each group's number of positives. With keys a group must not lie in several."""
    keys = keys or []
    v = df.select(*keys, F.col(id_).alias("_id"), number(score).alias("_s"), label.cast("int").alias("_y"), (F.coalesce(F.col(group).cast("string"), F.lit("__na__")) if group else F.lit("")).alias("_g")).where("_id is not null and _s is not null and _y is not null")
    members = _members("p", n)

    def draw(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        y = members(b)
        return y, 1 - y

    return _areas(_placed(v, "p", F.col("_y") == 1), keys, n, draw, ["_gx", "_gn", "_gk", "_i"]).select(*keys, "rep", "auc")


def permuted_macro(df: DataFrame, n: int = DRAWS) -> DataFrame:
    """rep, auc: the mean over classes of one against the rest, with the classes shuffled over all rows. df: id, y (class), cls, s (the row's score of class cls), a row for each row and class with scores."""
    one = ranked_by_hash(df.select("id", "y").distinct().withColumn("_g", F.lit("")), ["_g"], hash_unit(F.col("id"), F.lit("c")), F.col("id"))
    sizes = one.groupBy("y").agg(F.count("*").alias("_c"))
    # a row a class
    places = sizes.withColumn("_gk", F.sum("_c").over(Window.orderBy("y"))).select(F.col("y").alias("cls"), (F.col("_gk") - F.col("_c")).alias("_gl"), "_gk")
    members = _members("c", n)

    def draw(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        y = members(b)
        return y, 1 - y

    v = df.select("id", "cls", number("s").alias("_s")).where("_s is not null").join(one.select("id", (F.col("hash_rank") - 1).alias("_i"), F.col("hash_rows").alias("_gn")), "id").join(places, "cls").withColumn("_gx", F.lit(1).cast("long"))
    areas = _areas(v, ["cls"], n, draw, ["_gx", "_gn", "_gl", "_gk", "_i"])
    return areas.groupBy("rep").agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("auc"))


def p_value(reps: DataFrame, observed: DataFrame, value: str, n: int) -> DataFrame:
    """observed's one row with p = (1 + replicates at least as large) / (1 + n)."""
    x = beside(reps.select(F.col(value).alias("_v")), observed.select(F.col(value).alias("_o")))
    hits = x.agg(F.sum((F.col("_v") >= F.col("_o") - 1e-12).cast("int")).alias("_hits"))
    return beside(observed, hits).withColumn("p", (F.coalesce("_hits", F.lit(0)) + 1) / F.lit(n + 1)).drop("_hits")


def matched_null(df: DataFrame, id_: str, chosen: Column, stratum: str, value: str, n: int = DRAWS) -> DataFrame:
    """rep, mean: the mean value of sets drawn without replacement with as many members of each stratum as the chosen set has."""
    v = df.select(F.col(id_).alias("_id"), F.col(stratum).alias("_g"), number(value).alias("_v"), F.coalesce(chosen, F.lit(False)).alias("_c")).where("_id is not null and _g is not null and _v is not null")
    members = _members("m", n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(n), np.zeros(n)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                b = batch.iloc[at : at + CHUNK]
                y = members(b).astype(float)
                total += b["_v"].to_numpy() @ y
                count += y.sum(0)
        yield pd.DataFrame({"t": [total], "c": [count]})

    s = _placed(v, "m", F.col("_c")).where("_gk > 0").select("_v", "_gx", "_gn", "_gk", "_i").mapInPandas(run, "t array<double>, c array<double>")
    return s.select(F.posexplode(F.arrays_zip("t", "c")).alias("rep", "z")).groupBy("rep").agg(F.try_divide(F.sum("z.t"), F.sum("z.c")).alias("mean")).where("mean is not null")


def quantile_strata(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """df with ``stratum``: bins between exact quantiles (linear interpolation), fewer where these coincide."""
    edges = df.agg(F.array_distinct(F.percentile(value, [k / bins for k in range(1, bins)])).alias("_edges"))
    return beside(df, edges).withColumn("stratum", F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(value))))).drop("_edges")


def delong(df: DataFrame, keys: list[str], label: Column, a: str, b: str) -> DataFrame:
    """keys, auc_a, auc_b, z: the paired test of two scores' areas, from each row's placement among the other class."""
    v = df.select(*keys, label.cast("int").alias("_y"), F.col(a).cast("double").alias("_sa"), F.col(b).cast("double").alias("_sb")).where("_y is not null and _sa is not null and _sb is not null")
    n = v.groupBy(*keys).agg(F.sum("_y").alias("m"), F.sum(1 - F.col("_y")).alias("n"))
    for s in ("_sa", "_sb"):
        c = v.groupBy(*keys, s).agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q"))
        c = running(running(blocked(c, keys, F.col(s)), keys, [F.col(s)], F.col("q"), "bq", itself=False), keys, [F.col(s)], F.col("p"), "bp", itself=False)
        c = c.select(*keys, s, (F.coalesce("bq", F.lit(0)) + F.col("q") / 2).alias(f"under{s}"), (F.coalesce("bp", F.lit(0)) + F.col("p") / 2).alias(f"low{s}"))
        v = v.join(c, [*keys, s])
    v = v.join(n, keys)
    for s in ("_sa", "_sb"):
        v = v.withColumn(f"v{s}", F.when(F.col("_y") == 1, F.try_divide(f"under{s}", "n")).otherwise(1 - F.try_divide(f"low{s}", "m")))
    d = F.col("v_sa") - F.col("v_sb")
    g = v.groupBy(*keys).agg(F.avg(F.when(F.col("_y") == 1, F.col("v_sa"))).alias("auc_a"), F.avg(F.when(F.col("_y") == 1, F.col("v_sb"))).alias("auc_b"), (F.try_divide(F.var_samp(F.when(F.col("_y") == 1, d)), F.first("m")) + F.try_divide(F.var_samp(F.when(F.col("_y") == 0, d)), F.first("n"))).alias("var"))
    return g.select(*keys, "auc_a", "auc_b", F.when(F.col("var") > 1e-18, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("var")).alias("z"))
