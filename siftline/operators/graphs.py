"""Scores spread over graphs, over-representation of sets, and rankings from partial evidence.

Graphs are edge tables; a step of a walk is a join and a sum, with a checkpoint every few steps, so graphs of
any size work. A hub's edges are many rows of one key: the join's skew handling splits them, and the sum
combines before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.ranks import benjamini_hochberg, serial
from siftline.operators.statistics import log_factorial
from siftline.session import beside, cut


def undirected(edges: DataFrame, a: str, b: str, weight: str, least: float = 0.0) -> DataFrame:
    """src, dst, w in both directions, once each with the largest weight; loops, nulls and weights under ``least`` dropped."""
    e = edges.where((F.col(a) != F.col(b)) & (F.col(weight) >= least)).groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.max(weight).cast("double").alias("w"))
    return e.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("e"), "w").select("e.*", "w")


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, w / sqrt(degree(src) * degree(dst)), with weighted degrees."""
    deg = edges.groupBy("src").agg(F.sum("w").alias("d"))
    return edges.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))


def _start(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges partitioned by source once for all steps, nodes, (node, p) with the seeds' equal shares)."""
    w = cut(normalised(edges).repartition("src"))
    nodes = cut(w.select(F.col("src").alias("node")).distinct())
    s = nodes.join(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), "node", "left_semi")
    return w, nodes, cut(beside(s, s.agg(F.count("*").alias("n"))).select("node", (1 / F.col("n")).alias("p")))


def _push(w: DataFrame, cur: DataFrame, factor: float) -> DataFrame:
    """What each node sends along its edges, as (node, p); not added up yet."""
    return w.join(cur, w["src"] == cur["node"]).select(F.col("dst").alias("node"), (F.col("w") * F.col("p") * factor).alias("p"))


def _scores(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("score"))


def walk_with_restart(edges: DataFrame, seeds: DataFrame, restart: float = 0.5, steps: int = 24, every: int = 6) -> DataFrame:
    """node, score: fixed point of p = restart * s + (1 - restart) * W p from uniform seeds; the error is at most (1 - restart)^steps.

    A step is one join, whose sides are partitioned alike, and one sum over what was sent and the restart.
    Seeds that aren't in the graph are ignored; without any, all scores are 0.
    """
    w, nodes, s = _start(edges, seeds)
    back, cur = s.select("node", (F.col("p") * restart).alias("p")), s
    for k in range(steps):
        cur = _push(w, cur, 1 - restart).union(back).groupBy("node").agg(F.sum("p").alias("p"))
        if (k + 1) % every == 0:
            cur = cut(cur)
    return _scores(nodes, cur)


def heat_diffusion(edges: DataFrame, seeds: DataFrame, t: float = 0.5, steps: int = 14, every: int = 4) -> DataFrame:
    """node, score: exp(-t (I - W)) s, by its series exp(-t) sum of (t W)^k / k! s."""
    w, nodes, cur = _start(edges, seeds)
    terms = cur
    for k in range(steps):
        cur = _push(w, cur, t / (k + 1)).groupBy("node").agg(F.sum("p").alias("p"))
        terms = terms.union(cur)
        if (k + 1) % every == 0:
            cur, terms = cut(cur), cut(terms.groupBy("node").agg(F.sum("p").alias("p")))
    return _scores(nodes, terms.groupBy("node").agg((F.sum("p") * math.exp(-t)).alias("p")))


def hubs(edges: DataFrame, scores: DataFrame, seeds: DataFrame, top: int = 25) -> DataFrame:
    """node, score, rank, degree, hub: of the first ``top`` non-seeds by score those whose number of neighbours is at least its 75th percentile."""
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    best = scores.join(seeds.select(F.col(seeds.columns[0]).alias("node")), "node", "left_anti").orderBy(F.col("score").desc(), "node").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc(), "node")))  # top rows only
    return beside(best.join(deg, "node"), deg.agg(F.percentile("degree", 0.75).alias("_q"))).withColumn("hub", F.col("degree") >= F.col("_q")).drop("_q")


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def over_representation(sets: DataFrame, query: DataFrame) -> DataFrame:
    """set_id, size, overlap, universe, drawn, odds, p, q: hypergeometric tail of each set's overlap with the query.

    sets (set_id, item), query (item); repeats count once. The universe is all items of sets and the query;
    only sets with an overlap are tested and adjusted. odds is infinite where the formula divides by 0.
    """
    s = sets.select("set_id", "item").where("set_id is not null and item is not null").distinct()
    q = query.select("item").where("item is not null").distinct()
    n = s.groupBy("set_id").agg(F.count("*").alias("size"))
    k = s.join(q, "item", "left_semi").groupBy("set_id").agg(F.count("*").alias("overlap"))
    u = s.select("item").union(q).distinct().agg(F.count("*").alias("universe"))
    x = beside(beside(n.join(k, "set_id"), u), q.agg(F.count("*").alias("drawn")))
    # the tail's terms, one row each: those within 40 deviations of the mean, as all others are 0 in double precision
    share = F.col("size") / F.col("universe")
    wide = 40 * F.sqrt(F.col("drawn") * share * (1 - share)) + 40
    low = F.greatest(F.col("overlap"), F.floor(F.col("drawn") * share - wide))
    high = F.least("size", "drawn", F.ceil(F.greatest(F.col("overlap"), F.col("drawn") * share) + wide))
    t = x.withColumn("i", F.explode(F.sequence(low, F.greatest(low, high)))).where("drawn - i <= universe - size and i <= least(size, drawn)")
    t = t.groupBy("set_id", "size", "overlap", "universe", "drawn").agg(F.sum(F.exp(_log_choose(F.col("size"), F.col("i")) + _log_choose(F.col("universe") - F.col("size"), F.col("drawn") - F.col("i")) - _log_choose(F.col("universe"), F.col("drawn")))).alias("p"))
    a, b, c = F.col("overlap"), F.col("size") - F.col("overlap"), F.col("drawn") - F.col("overlap")
    d = F.col("universe") - F.col("size") - c
    t = t.withColumns({"p": F.least("p", F.lit(1.0)), "odds": F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c)), "_all": F.lit(0)})
    return benjamini_hochberg(cut(t), ["_all"], "p").withColumn("q", F.greatest("q", "p")).drop("_all")


def composite(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """df with the weighted mean of signals over those present, and ``signals``, their number; weights of 0 only give the plain mean; null without any."""
    arr = F.filter(F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(float(w)).alias("w")) for c, w in weights.items())), lambda x: x["v"].isNotNull())
    add = lambda f: F.aggregate("_s", F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumn("_s", arr).withColumns({"signals": F.size("_s"), "_w": add(lambda x: x["w"])})
    return df.withColumn(name, F.when(F.col("_w") > 0, add(lambda x: x["w"] * x["v"]) / F.col("_w")).when(F.col("signals") > 0, add(lambda x: x["v"]) / F.col("signals"))).drop("_s", "_w")


def partition_score(evidence: Column, excluded: list[str]) -> Column:
    """Mean of the map's values whose keys aren't excluded; 0 if none is left."""
    v = F.map_values(F.map_filter(evidence, lambda k, _: ~k.isin(*excluded)))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0)


def at_k(df: DataFrame, score: str, item: str, gold: DataFrame, k: int) -> DataFrame:
    """k, hits, precision, recall: gold counts only where it is in the ranked universe."""
    top = df.orderBy(F.col(score).desc(), item).limit(k)
    g = gold.select(F.col(gold.columns[0]).alias(item)).distinct()
    hits = top.join(g, item, "left_semi").agg(F.count("*").alias("hits"))
    inside = df.select(item).distinct().join(g, item, "left_semi").agg(F.count("*").alias("_gold"))
    return beside(beside(hits, inside), top.agg(F.count("*").alias("_n"))).select(F.lit(k).alias("k"), "hits", F.try_divide("hits", "_n").alias("precision"), F.try_divide("hits", "_gold").alias("recall"))


def membership(df: DataFrame, col: str, word: str) -> Column:
    """Whether a ";" list holds a word, compared without case or blanks."""
    return F.array_contains(F.transform(F.split(F.lower(col), ";"), lambda x: F.trim(x)), word.lower())


def related(df: DataFrame, main: str, others: str, word: str) -> DataFrame:
    """The rows that name the word as their main or one of their other items (";" list), or, where no row does, all rows; ``matched`` tells which."""
    r = df.withColumn("_hit", F.coalesce(F.lower(F.trim(main)) == word.lower(), F.lit(False)) | F.coalesce(membership(df, others, word), F.lit(False)))
    return beside(r, r.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("matched"))).where(F.col("_hit") | ~F.col("matched")).drop("_hit")


def ranked_universe(df: DataFrame, item: str, score: str, gold: DataFrame, top: int) -> DataFrame:
    """item, place: the first ``top`` items by score, then the gold items that aren't among them, by name; each once, in this order. A list of the caller's size."""
    first = df.select(item, score).where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), item).limit(top)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), item)))
    rest = gold.select(F.col(gold.columns[0]).alias(item)).where(F.col(item).isNotNull()).distinct().join(first, item, "left_anti")
    rest = serial(rest, item, "place").select(item, (F.col("place") + top).alias("place"))
    return first.select(item, F.col("place").cast("bigint")).unionByName(rest.select(item, F.col("place").cast("bigint")))

