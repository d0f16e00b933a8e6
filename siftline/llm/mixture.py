"""Mixing sources to target weights, by the cube method of balanced sampling.

The mixture is the largest in which every source that has tokens holds its weight's share and no record is used
more than max_repeats times: total = min over sources of max_repeats * tokens / weight. A record of a source is
then due ``rate`` = weight * total / tokens of the source times: the whole part of the rate as copies, the
rest as inclusion probability of one more. The cube method draws those: the vector of probabilities moves
along the null space of the constraints (number of records and number of tokens, by source) until the next
probability is 0 or 1. Records are decided from the one with most tokens down, each against all records that are
still undecided, so that only small ones are left to land.

Spark runs the flight in blocks of at most about BLOCK records of a source, spread by hash; two undecided
records may remain of a block, and further rounds fly what remains of all blocks, as many as it takes until each
source has one block. In that one at most two records remain to land: of the ways to take or leave them the one
nearest in tokens to what is due, then changes among the block's records, one or two at a time, that bring it nearer yet.

Defined cases: a source without records, or without tokens, is left out and the others' weights are scaled to
sum to 1 (its reached share is 0); records of a source that isn't a target, or of a null source, aren't
used; a null weight or one of 0 uses nothing; null max_repeats counts as 1; records without tokens (null or
empty texts) are never used; an empty table gives an empty mixture; repeated texts under different ids are
different records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import beside, cut

BLOCK = 4_096


def _glide(x: np.ndarray, p: float, coin: np.ndarray) -> np.ndarray:
    """The flight of records that all have the probability p, x falling: constant work a step.

    As all others move by a + b * x, their probabilities stay a linear function of x, whose bounds are first met at an
    end of the row, so undecided records stay a window; its sums come from running ones. Ends with at most two
    undecided, or where the others are all alike.
    """
    q, v = np.full(len(x), p), x.tolist()
    c1, c2 = np.append(0, np.cumsum(x)).tolist(), np.append(0, np.cumsum(x * x)).tolist()
    lead, own, first, last, a, b = 0, p, 1, len(v) - 1, p, 0.0
    settled = lambda y: y < 1e-9 or y > 1 - 1e-9
    for toss in coin.tolist():
        m = last - first + 1
        if m < 2:
            break
        mean = (c1[last + 1] - c1[first]) / m
        spread = c2[last + 1] - c2[first] - m * mean * mean
        d = v[lead] - mean
        if spread > 1e-10:
            g = -d / spread
        elif abs(d) < 1e-9:
            g = 0.0
        else:
            break
        up, down = 1 - own, own
        for z in (v[first], v[last]):
            y, u = a + b * z, g * (z - mean) - 1 / m
            if u > 1e-15:
                up, down = min(up, (1 - y) / u), min(down, y / u)
            elif u < -1e-15:
                up, down = min(up, -y / u), min(down, (y - 1) / u)
        step = up if toss * (up + down) < down else -down
        own, a, b = own + step, a - step * (1 / m + g * mean), b + step * g
        while first <= last and settled(y := a + b * v[last]):
            q[last] = round(y)
            last -= 1
        while first <= last and settled(y := a + b * v[first]):
            q[first] = round(y)
            first += 1
        if settled(own):
            q[lead] = round(own)
            if first > last:
                return q
            lead, own, first = first, a + b * v[first], first + 1
    q[lead] = own
    q[first : last + 1] = a + b * x[first : last + 1]
    return q


def flight(tokens: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The probabilities after the flight: all but at most two are 0 or 1; sums of p and of p * tokens are kept.

    The undecided record with most tokens leads: it moves by one and all other undecided ones by a + b * tokens, with
    a and b such that both sums stay (a vector of the constraints' null space, spread over all records), until the
    first probability is 0 or 1. So large records are decided while many others can make up for them, and what is
    left at the end are the smallest.
    """
    order = np.lexsort((np.arange(len(p)), -tokens))
    q, x = p[order].astype(float), tokens[order].astype(float)
    x = x / max(x.max(initial=1.0), 1.0)
    q[q < 1e-9], q[q > 1 - 1e-9] = 0, 1
    coin, k = rng.random(2 * len(p) + 1), 0
    if len(q) > 2 and 0 < q[0] < 1 and (q == q[0]).all():
        q = _glide(x, float(q[0]), rng.random(2 * len(p)))
    live = np.flatnonzero((q > 0) & (q < 1))
    while len(live) > 2:
        z, v = x[live], q[live]
        u = np.empty(len(live))
        u[0] = 1.0
        m, mean = len(z) - 1, z[1:].mean()
        spread = ((z[1:] - mean) ** 2).sum()
        if spread > 1e-18:
            b = -(z[0] - mean) / spread
            u[1:] = -1 / m + b * (z[1:] - mean)
        elif abs(z[0] - mean) < 1e-9:
            u[1:] = -1 / m
        else:  # the others are all alike: they move against each other, the leader stays
            u[:] = 0
            u[1], u[2] = 1.0, -1.0
        pos, neg = u > 1e-15, u < -1e-15
        up = min(((1 - v[pos]) / u[pos]).min(initial=np.inf), (v[neg] / -u[neg]).min(initial=np.inf))
        down = min((v[pos] / u[pos]).min(initial=np.inf), ((1 - v[neg]) / -u[neg]).min(initial=np.inf))
        # up with chance down / (up + down): the expectation stays
        v = v + (up if coin[k] * (up + down) < down else -down) * u
        k += 1
        v[v < 1e-9], v[v > 1 - 1e-9] = 0, 1
        q[live] = v
        live = live[(v > 0) & (v < 1)]
    out = np.empty(len(p))
    out[order] = q
    return out


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    seed = [len(pdf), int(pdf["id"].iloc[0]) % 2**32]  # a task that is run again draws the same
    return pdf.assign(p=flight(pdf["tokens"].to_numpy(), pdf["p"].to_numpy(), np.random.default_rng(seed)))


def land(tokens: np.ndarray, p: np.ndarray, due: float) -> np.ndarray:
    """0 or 1 for each record: of the ways to take or leave the at most two undecided ones the nearest in tokens to what is due, then changes of one or two records at a time, the best first, as long as they bring it nearer."""
    x, left, ways = tokens.astype(float), np.flatnonzero((p > 0) & (p < 1)), []
    for m in range(1 << len(left)):
        way = p.copy()
        way[left] = [m >> i & 1 for i in range(len(left))]
        ways.append(way)
    w = min(ways, key=lambda w: abs(float((w * x).sum()) - due))
    for _ in range(len(x)):
        off = float((w * x).sum()) - due
        change = (1 - 2 * w) * x
        order = np.argsort(change, kind="stable")
        ranked = change[order]
        best, flips = abs(off) - 1e-9, ()
        if abs(off + change).min() < best:
            best, flips = abs(off + change).min(), (int(abs(off + change).argmin()),)
        for near in (0, 1):  # the partner of each record whose change comes nearest to what remains
            j = np.clip(np.searchsorted(ranked, -(off + change)) - near, 0, len(x) - 1)
            gap = np.where(order[j] != np.arange(len(x)), abs(off + change + ranked[j]), np.inf)
            if gap.min() < best:
                i = int(gap.argmin())
                best, flips = gap[i], (i, int(order[j[i]]))
        if not flips:
            break
        for i in flips:
            w[i] = 1 - w[i]
    return w


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """The flight of a source's last block, and the landing."""
    due = float((pdf["p"] * pdf["tokens"]).sum())
    pdf = _fly(pdf)
    return pdf.assign(p=land(pdf["tokens"].to_numpy(), pdf["p"].to_numpy(float), due))


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """A row a target: source, weight, max_repeats, records, available (tokens), due (tokens), rate."""
    have = sizes.where("tokens > 0").groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    t = t.join(have, "source", "left").withColumn("live", F.when(F.col("available").isNotNull() & (F.col("weight") > 0), F.col("weight")))
    t = beside(t, t.agg(F.sum("live").alias("all_live")))
    t = beside(t, t.agg(F.min(F.col("max_repeats") * F.col("available") / F.col("live") * F.col("all_live")).alias("most")))
    goal = F.col("most") if total is None else F.lit(float(total))
    due = F.least(F.col("live") / F.col("all_live") * goal, F.col("max_repeats") * F.col("available"))
    return t.select("source", "weight", "max_repeats", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce(due, F.lit(0.0)).alias("due"), F.coalesce(due / F.col("available"), F.lit(0.0)).alias("rate"))


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, block: int = BLOCK) -> DataFrame:
    """id, source, tokens, repeats (at least 1): the mixture. sizes has id (bigint), source, tokens; total: tokens wanted, if not the most possible."""
    r = cut(rates(sizes, targets, total))
    # a row a target, of the caller's small table
    s = sizes.where("tokens > 0").join(F.broadcast(r.select("source", "rate", "records")), "source").where("rate > 0")
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    s = s.withColumns({"whole": F.when(near, F.round("rate")).otherwise(F.floor("rate")).cast("int"), "p": F.when(near, 0.0).otherwise(F.col("rate") - F.floor("rate"))})
    s = s.select("id", "source", F.col("tokens").cast("long").alias("tokens"), "whole", "p", "records")
    schema = "id bigint, source string, tokens bigint, whole int, p double, records bigint, round int"
    done, rest, n, k = [s.where("p = 0").drop("records")], s.where("p > 0"), F.col("records"), 0
    most, every = r.agg(F.max("records"), F.sum(F.ceil(F.col("records") / block))).first()
    most = most or 0
    # blocks are small but take time: as many tasks as there are blocks, up to the session's number
    tasks = max(1, min(int(every or 1), int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    while most > block:
        blocks = F.greatest(F.ceil(n / block), F.lit(1))
        # a source with one block waits for its landing
        rest = rest.withColumn("round", F.when(blocks > 1, F.pmod(F.xxhash64("id", F.lit(k)), blocks)).cast("int"))
        flown = cut(rest.where("round is not null").repartition(tasks, "source", "round").groupBy("source", "round").applyInPandas(_fly, schema))
        done.append(flown.where("p in (0, 1)").drop("records", "round"))
        rest = rest.where("round is null").unionByName(flown.where("p not in (0, 1)")).drop("round")
        n, k, most = F.when(n > block, 2 * blocks).otherwise(n), k + 1, 2 * -(-most // block)
    landed = rest.withColumn("round", F.lit(0)).repartition(tasks, "source").groupBy("source").applyInPandas(_land, schema)
    done.append(landed.drop("records", "round"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "source", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("repeats")).where("repeats > 0")


def reached(sizes: DataFrame, targets: DataFrame, mixture: DataFrame, total: float | None = None) -> DataFrame:
    """A row a target: what is available and due, and what the mixture reaches."""
    got = mixture.groupBy("source").agg(F.count("*").alias("used"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"), F.max("repeats").alias("most_repeats"))
    r = rates(sizes, targets, total).join(got, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    r = beside(r, r.agg(F.sum("mixed").alias("all_mixed")))
    return r.select("source", "weight", "max_repeats", "records", "available", "due", F.coalesce("used", F.lit(0)).alias("used"), "mixed", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide("mixed", "all_mixed"), F.lit(0.0)).alias("share"))
