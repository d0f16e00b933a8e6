"""Splits that keep related records together, by min-cost flow over bundles of components.

1. Records are nodes by id; links join ids; siftline.operators.components finds what belongs together.
2. Components of one cohort with the same number of rows and the same label profile (rows by label) form a bundle.
3. Quotas of the bundles are solved by flow: bundle -> label in split -> split, where a unit is a component and an
   arc costs the rise of the squared deviation, in rows, from what the label, and the split, is due. Units of
   one size differ from each other in their label only, so sizes are solved one after another from the largest down,
   and what one size leaves undone or overdone is made up by the smaller ones. As all costs are convex, a bundle's
   whole shares of what is due are sent at once; cheapest augmenting paths send the rest, and since residual paths
   only lead over labels and splits, a path is found among labels x splits + splits nodes, whatever the number of
   bundles. The flow is integral, so nothing is left to round.
4. Members are assigned by hash: a component's rank by hash within its bundle, from counts by hash range and a
   rank within the range, so no bundle is ever sorted in one task, meets the quotas exactly.

The flow runs in tasks, not on the driver. Bundles are solved in lots of about LOT: the first lot of a cohort
has its LOT bundles of the largest components; the others, dealt by hash, share what it leaves due in
proportion to their rows. A cohort of up to LOT bundles is one lot.

Defined cases: a record with a null id is a component of its own unless linked otherwise by the caller; null
labels are a label; splits with share 0 get nothing; shares need not sum to 1; a component larger than a
split's quota still goes whole to one split; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut

LOT, RANGE_ROWS = 20_000, 50_000


def bundles(records: DataFrame) -> DataFrame:
    """cohort, component, rows, profile (array of struct label, n), bundle: records has cohort, component, label."""
    c = records.groupBy("cohort", "component", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-")).alias("label")).agg(F.count("*").alias("n"))
    # labels are those of one component, from the most frequent on
    c = c.groupBy("cohort", "component").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("by"))
    profile = F.transform("by", lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("n")))
    c = c.select("cohort", "component", "rows", profile.alias("profile"))
    return c.withColumn("bundle", F.md5(F.to_json(F.struct("rows", "profile"))))


@dataclass
class Bundle:
    bundle: str
    profile: dict[str, int]
    components: int

    @property
    def label(self) -> str:
        return min(self.profile, key=lambda k: (-self.profile[k], k))

    @property
    def size(self) -> int:
        return sum(self.profile.values())


def quotas(them: list[Bundle], lack: dict[tuple[str, int], float], shares: list[float]) -> dict[str, list[int]]:
    """For each bundle the number of its components in each split; lack (rows due by label and split) is brought up to date."""
    out: dict[str, list[int]] = {}
    by_size: dict[int, list[Bundle]] = defaultdict(list)
    for b in them:
        by_size[b.size].append(b)
    for size in sorted(by_size, reverse=True):
        left = []
        for b in sorted(by_size[size], key=lambda b: b.bundle):
            need = [max(0.0, lack.get((b.label, k), 0.0)) if s else 0.0 for k, s in enumerate(shares)]
            fair = [x / sum(need) if sum(need) else s for x, s in zip(need, shares, strict=True)]
            out[b.bundle] = [int(b.components * x + 1e-9) for x in fair]
            _take(lack, b, out[b.bundle])
            left.append((b, b.components - sum(out[b.bundle])))
        for b, got in _flow(left, lack, shares, size):
            out[b.bundle] = [x + y for x, y in zip(out[b.bundle], got, strict=True)]
            _take(lack, b, got)
    return out


def _take(lack: dict[tuple[str, int], float], b: Bundle, got: list[int]) -> None:
    for k, n in enumerate(got):
        if n:
            for label, rows in b.profile.items():
                lack[label, k] = lack.get((label, k), 0.0) - n * rows


def _flow(left: list[tuple[Bundle, int]], lack: dict[tuple[str, int], float], shares: list[float], size: int) -> list[tuple[Bundle, list[int]]]:
    """The cheapest way to send each bundle's left-over components to the splits.

    Cheapest augmenting paths, one a unit: from the unit's label into a split, then on by moving units that are
    there already, of any bundle of their label, to another split, or a split's load from one label to another.
    The cost of an arc that has carried n is the rise of the squared deviation by one more unit, so each
    augmentation keeps the flow optimal. Which bundle a moved unit is of doesn't matter: the label's units are
    handed to its bundles at the end.
    """
    splits = [k for k, s in enumerate(shares) if s > 0]
    units: dict[str, int] = defaultdict(int)
    for b, n in left:
        units[b.label] += n
    labels = sorted(x for x, n in units.items() if n)
    due = {k: sum(v for (_, j), v in lack.items() if j == k) for k in splits}
    at: dict[tuple[str, int], int] = {(x, k): 0 for x in labels for k in splits}
    load = dict.fromkeys(splits, 0)
    rise = lambda gap, n: size * (size * (2 * n + 1) - 2 * gap)
    for label in labels:
        for _ in range(units[label]):
            best: dict[tuple, float] = {("l", label): 0.0}
            back: dict[tuple, tuple] = {}
            for _ in range(2 * len(labels) * len(splits) + len(splits) + 2):  # Bellman-Ford until nothing changes
                changed = False
                for v, d in list(best.items()):
                    if v[0] == "l":  # a unit of this label looks for a place
                        arcs = [(("at", v[1], k), 0.0) for k in splits]
                    elif v[0] == "at":
                        x, k = v[1], v[2]
                        arcs = [(("s", k), rise(lack.get((x, k), 0.0), at[x, k]))]
                        if at[x, k]:
                            arcs.append((("l", x), 0.0))
                    else:
                        arcs = [(("at", x, v[1]), -rise(lack.get((x, v[1]), 0.0), at[x, v[1]] - 1)) for x in labels if at[x, v[1]]]
                    for to, cost in arcs:
                        if d + cost < best.get(to, float("inf")) - 1e-9:
                            best[to], back[to], changed = d + cost, v, True
                if not changed:
                    break
            k = min(splits, key=lambda k: (best.get(("s", k), float("inf")) + rise(due[k], load[k]), k))
            load[k] += 1
            v = ("s", k)
            while v in back:
                u = back[v]
                if u[0] == "at" and v[0] == "s":
                    at[u[1], u[2]] += 1
                elif u[0] == "s":
                    at[v[1], v[2]] -= 1
                v = u
    out = []
    for b, n in left:
        got = [0] * len(shares)
        for k in splits:
            take = min(n, at.get((b.label, k), 0))
            got[k], n = take, n - take
            if take:
                at[b.label, k] -= take
        out.append((b, got))
    return out


def _solve(shares: list[float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        them = [Bundle(b, {x["label"]: int(x["n"]) for x in p}, int(n)) for b, p, n in zip(pdf["bundle"], pdf["profile"], pdf["n"], strict=True)]
        lack = {(x["label"], int(x["split"])): float(x["due"]) for x in pdf["due"].iloc[0]}
        got = quotas(them, lack, shares)
        return pd.DataFrame({"cohort": pdf["cohort"], "bundle": pdf["bundle"], "n": pdf["n"], "quota": [got[b] for b in pdf["bundle"]]})

    return run


def _lots(found: DataFrame, due: DataFrame, shares: list[float]) -> DataFrame:
    """cohort, bundle, n, quota: each lot's bundles solved in one task; due has cohort, due (array of label, split, due)."""
    return found.join(due, ["cohort", *(["lot"] if "lot" in due.columns else [])]).select("cohort", "lot", "bundle", "profile", "n", "due").groupBy("cohort", "lot").applyInPandas(_solve(shares), "cohort string, bundle string, n bigint, quota array<int>")


def _due(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, label, split, due; the array of the last three by key. Labels are a few names a cohort."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("label", "split", "due")).alias("due"))


def assign_splits(records: DataFrame, targets: DataFrame, seed: int = 0, lot: int = LOT) -> DataFrame:
    """cohort, component, rows, split: the split of every component of records (cohort, component, label).

    targets (split, share) is a small table of the caller's, a row a split.
    """
    want = sorted((r["split"], float(r["share"])) for r in targets.select("split", "share").collect() if r["split"] is not None and r["share"] is not None)
    total = sum(s for _, s in want)
    if not want or total <= 0:
        raise ValueError("no split has a share")
    shares = [s / total for _, s in want]
    b = cut(bundles(records).withColumn("h", F.xxhash64(F.lit(seed), "component")))
    found = b.groupBy("cohort", "bundle").agg(F.first("profile").alias("profile"), F.first("rows").alias("size"), F.count("*").alias("n"))
    # the rank of a bundle by size is exact up to the first lot, which is all that counts
    w = Window.partitionBy("cohort").orderBy(F.col("size").desc(), "bundle")
    first = found.select("cohort", "bundle", "size").withColumn("k", F.row_number().over(w)).where(F.col("k") <= lot).select("cohort", "bundle")
    count = found.groupBy("cohort").agg(F.count("*").alias("bundles"))
    found = cut(found.join(first.withColumn("first", F.lit(True)), ["cohort", "bundle"], "left").join(count, "cohort").withColumn("lot", F.when(F.col("first"), 0).otherwise(1 + F.pmod(F.xxhash64("bundle"), F.ceil(F.col("bundles") / lot))).cast("int")))
    by = found.select("cohort", "lot", "n", F.explode("profile").alias("x")).groupBy("cohort", "lot", F.col("x.label").alias("label")).agg(F.sum(F.col("n") * F.col("x.n")).alias("rows"))
    by = by.select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("split", "share"))
    whole = by.groupBy("cohort", "label", "split", "share").agg((F.sum("rows") * F.col("share")).alias("due"))
    quota = cut(_lots(found.where("lot = 0"), _due(whole, ["cohort"]), shares))
    if not found.where("lot > 0").isEmpty():
        got = found.join(quota, ["cohort", "bundle"]).select("cohort", F.explode("profile").alias("x"), F.posexplode("quota").alias("split", "q")).groupBy("cohort", F.col("x.label").alias("label"), "split").agg(F.sum(F.col("q") * F.col("x.n")).alias("got"))
        left = whole.join(got, ["cohort", "label", "split"], "left").withColumn("due", F.col("due") - F.coalesce("got", F.lit(0)))
        rest = by.where("lot > 0").withColumn("part", F.col("rows") / F.sum("rows").over(Window.partitionBy("cohort", "label", "split")))
        due = rest.join(left.select("cohort", "label", "split", "due"), ["cohort", "label", "split"]).withColumn("due", F.col("due") * F.col("part"))
        quota = quota.unionByName(_lots(found.where("lot > 0"), _due(due, ["cohort", "lot"]), shares))
    ends = F.transform(F.sequence(F.lit(1), F.size("quota")), lambda k: F.aggregate(F.slice("quota", 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    r = b.join(quota.select("cohort", "bundle", "n", ends.alias("ends")), ["cohort", "bundle"]).withColumn("range", F.pmod(F.shiftrightunsigned("h", 20), F.ceil(F.col("n") / RANGE_ROWS)))
    before = r.groupBy("cohort", "bundle", "range").count().withColumn("before", F.sum("count").over(Window.partitionBy("cohort", "bundle").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    w = Window.partitionBy("cohort", "bundle", "range").orderBy("h", "component")
    r = r.join(before, ["cohort", "bundle", "range"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.row_number().over(w))
    names = F.array(*(F.lit(s) for s, _ in want))
    return r.select("cohort", "component", "rows", names[F.size(F.filter("ends", lambda e: e < F.col("rank")))].alias("split"))
