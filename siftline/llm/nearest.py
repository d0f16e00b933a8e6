"""Pairing records of two tables by nearest time, with x-fast tries.

The right rows' times are the leaves of one trie per entity. Every length of bit prefix has a hash table from
(entity, prefix) to the first and last leaf below it; a query finds the longest prefix it shares with any leaf
by binary search over the length (about log2 of the bits look-ups), and the node found gives predecessor and
successor: if the query leaves it to the right, its last leaf and that leaf's right neighbour, else its first
leaf and that leaf's left neighbour. The nearer one within the tolerance is the partner.

Spark partitions both tables by entity; an entity with very many rows is cut into blocks along time
(siftline.operators.keyblocks), and the last leaf before and the first after each block are added to it, so
that every block's answer is final. Within a task rows come entity by entity (or block by block), leaves before
queries, and every CHUNK rows the tries of the entities in hand are built as numpy arrays, all queries so far move
through them together, and all is dropped but the leaves of the entity still open. So memory holds about CHUNK rows
and one entity's or block's distinct times, however large a partition is.

Defined cases: rows with a null key, time or id on either side have no partner; of equal distances the earlier
time counts, of equal times the smallest id; a distance of exactly the tolerance is within; equal times match
at distance 0; repeated left rows each get their partner; empty tables give an empty result. Only the named
columns are read, so extra columns and clashing names do no harm. Ids must be whole numbers, others are refused;
keys of other types are compared as texts by two hashes, 108 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.notation import micros
from siftline.operators.keyblocks import hot_splits, with_block

CHUNK = 50_000  # rows of a partition that are in memory at a time; a leaf takes up to 2 kB in the tables of all lengths
BLOCK_BITS = 20  # blocks of a key are numbered from 0 to under 2^20, as keyblocks makes fewer
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class PairTable:
    """Hash table from distinct pairs of int64 to their positions, with open addressing; whole arrays at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.mask = (1 << max(3, (2 * len(a)).bit_length())) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        at, left = self._home(a, b), np.arange(len(a), dtype=np.int32)
        while len(left):
            free = self.slot[at[left]] < 0
            self.slot[at[left[free]]] = left[free]
            left = left[self.slot[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a.astype(np.uint64) * _A ^ b.astype(np.uint64) * _B
        h ^= h >> np.uint64(29)
        h *= _A
        return (h >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the pairs, -1 for those not in the table."""
        out, at, left = np.full(len(a), -1, np.int64), self._home(a, b), np.arange(len(a))
        while len(left):
            s = self.slot[at[left]]
            hit = (s >= 0) & (self.a[s] == a[left]) & (self.b[s] == b[left])
            out[left[hit]] = s[hit]
            left = left[(s >= 0) & ~hit]
            at[left] = (at[left] + 1) & self.mask
        return out


def _distinct(key: np.ndarray, block: np.ndarray, time: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """The leaves in order, of equal times of an entity the one with the smallest id."""
    order = np.lexsort((ids, time, block, key))
    cols = [x[order] for x in (key, block, time, ids)]
    keep = np.ones(len(key), bool)
    keep[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:3]])
    return [x[keep] for x in cols]


class XFastTries:
    """Tries over the times of many entities (pairs key, block); equal times keep the smallest id."""

    def __init__(self, key: np.ndarray, block: np.ndarray, time: np.ndarray, ids: np.ndarray):
        key, block, self.time, self.ids = _distinct(key, block, time, ids)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        self.entity = np.cumsum(new) - 1
        self.entities = PairTable(key[new], block[new])
        self.base = int(self.time.min()) if len(self.time) else 0
        self.unit = max(1, int(np.gcd.reduce(self.time - self.base))) if len(self.time) else 1
        self.code = (self.time - self.base) // self.unit
        self.bits = int(self.code.max()).bit_length() if len(self.code) else 0
        self.levels: dict[int, tuple[PairTable, np.ndarray, np.ndarray]] = {}

    def level(self, n: int) -> tuple[PairTable, np.ndarray, np.ndarray]:
        """The table of prefixes of n bits, and of each the first and last leaf."""
        if n not in self.levels:
            prefix = self.code >> (self.bits - n)
            new = np.ones(len(prefix), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (self.entity[1:] != self.entity[:-1])
            first = np.flatnonzero(new)
            self.levels[n] = PairTable(self.entity[first], prefix[first]), first, np.append(first[1:], len(prefix)) - 1
        return self.levels[n]

    def around(self, key: np.ndarray, block: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves at or before, and after, each time; -1 where there is none."""
        before, after = np.full(len(time), -1, np.int64), np.full(len(time), -1, np.int64)
        if not len(self.time):
            return before, after
        e = self.entities.find(key, block)
        at = np.flatnonzero(e >= 0)
        e, q = e[at], np.floor_divide(time[at] - self.base, self.unit)
        under, over = q < 0, q >= 1 << self.bits
        code = np.clip(q, 0, (1 << self.bits) - 1)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.bits, np.int64)
        node = np.full(len(at), -1, np.int64)
        node[:] = self.level(0)[0].find(e, np.zeros_like(e))
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            for n in np.unique(mid[open_]):
                some = np.flatnonzero(open_ & (mid == n))
                hit = self.level(int(n))[0].find(e[some], code[some] >> (self.bits - n))
                there = hit >= 0
                low[some[there]], node[some[there]] = n, hit[there]
                high[some[~there]] = n - 1
        first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for n in np.unique(low):
            some = low == n
            _, a, b = self.level(int(n))
            first[some], last[some] = a[node[some]], b[node[some]]
        right = (code >> np.maximum(self.bits - low - 1, 0)) & 1 == 1  # the side on which the query leaves the node
        exact = low == self.bits
        pred = np.where(exact, first, np.where(right, last, first - 1))
        succ = np.where(exact, first + 1, np.where(right, last + 1, first))
        if under.any() or over.any():
            _, a, b = self.level(0)
            root = self.level(0)[0].find(e, np.zeros_like(e))
            pred, succ = np.where(under, -1, np.where(over, b[root], pred)), np.where(under, a[root], np.where(over, len(self.time), succ))
        for leaf, out in ((pred, before), (succ, after)):
            own = (leaf >= 0) & (leaf < len(self.time))
            own[own] = self.entity[leaf[own]] == e[own]
            out[at[own]] = leaf[own]
        return before, after


def _pair(tolerance: int):
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("gap", pa.int64())])

    def answer(leaves: list[np.ndarray], queries: list[np.ndarray]) -> pa.RecordBatch:
        tries = XFastTries(*leaves)
        key, block, time, ids = queries
        before, after = tries.around(key, block, time)
        far = np.int64(2**62)
        if len(tries.time):
            d0, d1 = np.where(before >= 0, time - tries.time[before], far), np.where(after >= 0, tries.time[after] - time, far)
        else:
            d0 = d1 = np.full(len(time), far)
        gap, leaf = np.minimum(d0, d1), np.where(d0 <= d1, before, after)
        ok = gap <= tolerance
        return pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(tries.ids[leaf[ok]]), pa.array(gap[ok])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows (place, key, block, time, id) come by place, whose last bit is the side: a query's leaves have all come before it
        rows: list[list[np.ndarray]] = []
        count = 0

        def settle() -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
            """The pairs of the queries in hand, and the leaves of the last place, which more queries or leaves may follow."""
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
            side = cols[0] & 1
            leaves, queries = [c[side == 0] for c in cols], [c[side == 1] for c in cols[1:]]
            out = answer(leaves[1:], queries) if len(queries[0]) else None
            place = cols[0][-1] & ~1
            kept = _distinct(*(c[leaves[0] == place] for c in leaves[1:]))
            return out, [np.full(len(kept[0]), place), *kept]

        for batch in batches:
            rows.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            count += batch.num_rows
            if count >= CHUNK:
                out, kept = settle()
                rows, count = [kept], 0
                if out is not None:
                    yield out
        if count:
            out, _ = settle()
            if out is not None:
                yield out

    return run


def nearest_join(left: DataFrame, right: DataFrame, key: str, time: str, left_id: str, right_id: str, tolerance_s: int, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """left_id, right_id, gap (microseconds): each left row with the right row of its key nearest in time.

    stats: tables with key and time to find very frequent keys in, if cheaper to read than left and right.
    """
    whole_kinds = ("tinyint", "smallint", "int", "bigint")
    for d, c in ((left, left_id), (right, right_id)):
        if dict(d.dtypes)[c] not in whole_kinds:
            raise ValueError(f"{c} must be a whole number")
    whole = dict(left.dtypes)[key] in whole_kinds and dict(right.dtypes)[key] in whole_kinds
    text = F.col(key).cast("string")
    # a key is one number, or two hashes, of which the second shares its place with the block's number
    ks = {"k": F.col(key).cast("long")} if whole else {"k": F.xxhash64(text), "k2": F.xxhash64(F.lit("2"), text).bitwiseAND(F.lit(-(1 << BLOCK_BITS)))}
    keys = list(ks)
    slim = lambda d, i: d.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(*(c.alias(n) for n, c in ks.items()), micros(d, time).alias("t"), (F.col(i).cast("long") if i else F.lit(0)).alias("id")).where("id is not null")
    a, b = slim(left, left_id), slim(right, right_id)
    s = hot_splits((slim(stats[0], None).union(slim(stats[1], None)) if stats else a.union(b)).select(*keys, "t"), keys, F.col("t"))
    a = with_block(a, s, keys, F.col("t"))
    b = with_block(b, s, keys, F.col("t"))
    # the leaves just outside each block of a large key: at most 2 x MOST_BLOCKS blocks, two leaves each
    ends = b.where("_hot").groupBy(*keys, "_blk").agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", (-F.col("id")).alias("id"))).alias("hi"))
    grid = s.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_splits"))).alias("_blk")).join(ends, [*keys, "_blk"], "left")
    w = Window.partitionBy(*keys).orderBy("_blk")
    out = grid.select(*keys, "_blk", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("lo"))
    edge = out.select(*keys, "_blk", F.explode(F.array("lo", F.when(F.col("hi").isNotNull(), F.struct(F.col("hi.t").alias("t"), (-F.col("hi.id")).alias("id"))))).alias("x")).where("x is not null")
    blk = F.col("_blk").cast("long") if whole else F.col("k2").bitwiseOR(F.col("_blk").cast("long"))
    at = lambda side, d, t, i: d.select(F.lit(side).cast("long").alias("side"), "k", blk.alias("blk"), F.col(t).alias("t"), F.col(i).alias("id"))
    rows = at(0, b, "t", "id").union(at(0, edge, "x.t", "x.id")).union(at(1, a, "t", "id")).repartition("k", "blk")
    # one number to sort by: a hash of the entity's block, then the side; of two with the same hash, both have their leaves first
    place = F.xxhash64("k", "blk").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("side"))
    return rows.select(place.alias("place"), "k", "blk", "t", "id").sortWithinPartitions("place").mapInArrow(_pair(tolerance_s * 1_000_000), "left_id bigint, right_id bigint, gap bigint")
