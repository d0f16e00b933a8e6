"""Connected components of a graph given by its edges, in rounds of joins.

Each round first hands every node's smallest neighbour to its larger neighbours (large star), then to its
smaller ones (small star), until nothing changes; a path of n nodes takes about log n rounds. Each round is
cut by a checkpoint, so it survives the loss of executors. Only counts come to the driver.

Defined cases: edges with a null side are no edges; a loop makes its node known; repeats and direction don't
matter; an empty table has no components. The component is the smallest node in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component for each node of the edges."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    e, sign = e.where("u <> v"), None
    for _ in range(rounds):
        # each node with its smallest neighbour or itself: the larger neighbours get it, then the smaller ones
        low = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("v")))).alias("x")).groupBy("x.u").agg(F.min("x.v").alias("m"))
        large = e.select(F.col("v").alias("n"), F.col("u").alias("w")).join(low.select(F.col("u").alias("n"), "m"), "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
