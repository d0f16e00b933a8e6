"""Beliefs about arms as a fold over an append-only ledger of experiments; nothing is updated in place.

Defined cases: rows with a null arm or success are left out; a null effect counts as the least weight; arms
without rows have no belief; an empty ledger gives no arm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR, LEAST, MOST = 2.0, 0.5, 2.0  # fixed values: a prior of strength 4, and the bounds of a row's weight


def posterior(ledger: DataFrame) -> DataFrame:
    """arm, alpha, beta, experiments from rows of arm, success (boolean), effect."""
    w = F.least(F.greatest(F.abs(F.coalesce("effect", F.lit(0.0))), F.lit(LEAST)), F.lit(MOST))
    g = ledger.where("arm is not null and success is not null").groupBy("arm")
    return g.agg((PRIOR + F.sum(F.when(F.col("success"), w).otherwise(0.0))).alias("alpha"), (PRIOR + F.sum(F.when(~F.col("success"), w).otherwise(0.0))).alias("beta"), F.count("*").alias("experiments"))


def next_arm(beliefs: DataFrame) -> DataFrame:
    """rule, arm: the next arm by mean, by deviation, and by their sum; of equal ones the smallest."""
    a, b = F.col("alpha"), F.col("beta")
    s = beliefs.select("arm", (a / (a + b)).alias("m"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"))
    best = lambda v: F.max_by("arm", F.struct(v.alias("v"), (-F.col("arm")).alias("k")))
    one = s.agg(best(F.col("m")).alias("greedy"), best(F.col("sd")).alias("uncertainty"), best(F.col("m") + F.col("sd")).alias("ucb"))
    return one.select(F.explode(F.create_map(*(x for r in one.columns for x in (F.lit(r), F.col(r))))).alias("rule", "arm")).where("arm is not null")
