"""Beliefs over a stream of experiments: an extension, the reference has no streams.

The stream's state is Spark's own aggregate state: two sums and a count an arm, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.ledger import posterior


def running_beliefs(events: DataFrame) -> DataFrame:
    """arm, alpha, beta, experiments of a streaming DataFrame of arm, success, effect; write it in update or complete mode."""
    return posterior(events)


def windowed_beliefs(events: DataFrame, at: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The same by time window; rows later than ``late`` behind the newest are dropped by the watermark, so state stays bounded."""
    w = events.withWatermark(at, late).where("arm is not null and success is not null")
    return w.groupBy(F.window(at, window).alias("w"), "arm").agg(F.sum(F.col("success").cast("int")).alias("successes"), F.count("*").alias("experiments")).select(F.col("w.start").alias("start"), "arm", "successes", "experiments")


def versions(states: DataFrame, key: str, at: str, state: str, late: str = "10 minutes") -> DataFrame:
    """A stream of visits without repeats, for siftline.operators.history in a foreachBatch sink: state is bounded by the watermark."""
    return states.withWatermark(at, late).dropDuplicatesWithinWatermark([key, at, state])
