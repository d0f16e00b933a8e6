"""Writers: reports, contracts, ledgers. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.ranks import serial


def write_card(tests: DataFrame, verdict: DataFrame, path: str) -> None:
    """One JSON object: the verdict's columns and the tests as an array."""
    t = tests.agg(F.array_sort(F.collect_list(F.struct("key", "result", "value"))).alias("tests"))
    verdict.withColumn("tests", t.scalar()).coalesce(1).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_contract(df: DataFrame, path: str, by: str = "site") -> None:
    """Parquet by site; the rebalancing before the write cuts a site of any size into tasks and files of the advised size."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def deidentify(df: DataFrame, key: str, form: str = "AR%04d") -> tuple[DataFrame, DataFrame]:
    """(df with a code in place of the key, the crosswalk to be kept apart): dense numbers in the key's order."""
    cross = serial(df.select(key).where(F.col(key).isNotNull()).distinct(), key).select(key, F.format_string(form, "serial").alias("code"))
    return df.join(cross, key, "left").drop(key), cross
