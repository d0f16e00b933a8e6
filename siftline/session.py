"""Small helpers around the session: tables, checkpoints, scratch folders, spreading of work, shipping of the package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for those that haven't installed it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "siftline"), "zip", root, "siftline"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one named in spark.checkpoint.dir, which all machines share.

    Where that is unset, a local session gets a new temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder name within the shared folder, for files that are written and read again."""
    return f"{shared(spark)}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder.

    Spark removes checkpoints that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Shuffle rows at random where the input has fewer partitions than the cluster has cores.

    For steps that cost much more CPU a row than the shuffle does (tokenizing); one file with one row
    group would otherwise keep a single core busy.
    """
    want = least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def balanced(df: DataFrame, rows: int) -> DataFrame:
    """A checkpointed df over as many tasks as it has ``rows``, up to the cluster's cores, where it has fewer; for passes that cost much a row."""
    have, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    if have >= cores:
        return df
    want = min(-(-df.count() // rows), cores)
    return cut(df.repartition(want)) if want > have else df


def number(c: str | Column) -> Column:
    """A double with NaN turned to null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of the one row of totals, as a scalar subquery."""
    return df.withColumn("_tot", totals.select(F.struct(*totals.columns).alias("s")).scalar()).select("*", "_tot.*").drop("_tot")
