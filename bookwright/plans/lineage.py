"""Cutting lineage with files that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or names up to which a side of a join is broadcast (some 10 MB).
FEW = 1 << 18


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where neither that setting nor a folder of the context is given, a temporary
    folder is made on one machine; on a cluster, where each host would have
    another, that is an error. Spark removes files that nothing refers to any more
    if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder.

    Coalescing to more partitions than there are moves no row; it only makes
    Spark forget the partitioning. A scan that still names it is planned anew for
    each side of a self-join, and the exchange below the join runs twice.
    """
    checkpoint_dir(df.sparkSession)
    return df.coalesce(1 << 20).checkpoint(eager=True)


def small(df: DataFrame, number: int | None = None) -> DataFrame:
    """``df`` to be broadcast if it has at most FEW rows, counted here unless ``number`` says; as it is if it has more."""
    return F.broadcast(df) if (df.count() if number is None else number) <= FEW else df
