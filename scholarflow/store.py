"""Keeping intermediate results where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a partition of `compacted` holds, if others were joined to it, and below how many a partition is tiny.
PART, TINY = 8 << 20, 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share; made if it is unset, in local runs only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def compacted(df: DataFrame, size: int | Column) -> DataFrame:
    """`df`, which is checkpointed, in partitions of about `PART` bytes if those that it has are tiny; a row has about `size` bytes.

    Every partition leaves three files in every exchange that reads it, however few rows it has. Others stay as they are,
    since what was dealt by a key need not be dealt again.
    """
    held = df.agg(F.count(F.lit(1)) * size if isinstance(size, int) else F.sum(size)).first()[0] or 0
    return df.coalesce(max(1, -(-held // PART))) if held < TINY * df.rdd.getNumPartitions() else df


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """`df`, written as Parquet into the shared folder and read again."""
    where = new_folder(df.sparkSession, kind)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def small(df: DataFrame, most: int, what: str) -> DataFrame:
    """`df` to be broadcast, after a check that it has no more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: too many to broadcast")
    return F.broadcast(df)
