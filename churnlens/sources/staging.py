"""Tables staged in the folder that all executors share, and joins by size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share.

    Where that setting is unset, a local folder is set in its place on a local master; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/churnlens-{uuid.uuid4().hex}"


#: A table is broadcast up to so many rows, joined by shuffle beyond.
BROADCAST_ROWS = 400_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is small; its rows are counted first, so df should be a staged table of few columns."""
    return F.broadcast(df) if df.count() <= rows else df


def staged(df: DataFrame, *, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
