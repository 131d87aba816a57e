"""Small sides of joins, checked by size, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small(side: DataFrame, rows: int = 10_000) -> DataFrame:
    """`side` with a broadcast hint if it has at most `rows` rows; beyond that Spark chooses the join itself."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of this machine's only for a local session that names none."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not path and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or (Path(tempfile.gettempdir()) / "finlattice").as_uri()


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read again: model calls are then made once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)  # goes when the driver ends
    return spark.read.schema(df.schema).parquet(path)
