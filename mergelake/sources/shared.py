"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: that of the context, else the named one; a local one only where none is named and the master is local, as in tests."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/mergelake-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a new Parquet table in the shared folder, read again; a lost executor takes nothing with it."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
