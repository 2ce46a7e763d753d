"""What several operators need: checkpoints in the shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named and the master is local, as in tests."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs has not, also in other letters' case."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a new Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_small(big: DataFrame, small: DataFrame, key: str, small_key: str | None = None, most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join on a key (null equals null; of another name on the small side, if one is given) that a third of the big side's rows may share.

    small is checkpointed and counted: up to ``most`` rows are broadcast, more are
    joined by a shuffle in which every key is salted.
    """
    small = checkpointed(small).withColumnRenamed(small_key or key, "__joined")
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), big[key].eqNullSafe(small["__joined"]), "left").drop("__joined")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = small.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn("__salt", salt)
    return big.join(salted, big[key].eqNullSafe(salted["__joined"]) & (big["__salt"] == salted["__salt_of"]), "left").drop("__joined", "__salt", "__salt_of")
