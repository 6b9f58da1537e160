"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back: it is computed once, survives lost executors, and Spark knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
