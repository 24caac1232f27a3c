"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one on a local master without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp()}/reviews-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once and read back, so that all that is made from it sees the same rows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
