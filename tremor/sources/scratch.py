"""Names for tables that are written only to be read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session that names no shared folder keeps them.
LOCAL = "/tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path and read again: it is computed once, and losing an executor costs nothing."""
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
