"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that isn't there yet in the folder that driver and executors share (spark.checkpoint.dir; only where that is unset,
    as in tests, a temporary one)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), f"strataq-{spark.sparkContext.applicationId}")
    return f"{found.rstrip('/')}/strataq/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends there, reads take the columns they need, and
    Spark knows its size, so what is small can be broadcast."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
