"""Cutting the lineage of a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what is shared; a local session without one gets its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, from files in that folder.

    Not from a checkpoint, which keeps the size that Spark expects of its rows: the product of the sizes of what was joined.
    In a loop that joins each round's rows to the last one's, the digits of that number multiply with every round, until
    planning takes minutes. Files have their own size."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
