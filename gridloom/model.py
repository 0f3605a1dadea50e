"""Schemas. Dense data are coordinate rows, so any partitioning gives the same results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX = "r long, c long, v int"
POINTS = "i long, r long, c long"
VECTOR = "i long, v double"
COO = "row long, col long, val double"


def sentinel_to_null(df: DataFrame, column: str, sentinel: float = -1) -> DataFrame:
    """A value that stands for "not measured" becomes null."""
    return df.withColumn(column, F.when(F.col(column) != sentinel, F.col(column)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes and rereads ``df`` in the folder that driver and executors share, for loops."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/gridloom-{spark.sparkContext.applicationId}/loop-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
