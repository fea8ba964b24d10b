"""A folder for intermediate tables that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder where the session's checkpoints go; a temporary one only on a single machine without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="echoloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/echoloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written once and read back, where two uses must see the same rows in the same tasks' order; in folders by
    the columns named, if any."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The size of what stored() gives: that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
