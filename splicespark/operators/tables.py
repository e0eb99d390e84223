"""Tables that cut the lineage of iterated jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="splice-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: lost executors cost what came after it at most."""
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
