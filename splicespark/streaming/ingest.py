"""Incremental ingest: per-experiment count files that arrive over time update group evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONNECTION = ["grp", "lsv_id", "junc_idx"]


def count_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New count files of a folder, `files` in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def group_evidence(counts: DataFrame, min_reads: int = 3, min_pos: int = 2) -> DataFrame:
    """grp, lsv_id, junc_idx, reads, passed: totals and the number of experiments that pass. counts: grp, experiment, lsv_id,
    junc_idx, reads, npos; a table, or a stream, whose sums are then kept as state by connection."""
    ok = ((F.col("npos") >= min_pos) & (F.col("reads") >= min_reads)).cast("long")
    return counts.groupBy(*CONNECTION).agg(F.sum("reads").alias("reads"), F.sum(ok).alias("passed"))


def once_each(counts: DataFrame) -> DataFrame:
    """Counts of a table without rows that were sent twice: of an experiment and connection the row with most reads."""
    keys = ["grp", "experiment", "lsv_id", "junc_idx"]
    most = counts.groupBy(*keys).agg(F.max(F.struct("reads", "npos")).alias("x"))
    return most.select(*keys, "x.reads", "x.npos")


def start(counts: DataFrame, target: str, checkpoint: str, **limits):
    """Runs the stream of counts over what is there.

    The state has every experiment's connection that has come, so that what is sent again (an experiment's counts don't
    change) counts once, and by connection the sums; a batch reads its own files and the state of its own connections. What a
    batch changes goes to a folder of its own under target, grp, lsv_id, junc_idx, reads, passed, so a batch that is
    repeated after a failure writes the same folder again. current() gives the evidence of all batches.
    """
    once = counts.dropDuplicates(["grp", "experiment", "lsv_id", "junc_idx"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return group_evidence(once, **limits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """grp, lsv_id, junc_idx, reads, passed after the last batch that ended, read from the state of the sums."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    sums = operators.filter("operatorName = 'stateStoreSave'").select("operatorId").distinct().first()["operatorId"]
    state = spark.read.format("statestore").option("operatorId", sums).load(checkpoint)
    return state.select("key.*", F.col("value").cast("struct<reads:bigint,passed:bigint>").alias("v")).select(*CONNECTION, "v.reads", "v.passed")
