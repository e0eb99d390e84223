"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"  # a word: no ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def narrowed(docs: DataFrame, *names: str, whole: bool = False) -> DataFrame:
    """The columns names of docs and, if whole, all of them in the struct `row`, where no name of theirs can clash."""
    return docs.select(*names, *([F.expr("struct(*)").alias("row")] if whole else []))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: lambdas would compute an outer expression again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# For rows of megabytes: a writer holds 100 rows before it looks at the size of a page or a row group, a reader the arrays of a group.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}


def written(df: DataFrame, large: bool = False) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage, survives lost executors. large: rows of up to
    megabytes, of which a task holds few."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each entry of sums, the sum over all rows up to and with this one in the given order.

    A range shuffle puts the rows in order, each partition sums its own, and the totals of the partitions before it
    (one row for each partition) are added. No task sees all rows. Ties in the order must be broken by the caller.
    """
    ranged = written(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **{f"_v_{k}": v for k, v in sums.items()}}))
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = {k: F.lit(0).cast(ranged.schema[f"_v_{k}"].dataType) for k in sums}
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), zero[k]).alias(f"_o_{k}") for k in sums))
    return (
        ranged.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(own) for k in sums})
        .join(offsets, "_part")
        .select(*df.columns, *((F.col(f"_s_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))
    )
