"""Stored splicegraphs and quantifications: tables in slices of genes, so that a gene's rows are read from one slice."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = 64
TABLES = ("genes", "exons", "junctions", "introns", "alt_starts", "alt_ends", "junction_reads", "intron_reads", "gene_overlaps")


def slice_of(gene: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(gene), F.lit(slices)).cast("int")


def sliced(rows: DataFrame, slices: int) -> DataFrame:
    """The rows with their gene's slice, dealt by slice and gene: a task writes few slices, a large slice takes many tasks."""
    gene = "gene_id" if "gene_id" in rows.columns else "gene_id_1"
    return rows.withColumn("slice", slice_of(F.col(gene), slices)).repartitionByRange("slice", gene)


def write_splicegraph(tables: dict[str, DataFrame], path: str, slices: int = SLICES) -> None:
    """Each table (of TABLES) in a folder of its own, by slice."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"no splicegraph tables: {sorted(unknown)}")
    for name, rows in tables.items():
        sliced(rows, slices).write.partitionBy("slice").parquet(f"{path}/{name}", mode="overwrite")


def read_splicegraph(spark: SparkSession, path: str, name: str, genes: list[str] | None = None, slices: int = SLICES) -> DataFrame:
    """A table of a stored splicegraph; of the genes named, where some are: only their slices are read."""
    rows = spark.read.parquet(f"{path}/{name}")
    if genes is None:
        return rows.drop("slice")
    ids = [F.lit(g) for g in genes]
    return rows.filter(F.col("slice").isin(*(slice_of(g, slices) for g in ids)) & F.col("gene_id").isin(*genes)).drop("slice")


def write_quantifications(rows: DataFrame, path: str, group: str = "grp", metadata: dict | None = None) -> None:
    """Quantified connections (means, statistics, arrays of bins) in a folder for each group, the run's metadata beside."""
    rows.hint("rebalance", group).write.partitionBy(group).parquet(path, mode="overwrite")  # few files, large groups in several
    text = json.dumps(metadata or {}, indent=2)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read_quantifications(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    lines = spark.read.text(f"{path}.meta", wholetext=True).collect()
    return spark.read.parquet(path), json.loads(lines[0].value) if lines else {}


def write_result_slices(rows: DataFrame, path: str, slices: int = SLICES) -> None:
    """A result table split by gene: tab-separated files with headers, a folder for each slice."""
    sliced(rows, slices).write.partitionBy("slice").csv(path, sep="\t", header=True, mode="overwrite")


def recombined(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The slices of a result table as one."""
    return spark.read.csv(path, sep="\t", header=True, schema=f"{schema}, slice int").drop("slice")


def write_counts(rows: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Counts of junctions and introns (experiment, id, is_intron, reads, npos, and replicates if there are any), a folder for
    each experiment, in order of id; the run's metadata beside."""
    rows.repartitionByRange("experiment", "id").sortWithinPartitions("experiment", "id").write.partitionBy("experiment").parquet(path, mode="overwrite")
    rows.sparkSession.createDataFrame([(json.dumps(metadata or {}, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read_counts(spark: SparkSession, path: str, experiments: list[int] | None = None) -> DataFrame:
    """Stored counts; of the experiments named, where some are: only their folders are read."""
    rows = spark.read.parquet(path)
    return rows if experiments is None else rows.filter(F.col("experiment").isin(*experiments))


def write_lsv_coverage(coverage: DataFrame, types: DataFrame, path: str) -> None:
    """Coverage of LSVs' connections (experiment, lsv_id, junc_idx, ...) by experiment, and the table of the LSVs' types."""
    coverage.repartitionByRange("experiment", "lsv_id").sortWithinPartitions("experiment", "lsv_id", "junc_idx").write.partitionBy("experiment").parquet(f"{path}/coverage", mode="overwrite")
    types.select("lsv_id", "lsv_type").distinct().write.parquet(f"{path}/types", mode="overwrite")


def read_lsv_coverage(spark: SparkSession, path: str, experiments: list[int] | None = None) -> DataFrame:
    """Stored coverage with lsv_type."""
    return read_counts(spark, f"{path}/coverage", experiments).join(spark.read.parquet(f"{path}/types"), "lsv_id", "left")


def write_result_files(rows: DataFrame, path: str, metadata: dict[str, dict], key: str = "comparison") -> None:
    """A tab-separated file for each value of key, in a folder of its own: its metadata as JSON lines that begin with `# `, the
    header, and the rows in order; NA for nulls. A file has a row for each LSV of a comparison at most, and one task writes
    it."""
    names = [c for c in rows.columns if c != key]
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in names))
    body = rows.select(key, F.lit(1 << 30).alias("_at"), text.alias("value"))
    heads = [(k, i, line) for k, m in metadata.items() for i, line in enumerate([*("# " + x for x in json.dumps(m, indent=2).split("\n")), "\t".join(names)])]
    head = rows.sparkSession.createDataFrame(heads, f"{key} string, _at int, value string")
    whole = head.unionByName(body.join(F.broadcast(head.select(key).distinct()), key, "left_semi"))
    whole.repartition(key).sortWithinPartitions(key, "_at", "value").drop("_at").write.mode("overwrite").partitionBy(key).text(path)


def read_result_files(spark: SparkSession, path: str, key: str = "comparison") -> tuple[DataFrame, DataFrame]:
    """The rows of all result files of a folder, as texts, with key; and key, metadata (JSON text) of their headers."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit("#"))).select(key, F.struct(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^#\s?", "").alias("text")).alias("x"))
    heads = lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias("metadata"))
    return spark.read.option("comment", "#").csv(path, sep="\t", header=True, nullValue="NA"), heads
