"""Readers and writers: annotation, alignments, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.histogram import let

GFF_COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def parsed_gff(lines: DataFrame) -> DataFrame:
    """GFF3 lines (column value) as rows: `.` is null, percent signs are decoded, attributes a map; a repeated key's values
    are joined by commas. Comments and lines without nine columns are left out.

    Columns and attributes come from explode, which filters on them don't pass: a line is split once, its attributes are
    read once, and not at all where the other columns rule it out."""
    kept = lines.filter(~F.startswith("value", F.lit("#"))).select(once(F.split("value", "\t")).alias("c")).filter(F.size("c") == 9)
    at = lambda k: F.get("c", F.lit(k))
    field = lambda k: F.when(at(k) != ".", at(k))
    placed = kept.select(decoded(field(0)).alias("seqid"), field(1).alias("source"), field(2).alias("type"), field(3).try_cast("int").alias("start"), field(4).try_cast("int").alias("end"), field(5).try_cast("double").alias("score"), field(6).alias("strand"), field(7).alias("phase"), at(8).alias("_text"))
    return placed.select("*", once(F.when(F.col("_text") != ".", gff_attributes(F.col("_text")))).alias("attributes")).drop("_text")


def once(value: Column) -> Column:
    """value, as a generator's one row."""
    return F.explode_outer(F.array(value))


def decoded(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("%")), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)


def gff_attributes(text: Column) -> Column:
    """The map of a GFF3 line's ninth column."""
    pairs = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(pairs, lambda x: F.struct(decoded(F.trim(F.substring_index(x, "=", 1))).alias("key"), decoded(F.regexp_extract(x, "=(.*)$", 1)).alias("value")))
    values = lambda e, key: F.array_join(F.transform(F.filter(e, lambda x: x["key"] == key), lambda x: x["value"]), ",")
    return let(entries, lambda e: let(F.array_distinct(F.transform(e, lambda x: x["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda key: values(e, key)))))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """A GFF3 file, plain or gz."""
    return parsed_gff(spark.read.text(path))


# Accepted feature types.
GENES = ("gene", "ncRNA_gene", "pseudogene", "bidirectional_promoter_lncRNA")
TRANSCRIPTS = ("mRNA", "transcript", "lnc_RNA", "miRNA", "ncRNA", "rRNA", "scRNA", "snRNA", "snoRNA", "tRNA", "pseudogenic_transcript", "C_gene_segment", "D_gene_segment", "J_gene_segment", "V_gene_segment", "unconfirmed_transcript", "three_prime_overlapping_ncrna")


def annotation(gff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """genes (gene_id, gene_name, chrom, strand, start, end) and transcript_exons (gene_id, transcript_id, start, end).

    Features without strand or sequence go; ids are ID, else gene_id; names Name, else gene_name, else the id. Exons go to
    transcripts and these to genes by Parent; what has no parent here is left out. A gene id used twice is an error.
    """
    a = lambda *keys: F.coalesce(*(F.col("attributes")[k] for k in keys))
    placed = gff.filter(F.col("strand").isNotNull() & F.col("seqid").isNotNull())
    genes = placed.filter(F.col("type").isin(*GENES)).select(a("ID", "gene_id").alias("gene_id"), a("Name", "gene_name", "ID", "gene_id").alias("gene_name"), F.col("seqid").alias("chrom"), "strand", "start", "end")
    twice = genes.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    checked = genes.join(twice, "gene_id").withColumn("gene_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("gene id used twice: "), F.col("gene_id")))).otherwise(F.col("gene_id"))).drop("n")
    transcripts = placed.filter(F.col("type").isin(*TRANSCRIPTS)).select(a("ID", "transcript_id").alias("transcript_id"), a("Parent").alias("gene_id"))
    known = transcripts.join(genes.select("gene_id"), "gene_id", "left_semi")
    exons = placed.filter(F.col("type") == "exon").select(F.explode(F.split(a("Parent"), ",")).alias("transcript_id"), "start", "end")
    return checked, exons.join(known, "transcript_id").select("gene_id", "transcript_id", "start", "end")


def parsed_gtf(lines: DataFrame) -> DataFrame:
    """GTF lines (column value) of long reads: type, gene_id, transcript_id, chrom, strand, start, end. Comments and lines
    without nine columns are left out; an attribute that is missing is null."""
    kept = lines.filter(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).filter(F.size("c") == 9)
    at = lambda k: F.get("c", F.lit(k))
    attribute = lambda k: F.nullif(F.regexp_extract(at(8), f'(?:^|[; ]){k} +"([^"]*)"', 1), F.lit(""))
    return kept.select(at(2).alias("type"), attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), at(0).alias("chrom"), at(6).alias("strand"), at(3).try_cast("int").alias("start"), at(4).try_cast("int").alias("end"))


def parsed_counts(lines: DataFrame) -> DataFrame:
    """transcript_id, count (rounded up) from tab-separated lines whose first two columns these are, whatever their names;
    a line whose second column is no number is the header."""
    c = lines.select(F.split("value", "\t").alias("c")).select(F.get("c", F.lit(0)).alias("transcript_id"), F.ceil(F.get("c", F.lit(1)).try_cast("double")).alias("count"))
    return c.filter("count is not null")


def read_long_reads(spark: SparkSession, gtf: str, counts: str) -> tuple[DataFrame, DataFrame]:
    """exons (gene_id, transcript_id, start, end) and counts (transcript_id, count) of a long-read run."""
    exons = parsed_gtf(spark.read.text(gtf)).filter("type = 'exon' and gene_id is not null and transcript_id is not null")
    return exons.select("gene_id", "transcript_id", "start", "end"), parsed_counts(spark.read.text(counts))


def parsed_sam(lines: DataFrame, experiment: str) -> DataFrame:
    """SAM lines (column value) as alignments; header lines are left out."""
    at = lambda k: F.get("c", F.lit(k))
    c = lines.filter(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 11)
    return c.select(F.lit(experiment).alias("experiment"), at(0).alias("read_id"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), (at(3).cast("int") - 1).alias("pos"), at(5).alias("cigar"), F.length(at(9)).alias("seq_len"))


def read_sam(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    return parsed_sam(spark.read.text(path), experiment)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result tables (tab-separated, with header; many files) with `comparison`, the file's name without its ending."""
    rows = spark.read.option("comment", "#").csv(path, sep="\t", header=True)
    return rows.withColumn("comparison", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.tsv)?(?:\.gz)?$", 1))


def write_results(rows: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Tab-separated part files with headers; metadata goes to a JSON text beside them."""
    rows.write.csv(path, sep="\t", header=True, mode="overwrite")
    if metadata:
        import json

        rows.sparkSession.createDataFrame([(json.dumps(metadata, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def write_counts(rows: DataFrame, path: str) -> None:
    """Counts or coverage by experiment, each in a folder of its own."""
    rows.write.partitionBy("experiment").parquet(path, mode="overwrite")


def subset(tables: dict[str, DataFrame], genes: DataFrame) -> dict[str, DataFrame]:
    """Of each table with a gene_id the rows of the given genes; a table of ids of any size is a join like any other."""
    return {k: t.join(genes.select("gene_id").distinct(), "gene_id", "left_semi") if "gene_id" in t.columns else t for k, t in tables.items()}
