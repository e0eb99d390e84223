"""Summaries of LSVs: annotation flags, reads, text rows, index columns, presence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lsv as L


def psi_rows(quant: DataFrame) -> DataFrame:
    """A row for each LSV: its parsed id and its connections' values as texts with semicolons, in order.

    quant: lsv_id, junc_idx, mean_psi, reads."""
    rows = quant.groupBy("lsv_id").agg(F.sort_array(F.collect_list(F.struct("junc_idx", "mean_psi", "reads"))).alias("c"))
    start, end = L.reference_exon(F.col("lsv_id"))
    return rows.select(L.gene_of(F.col("lsv_id")).alias("gene_id"), "lsv_id", L.kind_of(F.col("lsv_id")).alias("kind"), start.alias("ref_start"), end.alias("ref_end"), F.size("c").alias("connections"), L.joined(F.col("c.mean_psi"), "%.4f").alias("mean_psi"), F.array_join(F.col("c.reads").cast("array<string>"), ";").alias("reads"))


def annotated_flags(junctions: DataFrame, known: DataFrame) -> DataFrame:
    """Adds de_novo: not among the annotated junctions or introns of the gene."""
    marked = known.select("gene_id", "start", "end").distinct().withColumn("_known", F.lit(True))
    return junctions.join(marked, ["gene_id", "start", "end"], "left").withColumn("de_novo", F.col("_known").isNull()).drop("_known")


def reads_by_experiment(summed: DataFrame, experiments: list[int]) -> DataFrame:
    """A row for each connection, a column with the reads of each experiment; none is 0."""
    wide = summed.groupBy("lsv_id", "junc_idx").pivot("experiment", experiments).agg(F.sum("reads"))
    return wide.na.fill(0).select("lsv_id", "junc_idx", *(F.col(str(e)).alias(f"reads_{e}") for e in experiments))


def group_reads(summed: DataFrame) -> DataFrame:
    """grp, lsv_id, junc_idx, reads (sum over experiments), median_reads (rounded up)."""
    return summed.groupBy("grp", "lsv_id", "junc_idx").agg(F.sum("reads").alias("reads"), F.ceil(F.median("reads")).alias("median_reads"))


def gene_extents(exons: DataFrame) -> DataFrame:
    """gene_id, start, end, exons over annotated exons."""
    return exons.groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("exons"))


def containing_exons(junctions: DataFrame, exons: DataFrame) -> DataFrame:
    """gene_id, start, end with the exons that hold the junction's start (donor) and its end (acceptor); null: none."""
    e = exons.select("gene_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    pairs = junctions.select("gene_id", "start", "end").distinct().join(e, "gene_id", "left")
    inside = lambda c: F.min(F.when((F.col(c) >= F.col("e_start")) & (F.col(c) <= F.col("e_end")), F.col("e_start")))
    return pairs.groupBy("gene_id", "start", "end").agg(inside("start").alias("donor_exon"), inside("end").alias("acceptor_exon"))


def exons_with_reads(exons: DataFrame, junctions: DataFrame) -> DataFrame:
    """Exons that a junction with reads begins or ends in."""
    j = junctions.filter("reads > 0").select("gene_id", F.explode(F.array("start", "end")).alias("at")).distinct()
    hit = exons.join(j, "gene_id").filter("at between start and end").select("gene_id", "start", "end").distinct()
    return hit


def presence(annotated: Column, has_reads: Column) -> Column:
    return F.when(~annotated, "de_novo").when(has_reads, "annotated_with_reads").otherwise("annotated_only")


def overlap_class(short: Column, long: Column, annotation: Column) -> Column:
    """One of seven disjoint classes by where a junction is found."""
    parts = F.array_compact(F.array(F.when(short, "short"), F.when(long, "long"), F.when(annotation, "annotation")))
    return F.array_join(parts, "+")


def index_page(index: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a sorted index (a limit is what is asked for)."""
    return index.orderBy(*order).offset(offset).limit(limit)


def type_columns(types: DataFrame) -> DataFrame:
    """lsv_type with what it says: intron, binary, complex, exon count, exon skipping, A5SS, A3SS."""
    t = F.col("lsv_type")
    a5, a3 = L.alternative_sites(t)
    return types.select("lsv_type", L.has_intron(t).alias("has_intron"), L.is_binary(t).alias("is_binary"), (~L.is_binary(t)).alias("is_complex"), L.exon_count(t).alias("exon_count"), L.skips_exon(t).alias("exon_skipping"), a5.alias("a5ss"), a3.alias("a3ss"))


def built_types(connections: DataFrame) -> DataFrame:
    """lsv_id, lsv_type of LSVs: in strand order, the number of the reference's site, the number of the other exon, the site
    among that exon's sites and how many those are; `i` for an intron.

    connections: lsv_id, kind, strand, ref, exon, at, is_intron."""
    w = W.partitionBy("lsv_id")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    j = connections.filter("not is_intron")
    per_exon = w.orderBy(sign * F.col("exon"))
    site = W.partitionBy("lsv_id", "exon").orderBy(sign * F.col("at"))
    ranked = j.withColumns({"s": F.dense_rank().over(w.orderBy(sign * F.col("ref"))), "e": F.dense_rank().over(per_exon), "k": F.dense_rank().over(site)})
    sites = F.max("k").over(W.partitionBy("lsv_id", "exon"))
    named = ranked.withColumn("n", sites).select("lsv_id", "kind", F.struct("s", "e", "k", F.concat(F.col("s").cast("string"), F.lit("e"), F.col("e").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit("o"), F.col("n").cast("string")).alias("t")).alias("part"))
    introns = connections.filter("is_intron").select("lsv_id").distinct().withColumn("intron", F.lit("|i"))
    joined = named.groupBy("lsv_id", "kind").agg(F.array_join(F.transform(F.array_distinct(F.sort_array(F.collect_list("part"))), lambda x: x["t"]), "|").alias("parts"))
    text = F.concat("kind", F.lit("|"), "parts", F.coalesce("intron", F.lit("")))
    return joined.join(introns, "lsv_id", "left").select("lsv_id", F.when(F.length(text) > 245, F.concat("kind", F.lit("|na"))).otherwise(text).alias("lsv_type"))


def browser_link(base: str, db: Column, chrom: Column, start: Column, end: Column) -> Column:
    """A genome browser's URL of a range; half exons (-1) are to be padded by the caller."""
    return F.concat(F.lit(base + "?db="), F.url_encode(db), F.lit("&position="), F.url_encode(F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))))


def inconsistent_groups(files: DataFrame) -> DataFrame:
    """Groups that don't hold the same experiments in every file. files: file, grp, experiment."""
    sets = files.distinct().groupBy("file", "grp").agg(F.sort_array(F.collect_set("experiment")).alias("members"))
    return sets.groupBy("grp").agg(F.count_distinct("members").alias("versions")).filter("versions > 1")


def changing_lsvs(means: DataFrame, threshold: float = 0.2, prob: float | None = None) -> DataFrame:
    """lsv with a connection whose mean is `threshold` or more and, if asked for, one that changes with enough probability.

    means: lsv, mean, p."""
    wanted = F.bool_or(F.abs("mean") >= threshold)
    if prob is not None:
        wanted = wanted & F.bool_or(F.col("p") >= prob)
    return means.groupBy("lsv").agg(wanted.alias("ok")).filter("ok").select("lsv")


def index_filter(index: DataFrame, text: str = "", **flags: bool) -> DataFrame:
    """Rows that hold the text in any column, whatever the case, and have the given values of the boolean columns."""
    for name, value in flags.items():
        index = index.filter(F.col(name) == value)
    return index.filter(F.contains(F.lower(F.concat_ws("\t", *(F.col(c).cast("string") for c in index.columns))), F.lit(text.lower()))) if text else index


def introns_of(exons: DataFrame, introns: DataFrame) -> DataFrame:
    """lsv_id with the introns that begin right behind one of its exons. exons: lsv_id, gene_id, end."""
    i = introns.select("gene_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    return exons.join(i, "gene_id").filter("i_start = end + 1").select("lsv_id", "gene_id", F.col("i_start").alias("start"), F.col("i_end").alias("end")).distinct()


def merged_samples(files: DataFrame) -> DataFrame:
    """psi by group, experiment, lsv_id and junc_idx over several files: the same result in two files counts once (that of
    the first file). files: file and these."""
    keys = ["grp", "experiment", "lsv_id", "junc_idx"]
    return files.groupBy(*keys).agg(F.min_by("psi", "file").alias("psi"))
