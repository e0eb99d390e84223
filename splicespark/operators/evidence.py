"""Read evidence: CIGAR walks, positional counts, filters by experiment and group, gene and intron assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .placing import Annotated, Rule, genes_of_junctions

SECONDARY, UNMAPPED, REVERSE, FIRST, SECOND = 0x100, 0x4, 0x10, 0x40, 0x80
BIN = 1_000


def admissible(reads: DataFrame) -> DataFrame:
    """Primary, mapped reads."""
    return reads.filter(F.col("flag").bitwiseAND(F.lit(SECONDARY | UNMAPPED)) == 0)


def read_strand(flag: Column, protocol: str) -> Column:
    """Strand by protocol: none gives `.`; forward takes read 1 (or a single read) along the transcript, reverse read 2."""
    if protocol == "none":
        return F.lit(".")
    back = flag.bitwiseAND(F.lit(REVERSE)) != 0
    second = flag.bitwiseAND(F.lit(SECOND)) != 0
    along = (back == second) if protocol == "forward" else (back != second)
    return F.when(along, "+").otherwise("-")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n:int, op:string>> of a CIGAR text."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHPX=]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def junction_hits(reads: DataFrame, overhang: int = 8, protocol: str = "none") -> DataFrame:
    """experiment, chrom, strand, start, end, offset: each junction of each admissible read with enough bases on both sides.

    Clips at the ends count as no bases. A skip of n bases at reference offset g of a read at pos (0-based) is the junction
    from pos + g to pos + g + n + 1. offset is how far into the read the junction lies, less the overhang: read bases
    before it, with the left soft clip.
    """
    spliced = admissible(reads).filter(F.col("cigar").contains("N"))
    ops = spliced.select("experiment", "chrom", "pos", read_strand(F.col("flag"), protocol).alias("strand"), cigar_ops(F.col("cigar")).alias("ops"))
    body = F.filter("ops", lambda x: ~x["op"].isin("S", "H"))
    clip = F.when(F.get("ops", F.lit(0))["op"] == "S", F.get("ops", F.lit(0))["n"]).otherwise(F.lit(0))
    walked = ops.select("experiment", "chrom", "pos", "strand", clip.alias("clip"), body.alias("body"))
    empty = F.array().cast("array<struct<g:int,r:int,n:int>>")
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("r"), empty.alias("found"))

    def step(a: Column, x: Column) -> Column:
        on_ref = F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(F.lit(0))
        on_read = F.when(x["op"].isin("M", "I", "=", "X"), x["n"]).otherwise(F.lit(0))
        hit = F.array(F.struct(a["g"].alias("g"), a["r"].alias("r"), x["n"].alias("n")))
        return F.struct((a["g"] + on_ref).alias("g"), (a["r"] + on_read).alias("r"), F.when(x["op"] == "N", F.concat(a["found"], hit)).otherwise(a["found"]).alias("found"))

    ended = walked.select("experiment", "chrom", "pos", "strand", "clip", F.aggregate("body", start, step).alias("w"))
    each = ended.select("experiment", "chrom", "strand", "pos", "clip", F.col("w.r").alias("length"), F.explode("w.found").alias("j"))
    kept = each.filter((F.col("j.r") >= overhang) & (F.col("length") - F.col("j.r") >= overhang))
    at = F.col("pos") + F.col("j.g")
    return kept.select("experiment", "chrom", "strand", at.alias("start"), (at + F.col("j.n") + 1).alias("end"), (F.col("j.r") + F.col("clip") - overhang).alias("offset"))


def effective_length(reads: DataFrame, overhang: int = 8) -> DataFrame:
    """experiment, eff_len: positions of a read where a junction can be, from the longest read."""
    return reads.groupBy("experiment").agg(F.greatest(F.lit(0), F.max("seq_len") + 1 - 2 * overhang).alias("eff_len"))


def positional_counts(hits: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Reads for each key and position; summed before the shuffle, so a busy junction is at most its positions."""
    return hits.groupBy(*keys, position).agg(F.count(F.lit(1)).alias("reads"))


def summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """reads and npos (covered positions) for each key."""
    return counts.groupBy(*keys).agg(F.sum("reads").alias("reads"), F.count(F.lit(1)).alias("npos"))


def summary_of_bundles(bundles: DataFrame, keys: list[str], folds: int = 0) -> DataFrame:
    """reads and npos for each key, as summary has them from positional counts, and with folds f0, f1, ...: the reads whose
    position leaves 0, 1, ... when divided by folds. A bundle's reads stay one row; of equal bundles of a key one is kept.

    bundles: keys, positions array<int>, one for each read."""
    rows = bundles.select(*keys, "positions", *([F.transform("positions", lambda p: p % folds).alias("_parts")] if folds else []))
    part = [F.sum(F.size("_parts") - F.size(F.array_remove("_parts", F.lit(r)))).alias(f"f{r}") for r in range(folds)]
    summed = rows.groupBy(*keys).agg(F.sum(F.size("positions")).alias("reads"), F.collect_set("positions").alias("_seen"), *part)
    npos = F.size(F.array_distinct(F.flatten("_seen"))).cast("long")
    return summed.select(*keys, "reads", npos.alias("npos"), *(f"f{r}" for r in range(folds)))


def summary_of_masks(masks: DataFrame, keys: list[str], folds: int = 0) -> DataFrame:
    """What summary_of_bundles has, from bundles whose reads all lie at other places: these are bits, and what is kept of a
    key is a few numbers, whatever its bundles.

    masks: keys, reads (how many), positions (bit p: a read at p, 0 to 62; bit 63: reads at no place that is known), below
    (bit p: a read at -p)."""
    places = {r: sum(1 << p for p in range(r, 63, folds)) for r in range(folds)}
    count = lambda mask, r: F.bit_count(F.col(mask).bitwiseAND(F.lit(places[r]))).cast("long")
    part = [F.sum(count("positions", r) + (count("below", r) if r == 0 else 0)).alias(f"f{r}") for r in range(folds)]  # others under 0 leave a remainder under 0
    summed = masks.groupBy(*keys).agg(F.sum("reads").alias("reads"), F.bit_or("positions").alias("_positions"), F.bit_or("below").alias("_below"), *part)
    npos = (F.bit_count("_positions") + F.bit_count("_below")).cast("long")
    return summed.select(*keys, "reads", npos.alias("npos"), *(f"f{r}" for r in range(folds)))


def experiment_flags(summed: DataFrame, min_reads: int = 3, min_pos: int = 2, min_denovo: int = 5) -> DataFrame:
    """pass_build and pass_denovo by experiment."""
    enough = F.col("npos") >= min_pos
    return summed.withColumns({"pass_build": enough & (F.col("reads") >= min_reads), "pass_denovo": enough & (F.col("reads") >= min_denovo)})


def min_experiments(value: float, size: Column) -> Column:
    """How many experiments of a group must pass: a share below 1, else a number; the group's size at most, 1 at least."""
    wanted = F.ceil(size * F.lit(value)) if value < 1 else F.lit(int(-(-value // 1))).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(size, wanted))


def group_flags(flags: DataFrame, keys: list[str], groups: DataFrame, value: float = 0.5) -> DataFrame:
    """For each key whether some build group has enough experiments that pass; a passing group is enough.

    groups: grp, experiment.
    """
    sizes = groups.groupBy("grp").agg(F.count_distinct("experiment").alias("size"))
    passed = flags.groupBy("grp", *keys).agg(F.sum(F.col("pass_build").cast("long")).alias("build"), F.sum(F.col("pass_denovo").cast("long")).alias("denovo"))
    judged = passed.join(F.broadcast(sizes), "grp").withColumn("need", min_experiments(value, F.col("size")))
    return judged.groupBy(*keys).agg(F.bool_or(F.col("build") >= F.col("need")).alias("pass_build"), F.bool_or(F.col("denovo") >= F.col("need")).alias("pass_denovo"))


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def junction_genes(junctions: DataFrame, genes: DataFrame, exons: DataFrame, annotated: DataFrame | Annotated, reach: int = 10_000, near: int = 400, full_intergene: bool = False) -> DataFrame:
    """chrom, strand, start, end, gene_id, stage: the genes of each distinct junction, of the first stage that has any.

    Candidates lie on the chromosome, on a matching strand (`.` matches both), within the gene widened by `reach`, and not
    with both ends outside it. Stage 1: the gene has the junction annotated; 2: both ends are near full exons of it (start
    up to `near` after an exon's start side, end up to `near` before); 3: inside only. For stages 2 and 3 a junction with
    one end outside the gene needs an end in a full exon, unless `full_intergene`.

    annotated: gene_id, start, end of rows, or a function of starts, ends and genes' starts and ends, which needs no rows of
    pairs. Rows meet junctions by an equi-join; what these leave meets genes by chromosome and bin (placing).
    """
    key = ["chrom", "strand", "start", "end"]
    distinct = junctions.select(*key).distinct()
    if not isinstance(annotated, DataFrame):
        return genes_of_junctions(distinct, genes, exons, Rule(reach, near, full_intergene, annotated))
    start, end = F.col("start"), F.col("end")
    outside = (start < F.col("g_start")) & (end > F.col("g_end"))
    strand = (F.col("strand") == ".") | (F.col("strand") == F.col("g_strand"))
    fits = strand & (start >= F.col("g_start") - reach) & (end <= F.col("g_end") + reach) & ~outside
    place = genes.select("gene_id", "chrom", *(F.col(c).alias(f"g_{c}") for c in ("strand", "start", "end")))
    known = annotated.select("gene_id", "start", "end").distinct().join(place, "gene_id")
    first = distinct.join(known, ["chrom", "start", "end"]).filter(fits).select(*key, "gene_id")
    rest = distinct.join(first.select(*key).distinct(), key, "left_anti")
    return first.withColumn("stage", F.lit(1)).unionByName(genes_of_junctions(rest, genes, exons, Rule(reach, near, full_intergene)))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in all shuffle partitions: few rows that meet many others aren't few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def overlaps(left: DataFrame, right: DataFrame, on: list[str], by: Column | None = None, width: int = BIN) -> DataFrame:
    """Pairs of rows of equal `on` whose [start, end] overlap; right's columns other than `on` get the prefix r_.

    Both sides are put in all bins they touch; a pair counts in the bin where the later of the two starts only.
    """
    right = right.select(*on, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on))
    a = spread(left.select("*", bins(F.col("start"), F.col("end"), width).alias("_bin")), *on, "_bin")
    b = right.select("*", bins(F.col("r_start"), F.col("r_end"), width).alias("_bin"))
    pairs = a.join(b, [*on, "_bin"]).filter((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_bin") == F.floor(F.greatest("start", "r_start") / width)))
    pairs = pairs.drop("_bin")
    return pairs if by is None else pairs.filter(by)


def intron_spans(reads: DataFrame, bases: int = 8, protocol: str = "none") -> DataFrame:
    """experiment, read_id, chrom, strand, pos, first, last, gaps, junctions, length, clip of each admissible read, spliced
    or not: what tells which introns it is evidence for.

    An intron counts that ends at `first` or behind and starts at `last` or before: then `bases` of the read lie before its
    end and behind its start. gaps: where the read and the reference part, as places on both, from the beginning; length:
    bases without clips; clip: clipped bases behind; junctions: the read's own. Reads under `bases` have last -10.
    """
    ops = admissible(reads).select("experiment", "read_id", "chrom", "pos", read_strand(F.col("flag"), protocol).alias("strand"), cigar_ops(F.col("cigar")).alias("ops"))
    body = F.filter("ops", lambda x: ~x["op"].isin("S", "H"))
    final = F.element_at("ops", -1)
    on_read = lambda x: F.when(x["op"].isin("M", "I", "=", "X"), x["n"]).otherwise(F.lit(0))
    on_ref = lambda x: F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(F.lit(0))
    length = F.aggregate("body", F.lit(0), lambda a, x: a + on_read(x))
    clip = F.when((F.size("ops") > 1) & (final["op"] == "S"), final["n"]).otherwise(F.lit(0))
    flat = ops.filter(F.size("ops") > 0).select("*", body.alias("body"), clip.alias("clip")).select("experiment", "read_id", "chrom", "pos", "strand", "clip", "body", length.alias("length"))
    none = F.lit(None).cast("int")
    place = F.struct(F.col("pos").alias("g"), F.lit(0).alias("r"))
    start = F.struct(F.col("pos").alias("g"), F.lit(0).alias("r"), none.alias("first"), none.alias("last"), F.array(place).alias("gaps"), F.array().cast("array<struct<start:int,end:int>>").alias("junctions"))

    def step(a: Column, x: Column) -> Column:
        r, g = a["r"] + on_read(x), a["g"] + on_ref(x)
        read, ref = x["op"].isin("M", "I", "=", "X"), x["op"].isin("M", "D", "N", "=", "X")
        end = F.col("length") - bases
        first = F.when(read & (a["r"] < bases) & (r >= bases), a["g"] + F.when(ref, bases - a["r"]).otherwise(0)).otherwise(a["first"])
        last = F.when(read & (r > end) & (a["r"] <= end), a["g"] + 1 + F.when(ref, end - a["r"]).otherwise(0)).otherwise(a["last"])
        gap = F.when(read != ref, F.concat(a["gaps"], F.array(F.struct(g.alias("g"), r.alias("r"))))).otherwise(a["gaps"])
        junction = F.when(x["op"] == "N", F.concat(a["junctions"], F.array(F.struct(a["g"].alias("start"), (a["g"] + x["n"] + 1).alias("end"))))).otherwise(a["junctions"])
        return F.struct(g.alias("g"), r.alias("r"), first.alias("first"), last.alias("last"), gap.alias("gaps"), junction.alias("junctions"))

    walked = flat.withColumn("w", F.aggregate("body", start, step))
    return walked.select("experiment", "read_id", "chrom", "strand", "pos", F.coalesce("w.first", F.lit(-10)).alias("first"), F.coalesce("w.last", F.lit(-10)).alias("last"), "w.gaps", "w.junctions", "length", "clip")


def intron_hits(spans: DataFrame, introns: DataFrame, bases: int = 8) -> DataFrame:
    """experiment, read_id, gene_id, start, end, offset: the introns that each read is evidence for, and how far the
    intron's start lies from the last base that may be in it, in read bases.

    spans: of intron_spans; introns: gene_id, chrom, strand, start, end. Strands must fit, and a read with a junction that
    meets the intron is evidence against it. Reads meet introns by chromosome and bin.
    """
    own = introns.select("gene_id", "chrom", F.col("strand").alias("i_strand"), "start", "end")
    wide = spans.filter("last >= 0").select("experiment", "read_id", "chrom", "strand", "pos", "first", "last", "gaps", "junctions", "length", "clip", F.least("first", "last").alias("start"), F.greatest("first", "last").alias("end"))
    pairs = overlaps(wide, own, ["chrom"]).filter("r_end >= first and r_start <= last and (strand = '.' or strand = r_i_strand)")
    crossed = F.exists("junctions", lambda j: (j["start"] <= F.col("r_end")) & (F.col("r_start") <= j["end"]))
    before = F.element_at(F.filter("gaps", lambda g: g["g"] < F.col("r_start")), -1)
    inside = F.col("pos") + 1 >= F.col("r_start")
    relative = F.when(inside, F.col("pos") + 1 - F.col("r_start")).otherwise(before["g"] + 1 - F.col("r_start") - before["r"])
    return pairs.filter(~crossed).select("experiment", "read_id", F.col("r_gene_id").alias("gene_id"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), (F.col("length") - bases + relative + F.col("clip")).alias("offset"))


def intron_reads(hits: DataFrame) -> DataFrame:
    """gene_id, start, end, experiment, reads: reads of each intron; a read counts once. hits: of intron_hits."""
    return hits.groupBy("gene_id", "start", "end", "experiment").agg(F.count_distinct("read_id").alias("reads"))


def reads_of_introns(spans: DataFrame, introns: DataFrame) -> DataFrame:
    """intron_reads of the introns (gene_id, chrom, strand, start, end) without a shuffle of all hits: reads with one
    alignment in their experiment, which meets an intron once, are added up before the shuffle; only hits of the others
    are made distinct. Introns of equal place meet reads once."""
    alike = alike_introns(introns)
    counted = spans.filter("read_id is not null").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("experiment", "read_id")))
    hits = lambda by: intron_hits(counted.filter(by).drop("_n"), alike)
    single = hits("_n = 1").groupBy("gene_id", "start", "end", "experiment").agg(F.count(F.lit(1)).alias("reads"))
    both = single.unionByName(intron_reads(hits("_n > 1")))
    return of_all_genes(both.groupBy("gene_id", "start", "end", "experiment").agg(F.sum("reads").alias("reads")), alike)


def alike_introns(introns: DataFrame) -> DataFrame:
    """gene_id (the first), chrom, strand, start, end, gene_ids: the introns of equal place as one."""
    return introns.groupBy("chrom", "strand", "start", "end").agg(F.min("gene_id").alias("gene_id"), F.collect_set("gene_id").alias("gene_ids"))


def of_all_genes(found: DataFrame, alike: DataFrame) -> DataFrame:
    """What was found of the first gene's introns for all genes that have them. alike: of alike_introns."""
    genes = alike.select("gene_id", "start", "end", "gene_ids")
    return found.join(genes, ["gene_id", "start", "end"]).withColumn("gene_id", F.explode("gene_ids")).drop("gene_ids")


def intron_rates(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """experiment, gene_id, start, end, bin, rate: reads of each of an intron's eff_len bins over the positions in it.
    hits: of intron_hits; lengths: experiment, eff_len (> 0), a row for each of the few experiments."""
    size = (F.col("end") - F.col("start") + 1 + F.col("eff_len")).cast("long")
    placed = hits.join(F.broadcast(lengths), "experiment").filter((F.col("offset") >= 0) & (F.col("offset") < size) & (F.col("eff_len") > 0))
    found, positions = intron_bin(F.col("offset").cast("long"), size, F.col("eff_len"))
    each = placed.select("experiment", "gene_id", "start", "end", found.cast("int").alias("bin"), positions.alias("positions"))
    return each.groupBy("experiment", "gene_id", "start", "end", "bin").agg((F.count(F.lit(1)) / F.max("positions")).alias("rate"))


def intron_summary(rates: DataFrame) -> DataFrame:
    """experiment, gene_id, start, end, reads (whole part of the rates' sum), npos (bins with reads)."""
    return rates.groupBy("experiment", "gene_id", "start", "end").agg(F.floor(F.sum("rate") + 1e-9).alias("reads"), F.count(F.lit(1)).alias("npos"))


def matched_introns(found: DataFrame, introns: DataFrame) -> DataFrame:
    """gene_id, start, end, experiment, reads, npos: an experiment's introns given to the splicegraph's introns (gene_id,
    start, end) of their gene that they meet, both a base wider on either side, so that introns without a base meet too.
    Of several that meet one the last counts, by start and end. A gene's introns are few, so they meet by gene."""
    own = introns.select("gene_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    met = found.join(own, "gene_id").filter((F.col("i_start") - 2 < F.col("end")) & (F.col("i_end") > F.col("start") - 2))
    last = F.max(F.struct("start", "end", "reads", "npos")).alias("x")
    return met.groupBy("gene_id", "i_start", "i_end", "experiment").agg(last).select("gene_id", F.col("i_start").alias("start"), F.col("i_end").alias("end"), "experiment", "x.reads", "x.npos")


def intron_bin(offset: Column, length: Column, eff_len: int | Column) -> tuple[Column, Column]:
    """Bin of a raw offset in [0, length) dealt to eff_len bins, and the bin's positions: the first length mod eff_len
    bins hold one more."""
    small = F.floor(length / eff_len)
    extra = length % eff_len
    edge = extra * (small + 1)
    found = F.when(offset < edge, F.floor(offset / (small + 1))).otherwise(extra + F.floor((offset - edge) / F.greatest(small, F.lit(1))))
    return found, F.when(found < extra, small + 1).otherwise(small)


def intron_flags(bins: DataFrame, least: float = 0.01, share: float = 0.5, spread: int = 0) -> DataFrame:
    """Adds covered (share of an intron's bins with a rate of `least` or more), passed (it is `share` or more) and reliable
    (the same, when each covered bin also covers the `spread` bins behind it). bins: also rates array<double>."""
    n = F.size("rates")
    marked = F.transform("rates", lambda x: x >= least)
    spread_out = F.transform(marked, lambda _, i: F.exists(F.slice(marked, F.greatest(F.lit(1), i + 1 - spread), F.least(i + 1, F.lit(spread + 1))), lambda y: y))
    of = lambda a: F.size(F.filter(a, lambda x: x)) / n
    return bins.withColumns({"covered": of(marked), "passed": of(marked) >= share, "reliable": of(spread_out) >= share})


def junction_id(chrom: Column, strand: Column, start: Column, end: Column) -> Column:
    """chrom:strand:start-end, a junction's id in count files."""
    return F.concat(chrom, F.lit(":"), strand, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parsed_junction_id(name: Column) -> Column:
    """struct chrom, strand, start, end of an id; the chromosome's name may hold colons."""
    part = lambda k: F.regexp_extract(name, r"^(.*):([-+.]):(\d+)-(\d+)$", k)
    return F.struct(part(1).alias("chrom"), part(2).alias("strand"), part(3).try_cast("int").alias("start"), part(4).try_cast("int").alias("end"))


def matched_counts(counts: DataFrame, junctions: DataFrame) -> DataFrame:
    """gene_id, start, end, experiment, reads, npos: counts by chrom, strand, start, end and experiment given to the
    splicegraph's junctions (gene_id, chrom, strand, start, end) of equal coordinates, where the counts' strand is the
    gene's or `.`."""
    own = junctions.select("gene_id", "chrom", F.col("strand").alias("g_strand"), "start", "end")
    met = counts.join(own, ["chrom", "start", "end"]).filter((F.col("strand") == ".") | (F.col("strand") == F.col("g_strand")))
    return met.groupBy("gene_id", "start", "end", "experiment").agg(F.sum("reads").alias("reads"), F.sum("npos").alias("npos"))


def source_lsvs(junctions: DataFrame) -> DataFrame:
    """gene_id, lsv_id, junc_idx, start, end: junctions of a gene that leave one place, where there are two or more."""
    w = W.partitionBy("gene_id", "start")
    ranked = junctions.select("gene_id", "start", "end").distinct().withColumns({"n": F.count(F.lit(1)).over(w), "junc_idx": F.row_number().over(w.orderBy("end")) - 1})
    return ranked.filter("n > 1").select("gene_id", F.concat_ws(":", "gene_id", F.lit("s"), F.col("start").cast("string")).alias("lsv_id"), "junc_idx", "start", "end")


def lsv_coverage(lsvs: DataFrame, counts: DataFrame, experiments: DataFrame) -> DataFrame:
    """lsv_id, junc_idx, experiment, reads, npos for every experiment, 0 where an experiment lacks the junction. experiments:
    the few experiments of a build."""
    every = lsvs.crossJoin(F.broadcast(experiments.select("experiment").distinct()))
    found = every.join(counts, ["gene_id", "start", "end", "experiment"], "left")
    return found.select("lsv_id", "junc_idx", "experiment", F.coalesce("reads", F.lit(0).cast("long")).alias("reads"), F.coalesce("npos", F.lit(0).cast("long")).alias("npos"))
