"""Gene structure by windows and set logic: transcripts, merged exons, gene clusters, introns, LSVs and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .evidence import BIN, bins, overlaps, spread
from .evidence import min_experiments as min_experiments_of


def transcript_junctions(exons: DataFrame) -> DataFrame:
    """gene_id, transcript_id, start, end: from the end of an exon to the start of the next; -2 marks the missing side of
    the first and the last row of a transcript."""
    w = W.partitionBy("gene_id", "transcript_id").orderBy("start", "end")
    inner = exons.select("gene_id", "transcript_id", F.lag("end").over(w).alias("from"), F.col("start").alias("to"), F.lead("start").over(w).alias("next"), "end")
    first = inner.select("gene_id", "transcript_id", F.coalesce("from", F.lit(-2)).alias("start"), F.col("to").alias("end"))
    last = inner.filter("next is null").select("gene_id", "transcript_id", F.col("end").alias("start"), F.lit(-2).alias("end"))
    return first.unionByName(last)


def merged_exons(exons: DataFrame) -> DataFrame:
    """gene_id, start, end: overlapping exons of a gene as one (gaps and islands)."""
    w = W.partitionBy("gene_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = exons.select("gene_id", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    island = cut.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("gene_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def annotated_introns(exons: DataFrame) -> DataFrame:
    """gene_id, start, end: gaps of a transcript that lie inside an exon of another one of the gene."""
    gaps = transcript_junctions(exons).filter("start <> -2 and end <> -2").select("gene_id", (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end")).filter("start <= end").distinct()
    held = exons.select("gene_id", F.col("start").alias("e_start"), F.col("end").alias("e_end")).distinct()
    return gaps.join(held, "gene_id").filter("e_start < start and end < e_end").select("gene_id", "start", "end").distinct()


def gene_clusters(genes: DataFrame) -> DataFrame:
    """gene_id, cluster: genes of a chromosome that overlap directly or by way of others; cluster is the first start."""
    w = W.partitionBy("chrom").orderBy("start", "end", "gene_id")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = genes.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    island = cut.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.select("gene_id", "chrom", F.min("start").over(W.partitionBy("chrom", "island")).alias("cluster"))


def gene_overlaps(genes: DataFrame, most: int = 1000) -> DataFrame:
    """gene_id_1, gene_id_2: unordered pairs of different genes, once.

    Genes that begin at one place are lists of at most `most`. A gene meets the lists that begin in it as a whole, by
    chromosome and bin, so that hardly more is looked at than the pairs there are. Pairs, which are many more than genes, are
    shuffled only of genes that have several rows (or end before they begin): of the others each pair comes once.
    """
    rows = genes.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    counted = genes.join(rows, "gene_id").select("gene_id", "chrom", "start", "end", ((F.col("n") > 1) | (F.col("start") > F.col("end"))).alias("several"))
    one, several = counted.filter("not several"), counted.filter("several")
    ordered = lambda a, b: (F.least(a, b).alias("gene_id_1"), F.greatest(a, b).alias("gene_id_2"))
    nth = F.row_number().over(W.partitionBy("chrom", "start").orderBy("gene_id"))
    lists = one.withColumn("_part", F.floor((nth - 1) / most)).groupBy("chrom", F.col("start").alias("from"), "_part").agg(F.collect_list("gene_id").alias("ids"))
    in_bins = spread(one.select("gene_id", "chrom", "start", "end", bins(F.col("start"), F.col("end")).alias("_bin")), "chrom", "_bin")
    met = in_bins.join(lists.withColumn("_bin", F.floor(F.col("from") / BIN)), ["chrom", "_bin"]).filter("from between start and end")
    each = met.select("gene_id", (F.col("from") > F.col("start")).alias("later"), F.explode("ids").alias("other")).filter("later or gene_id < other")
    again = overlaps(several, counted, ["chrom"], F.expr("gene_id <> r_gene_id")).select(*ordered("gene_id", "r_gene_id")).distinct()
    return each.select(*ordered("gene_id", "other")).unionByName(again)


def potential_introns(exons: DataFrame) -> DataFrame:
    """gene_id, start, end: between an exon and the next."""
    w = W.partitionBy("gene_id").orderBy("start", "end")
    return exons.select("gene_id", (F.lag("end").over(w) + 1).alias("start"), (F.col("start") - 1).alias("end")).filter("start <= end + 1")


def connected_introns(introns: DataFrame, gaps: DataFrame) -> DataFrame:
    """gene_id, start, end: introns clipped to the gaps between exons that they meet; one that goes on past the next exon
    is split by that."""
    g = gaps.select("gene_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    met = introns.join(g, "gene_id").filter("start <= g_end and g_start <= end")
    return met.select("gene_id", F.greatest("start", "g_start").alias("start"), F.least("end", "g_end").alias("end")).distinct()


def usable(edges: DataFrame) -> DataFrame:
    """Connections that can be of an LSV: both ends in different exons, no boundary of a transcript (-2), not simplified
    (column simplify, where there is one; null isn't simplified)."""
    kept = edges.filter("src <> dst and start <> -2 and end <> -2")
    return kept.filter(~F.coalesce("simplify", F.lit(False))) if "simplify" in edges.columns else kept


def usable_sides(edges: DataFrame) -> DataFrame:
    """gene_id, exon, side (s: leaving it, t: entering it), and its usable and passing connections.

    edges: gene_id, src, dst, start, end, is_intron, passed, and simplify if simplified; an exitron has one exon twice."""
    edges = usable(edges)
    leaving = edges.select("gene_id", F.col("src").alias("exon"), F.lit("s").alias("side"), "passed")
    entering = edges.select("gene_id", F.col("dst").alias("exon"), F.lit("t").alias("side"), "passed")
    return leaving.unionByName(entering).groupBy("gene_id", "exon", "side").agg(F.count(F.lit(1)).alias("usable"), F.sum(F.col("passed").cast("long")).alias("passing"))


def lsv_sides(sides: DataFrame) -> DataFrame:
    """Sides that are LSVs: two usable connections or more, one that passes at least."""
    return sides.filter("usable >= 2 and passing >= 1")


def constitutive(edges: DataFrame) -> DataFrame:
    """Junctions that are the only usable connection out of their exon, pass, and enter an exon whose entering side has no
    other."""
    edges = usable(edges)
    out = edges.groupBy("gene_id", "src").agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy("gene_id", "dst").agg(F.count(F.lit(1)).alias("n_in"))
    return edges.join(out, ["gene_id", "src"]).join(into, ["gene_id", "dst"]).filter("n_out = 1 and n_in = 1 and passed").drop("n_out", "n_in")


def exon_lsvs(exons: DataFrame, junctions: DataFrame, introns: DataFrame) -> DataFrame:
    """gene_id, lsv_id, kind (s, t), junc_idx, start, end, is_intron: the connections of each side of an exon that has two
    or more.

    exons: gene_id, strand, start, end (full); junctions: gene_id, start, end, which leave the exon that holds their start
    and enter the one that holds their end; introns: gene_id, start, end, which touch the exons beside them. A side that is
    left along the strand is a source. Connections are in order of place along the strand, the intron last.
    """
    own = exons.select("gene_id", "strand", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    near = lambda df, at, flag: df.select("gene_id", "start", "end", F.lit(flag).alias("is_intron"), at.alias("at"))
    leaving = near(junctions, F.col("start"), False).unionByName(near(introns, F.col("start") - 1, True)).withColumn("right", F.lit(True))
    entering = near(junctions, F.col("end"), False).unionByName(near(introns, F.col("end") + 1, True)).withColumn("right", F.lit(False))
    edge = F.when(F.col("right"), F.col("e_end")).otherwise(F.col("e_start"))
    held = F.when(F.col("is_intron"), F.col("at") == edge).otherwise((F.col("at") >= F.col("e_start")) & (F.col("at") <= F.col("e_end")))
    met = leaving.unionByName(entering).distinct().join(own, "gene_id").filter(held)
    kind = F.when(F.col("right") == (F.col("strand") == "+"), "s").otherwise("t")
    name = F.concat_ws(":", "gene_id", kind, F.concat_ws("-", F.col("e_start").cast("string"), F.col("e_end").cast("string")))
    w = W.partitionBy("gene_id", "e_start", "e_end", "right")
    along = F.when(F.col("strand") == "-", -1).otherwise(1)
    ranked = met.withColumns({"n": F.count(F.lit(1)).over(w), "junc_idx": F.row_number().over(w.orderBy("is_intron", F.col("start") * along, F.col("end") * along)) - 1})
    return ranked.filter("n > 1").select("gene_id", name.alias("lsv_id"), kind.alias("kind"), "junc_idx", "start", "end", "is_intron")


def without_redundant(lsvs: DataFrame, strict: bool = True) -> DataFrame:
    """LSVs less those whose connections another LSV of the gene holds.

    lsvs: gene_id, lsv_id, kind (s, t), connections array<string> (sorted). Strict: a target held by a source goes, and a
    source strictly held by a target; otherwise only targets equal to a source go.
    """
    other = lsvs.select("gene_id", F.col("lsv_id").alias("o_id"), F.col("kind").alias("o_kind"), F.col("connections").alias("o_connections"))
    pairs = lsvs.join(other, "gene_id").filter("kind <> o_kind and arrays_overlap(connections, o_connections)")
    held = F.size(F.array_except("connections", "o_connections")) == 0
    holds = F.size(F.array_except("o_connections", "connections")) == 0
    same = held & holds
    gone = ((F.col("kind") == "t") & held) | ((F.col("kind") == "s") & held & ~holds) if strict else (F.col("kind") == "t") & same
    return lsvs.join(pairs.filter(gone).select("lsv_id").distinct(), "lsv_id", "left_anti")


def simplified(reads: DataFrame, groups: DataFrame, share: float = 0.01, min_annotated: int = 0, min_denovo: int = 0, min_intron: int = 0, min_experiments: float = 1.0) -> DataFrame:
    """gene_id, start, end, simplify: connections without enough evidence in any group on either side.

    reads: experiment, gene_id, src, dst, start, end, is_intron, annotated, reads, of the connections that pass; groups: grp,
    experiment. In an experiment a side (the exon that a connection leaves, or enters) speaks for a connection that has
    `share` (over 0) of the side's reads and its kind's minimum; a connection stays if, in some group, `min_experiments` of
    the group's experiments (a share below 1, else a number) do so at one and the same side. An experiment that shows
    nothing of a connection doesn't speak for it, but counts in its group.
    """
    sizes = groups.distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("size")).withColumn("need", min_experiments_of(min_experiments, F.col("size")))
    least = F.when(F.col("is_intron"), min_intron).when(F.col("annotated"), min_annotated).otherwise(min_denovo)
    found = None
    for side in ("src", "dst"):
        total = F.sum("reads").over(W.partitionBy("experiment", "gene_id", side))
        part = reads.withColumn("ok", (F.col("reads") > 0) & (F.col("reads") >= share * total) & (F.col("reads") >= least)).select("experiment", "gene_id", "start", "end", F.lit(side).alias("side"), F.col("ok").cast("long").alias("ok"))
        found = part if found is None else found.unionByName(part)
    counted = found.join(F.broadcast(groups.distinct()), "experiment").groupBy("gene_id", "start", "end", "side", "grp").agg(F.sum("ok").alias("n")).join(F.broadcast(sizes), "grp")
    return counted.groupBy("gene_id", "start", "end").agg((~F.bool_or(F.col("n") >= F.col("need"))).alias("simplify"))


def exon_numbers(exons: DataFrame) -> DataFrame:
    """Rank of each exon in its gene, from the 5' end; exons: gene_id, strand, start, end."""
    along = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    return exons.withColumn("exon_number", F.row_number().over(W.partitionBy("gene_id").orderBy(along)))


def neighbour_genes(genes: DataFrame) -> DataFrame:
    """gene_id with the next and previous one of its chromosome in id order, wrapping round."""
    w = W.partitionBy("chrom").orderBy("gene_id")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return genes.select("chrom", "gene_id", F.coalesce(F.lead("gene_id").over(w), F.first("gene_id").over(every)).alias("next_gene"), F.coalesce(F.lag("gene_id").over(w), F.last("gene_id").over(every)).alias("previous_gene"))


REACH = 400  # fixed value: how far a site widens an exon, and how long a de-novo exon may be
TIP = 10  # fixed value: what stands for the other side of a half exon
SPANS = "array<struct<start:int,end:int,open:boolean,close:boolean>>"
EXONS = "array<struct<ks:int,ke:int,start:int,end:int,annotated_start:int,annotated_end:int>>"


def site_spans(sites: Column) -> Column:
    """Spans of an exon's sides from a gene's splice sites, array<struct<at, donor>> in order, acceptors first at a place.

    A donor closes the last acceptor that is open; with none open, the acceptor that opened the last island, or none. An
    acceptor behind a donor ends the island: all acceptors still open, the last first, are closed by the last donor. At the
    end those left are closed by the last donor, or by nothing. open, close: whether the span has that side.
    """
    span = lambda start, end, open_, close: F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), open_.alias("open"), close.alias("close")))
    none, yes = F.lit(None).cast("int"), F.lit(True)
    start = F.struct(F.array().cast("array<int>").alias("open"), none.alias("donor"), none.alias("first"), F.array().cast(SPANS).alias("found"))

    def closed(a: Column) -> Column:
        """Spans of all that is open with the last donor."""
        return F.transform(F.reverse(a["open"]), lambda x: F.struct(x.alias("start"), a["donor"].alias("end"), yes.alias("open"), yes.alias("close")))

    def step(a: Column, x: Column) -> Column:
        n, at = F.size(a["open"]), x["at"]
        top = F.get(a["open"], n - 1)
        left = F.when(n > 0, top).otherwise(a["first"])
        by_donor = F.struct(
            F.when(n > 0, F.slice(a["open"], 1, n - 1)).otherwise(a["open"]).alias("open"),
            at.alias("donor"),
            a["first"].alias("first"),
            F.concat(a["found"], span(F.coalesce(left, at - TIP), at, left.isNotNull(), yes)).alias("found"),
        )
        fresh = (n == 0) | a["donor"].isNotNull()
        ends = (n > 0) & a["donor"].isNotNull()
        by_acceptor = F.struct(
            F.when(ends, F.array(at)).otherwise(F.concat(a["open"], F.array(at))).alias("open"),
            F.when(fresh, none).otherwise(a["donor"]).alias("donor"),
            F.when(fresh, at).otherwise(a["first"]).alias("first"),
            F.when(ends, F.concat(a["found"], closed(a))).otherwise(a["found"]).alias("found"),
        )
        return F.when(x["donor"] == 1, by_donor).otherwise(by_acceptor)

    def finish(a: Column) -> Column:
        left = F.transform(F.reverse(a["open"]), lambda x: F.struct(x.alias("start"), F.coalesce(a["donor"], x + TIP).alias("end"), yes.alias("open"), a["donor"].isNotNull().alias("close")))
        return F.concat(a["found"], left)

    return F.aggregate(sites, start, step, finish)


def exons_with_spans(exons: Column, spans: Column, reach: int = REACH) -> Column:
    """A gene's exons after its spans, in order, have widened them or been added.

    A span meets the first full exon, by its first coordinates, that it overlaps, and widens it on either side by `reach` at
    most; a side further out is a half exon of its own. A span that meets none is an exon if it is at most `reach` long,
    without the side that it lacks, and two half exons otherwise. A half exon, -1 on one side, is the same as one that has
    its place.
    """
    none = F.lit(-1)

    def exon(start: Column, end: Column) -> Column:
        tip = F.lit(TIP)
        return F.struct(F.when(start == none, end - tip).otherwise(start).alias("ks"), F.when(end == none, start + tip).otherwise(end).alias("ke"), start.alias("start"), end.alias("end"), none.alias("annotated_start"), none.alias("annotated_end"))

    def same(x: Column, y: Column) -> Column:
        return (x["ks"] == y["ks"]) & (x["ke"] == y["ke"])

    def added(a: Column, new: Column) -> Column:
        return F.aggregate(new, a, lambda have, y: F.when(F.exists(have, lambda x: same(x, y)), have).otherwise(F.concat(have, F.array(y))))

    def step(a: Column, s: Column) -> Column:
        start, end = s["start"], s["end"]
        met = F.array_min(F.filter(a, lambda x: (x["start"] != none) & (x["end"] != none) & (start <= x["end"]) & (end >= x["start"])))
        alone = F.when(end - start <= reach, F.array(exon(F.when(s["open"], start).otherwise(none), F.when(s["close"], end).otherwise(none)))).otherwise(F.array(exon(start, none), exon(none, end)))

        def widened(x: Column) -> Column:
            low = F.when((start < x["start"]) & (start >= x["start"] - reach), start).otherwise(x["start"])
            high = F.when((end > x["end"]) & (end <= x["end"] + reach), end).otherwise(x["end"])
            return F.struct(x["ks"].alias("ks"), x["ke"].alias("ke"), low.alias("start"), high.alias("end"), x["annotated_start"].alias("annotated_start"), x["annotated_end"].alias("annotated_end"))

        wide = F.transform(a, lambda x: F.when(same(x, met), widened(x)).otherwise(x))
        far = F.filter(F.array(F.when(start < met["start"] - reach, exon(start, none)), F.when(end > met["end"] + reach, exon(none, end))), lambda x: x.isNotNull())
        return F.when(end < start, a).when(met.isNull(), added(a, alone)).otherwise(added(wide, far))

    return F.aggregate(spans, exons.cast(EXONS), step)


def detected_exons(exons: DataFrame, junctions: DataFrame, reach: int = REACH) -> DataFrame:
    """gene_id, start, end, annotated_start, annotated_end, annotated: annotated exons widened by, and de-novo ones made
    from, the splice sites of a gene's junctions, in one sweep along the gene.

    exons: of the annotation (gene_id, start, end); junctions: those that count (gene_id, start, end), a start is a donor
    and an end an acceptor; sites at 0 or below, the ends of transcripts, don't count. The sites of a gene, which the
    annotation and its depth bound, are one array, so a gene is one row.
    """
    acceptors = junctions.select("gene_id", F.col("end").alias("at"), F.lit(0).alias("donor"))
    sites = acceptors.unionByName(junctions.select("gene_id", F.col("start").alias("at"), F.lit(1).alias("donor"))).filter("at > 0")
    site = F.struct(F.col("at").cast("int").alias("at"), "donor")
    by_gene = sites.groupBy("gene_id").agg(F.sort_array(F.collect_list(site)).alias("sites"))
    own = F.struct(*(F.col(c).cast("int").alias(n) for c, n in (("start", "ks"), ("end", "ke"), ("start", "start"), ("end", "end"), ("start", "annotated_start"), ("end", "annotated_end"))))
    known = exons.groupBy("gene_id").agg(F.array_sort(F.collect_set(own)).alias("exons"))
    both = known.join(by_gene, "gene_id", "full").select("gene_id", F.coalesce("exons", F.array().cast(EXONS)).alias("exons"), F.coalesce("sites", F.array().cast("array<struct<at:int,donor:int>>")).alias("sites"))
    found = both.select("gene_id", "exons", site_spans(F.col("sites")).alias("spans")).select("gene_id", F.explode(exons_with_spans(F.col("exons"), F.col("spans"), reach)).alias("x"))
    return found.select("gene_id", "x.start", "x.end", "x.annotated_start", "x.annotated_end", (F.col("x.annotated_start") != -1).alias("annotated"))


def without_simplified(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges that aren't simplified. marks: gene_id, start, end, simplify."""
    gone = marks.filter("simplify").select("gene_id", "start", "end").distinct()
    return edges.join(gone, ["gene_id", "start", "end"], "left_anti")


def gene_distance(junctions: DataFrame) -> DataFrame:
    """Adds distance: how far a junction's ends lie outside the gene at most; 0 inside. junctions: also g_start, g_end."""
    return junctions.withColumn("distance", F.greatest(F.lit(0), F.col("g_start") - F.col("start"), F.col("end") - F.col("g_end")))
