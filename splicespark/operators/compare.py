"""Comparisons across result tables: significant LSVs, classes, sets, overlaps, matrices.

quant: comparison, gene_id, lsv_id, lsv_type, junc_idx, start, end, dpsi, prob, psi1, psi2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .evidence import overlaps
from .tables import kept

LSV = ["comparison", "lsv_id"]


def exploded(rows: DataFrame, lists: list[str], numbers: list[str]) -> DataFrame:
    """Rows whose columns `lists` hold one value for each connection, joined by semicolons, as a row for each connection;
    those in `numbers` as doubles."""
    split = F.arrays_zip(*(F.split(c, ";").alias(c) for c in lists))
    each = rows.select(*(c for c in rows.columns if c not in lists), F.posexplode(split).alias("junc_idx", "v"))
    value = lambda c: F.col(f"v.{c}").try_cast("double") if c in numbers else F.col(f"v.{c}")
    return each.select(*(c for c in each.columns if c != "v"), *(value(c).alias(c) for c in lists))


def significant(quant: DataFrame, dpsi: float = 0.2, prob: float = 0.95, summed: bool = False) -> DataFrame:
    """comparison, lsv_id with a connection of enough change and probability; or, summed, where the probable changes of one
    sign add up to enough."""
    sure = F.col("prob") >= prob
    if not summed:
        return quant.filter(sure & (F.abs("dpsi") >= dpsi)).select(*LSV).distinct()
    up, down = (F.sum(F.when(sure & (s * F.col("dpsi") > 0), s * F.col("dpsi"))) for s in (1, -1))
    return quant.groupBy(*LSV).agg(F.greatest(F.coalesce(up, F.lit(0.0)), F.coalesce(down, F.lit(0.0))).alias("s")).filter(F.col("s") >= dpsi).select(*LSV)


def without_introns(quant: DataFrame, most: float = 0.05) -> DataFrame:
    """Less the LSVs whose type ends in an intron that changes by `most` or more (it is the last connection)."""
    last = quant.groupBy(*LSV).agg(F.max_by(F.struct("lsv_type", "dpsi"), "junc_idx").alias("x"))
    intronic = last.filter(F.endswith(F.col("x.lsv_type"), F.lit("i")) & (F.abs("x.dpsi") >= most)).select(*LSV)
    return quant.join(intronic, LSV, "left_anti")


def imputed(quant: DataFrame, comparisons: DataFrame, value: float = 0.0) -> DataFrame:
    """Every connection in every comparison; those missing get `value` for dpsi and prob, and imputed is true.

    comparisons: a table of their names, which is broadcast if small."""
    every = quant.select("lsv_id", "junc_idx").distinct().crossJoin(comparisons.select("comparison"))
    found = every.join(quant.select(*LSV, "junc_idx", "dpsi", "prob"), [*LSV, "junc_idx"], "left")
    return found.withColumn("imputed", F.col("dpsi").isNull()).na.fill(value, ["dpsi", "prob"])


def max_weights(quant: DataFrame) -> DataFrame:
    """gene_id, start, end, weight: the largest change of a junction over LSVs and comparisons."""
    return quant.groupBy("gene_id", "start", "end").agg(F.max(F.abs("dpsi")).alias("weight"))


def control_psi(quant: DataFrame) -> DataFrame:
    """gene_id, start, end, max_psi over all comparisons' first conditions."""
    return quant.groupBy("gene_id", "start", "end").agg(F.max("psi1").alias("max_psi"))


def cryptic(quant: DataFrame, control: DataFrame, annotated: DataFrame, dpsi: float = 0.2, prob: float = 0.95, psi: float = 0.05) -> DataFrame:
    """Connections that change surely from nearly no use, that the controls hardly use (or don't know) and that aren't
    annotated."""
    kept = quant.filter((F.abs("dpsi") >= dpsi) & (F.col("prob") >= prob) & (F.col("psi1") <= psi))
    kept = kept.join(control, ["gene_id", "start", "end"], "left").filter(F.coalesce("max_psi", F.lit(0.0)) <= psi)
    return kept.join(annotated, ["gene_id", "start", "end"], "left_anti").select(*LSV, "gene_id", "start", "end", "dpsi")


def functional_classes(quant: DataFrame, dpsi: float = 0.2) -> DataFrame:
    """lsv_id, n, lsv_class, reciprocates: by the number of connections that change enough in any comparison (0 none, 1
    single, 2 binary, else complex); a binary one reciprocates when its two largest changes have opposite signs.

    The sign is that of each connection's largest change in any comparison."""
    each = quant.groupBy("lsv_id", "junc_idx").agg(F.max_by("dpsi", F.struct(F.abs("dpsi").alias("a"), F.col("dpsi").alias("b"))).alias("d"))
    w = W.partitionBy("lsv_id").orderBy(F.desc(F.abs("d")), "junc_idx")
    ranked = each.withColumn("r", F.row_number().over(w))
    found = ranked.groupBy("lsv_id").agg(F.count(F.when(F.abs("d") >= dpsi, 1)).alias("n"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"))
    named = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("n") == 2, "binary").otherwise("complex")
    return found.select("lsv_id", "n", named.alias("lsv_class"), F.coalesce((F.col("n") == 2) & (F.col("d1") * F.col("d2") < 0), F.lit(False)).alias("reciprocates"))


def top_share(quant: DataFrame, share: float = 0.95) -> DataFrame:
    """lsv_id, n: the fewest connections, largest change first, that make up `share` of the summed changes."""
    each = quant.groupBy("lsv_id", "junc_idx").agg(F.max(F.abs("dpsi")).alias("d"))
    w = W.partitionBy("lsv_id").orderBy(F.desc("d"), "junc_idx")
    upto = F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("d").over(W.partitionBy("lsv_id"))
    # What is before a connection decides whether it is needed; rounding keeps exact shares from slipping.
    ranked = each.select("lsv_id", F.row_number().over(w).alias("r"), F.round(upto, 9).alias("s"))
    return ranked.filter(F.col("s") >= share).groupBy("lsv_id").agg(F.min("r").alias("n"))


def greatest_change(quant: DataFrame, prob: float = 0.95) -> DataFrame:
    """The LSVs of each comparison that attain its highest cutoff (in steps of 0.01) with enough probability."""
    cut = quant.filter(F.col("prob") >= prob).withColumn("cutoff", F.floor(F.abs("dpsi") * 100) / 100)
    best = cut.groupBy("comparison").agg(F.max("cutoff").alias("cutoff"))
    return cut.join(best, ["comparison", "cutoff"]).select("comparison", "lsv_id", "cutoff").distinct()


def shared_lsvs(quant: DataFrame) -> DataFrame:
    """LSVs that every comparison has."""
    n = quant.agg(F.count_distinct("comparison").alias("n"))
    return quant.groupBy("lsv_id").agg(F.count_distinct("comparison").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("lsv_id")


def lsv_counts(quant: DataFrame) -> DataFrame:
    """comparison, lsvs; the row `shared` counts those in all, `any` those in any comparison."""
    own = quant.groupBy("comparison").agg(F.count_distinct("lsv_id").alias("lsvs"))
    shared = shared_lsvs(quant).agg(F.count(F.lit(1)).alias("lsvs")).select(F.lit("shared").alias("comparison"), "lsvs")
    every = quant.agg(F.count_distinct("lsv_id").alias("lsvs")).select(F.lit("any").alias("comparison"), "lsvs")
    return own.unionByName(shared).unionByName(every)


def venn(members: DataFrame, names: list[str], what: str = "lsv_id") -> DataFrame:
    """mask, n: how many members are in just the comparisons of each bit mask (bit i is names[i])."""
    bit = F.sum(F.when(F.col("comparison").isin(names), F.pow(F.lit(2), F.array_position(F.array(*map(F.lit, names)), F.col("comparison")) - 1)).otherwise(0)).cast("int")
    return members.select("comparison", what).distinct().groupBy(what).agg(bit.alias("mask")).filter("mask > 0").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def pairwise_counts(changing: DataFrame) -> DataFrame:
    """sample_1, sample_2, n: changing LSVs of each comparison `a_b`, both ways round."""
    n = changing.select(F.split("comparison", "_").alias("p"), "lsv_id").select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    turned = n.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return n.unionByName(turned).groupBy(F.col("a").alias("sample_1"), F.col("b").alias("sample_2")).agg(F.sum("n").alias("n"))


def matrix(quant: DataFrame, comparisons: list[str], value: str = "dpsi") -> DataFrame:
    """A row for each connection, a column for each comparison."""
    return quant.groupBy("lsv_id", "junc_idx").pivot("comparison", comparisons).agg(F.first(value))


def correlation(quant: DataFrame, first: str, second: str) -> DataFrame:
    """n, r, slope, intercept between two comparisons, of each shared LSV's connection that changes most in the first."""
    top = quant.filter(F.col("comparison") == first).groupBy("lsv_id").agg(F.max_by(F.struct("junc_idx", "dpsi"), F.struct(F.abs("dpsi").alias("a"), (-F.col("junc_idx")).alias("b"))).alias("t")).select("lsv_id", "t.junc_idx", F.col("t.dpsi").alias("x"))
    other = quant.filter(F.col("comparison") == second).select("lsv_id", "junc_idx", F.col("dpsi").alias("y"))
    both = top.join(other, ["lsv_id", "junc_idx"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def non_redundant_sets(quant: DataFrame, dpsi: float = 0.1) -> DataFrame:
    """lsv_id, set_id: LSVs joined, directly or by way of others, by a junction that each uses (changes by `dpsi` in some
    comparison); set_id is the smallest lsv_id of the set. LSVs that use none are sets of their own.

    Labels go from LSVs to junctions and back until none changes; a junction's label is a minimum by key, so a junction of
    many LSVs costs no pairs. Every round is a written table, so that lost executors cost one round at most.
    """
    used = quant.filter(F.abs("dpsi") >= dpsi).select("lsv_id", F.concat_ws(":", "gene_id", "start", "end").alias("j")).distinct()
    used = kept(used)
    labels = kept(quant.select("lsv_id").distinct().withColumn("set_id", F.col("lsv_id")))
    while True:
        by_junction = used.join(labels, "lsv_id").groupBy("j").agg(F.min("set_id").alias("m"))
        near = used.join(by_junction, "j").groupBy("lsv_id").agg(F.min("m").alias("m"))
        # The label's own label: halves the way that is left.
        step = labels.join(near, "lsv_id", "left").select("lsv_id", F.col("set_id").alias("old"), F.least("set_id", "m").alias("set_id"))
        up = step.select(F.col("lsv_id").alias("set_id"), F.col("set_id").alias("up"))
        new = kept(step.join(up, "set_id", "left").select("lsv_id", "old", F.least("set_id", "up").alias("set_id")))
        labels = new.select("lsv_id", "set_id")
        if new.filter("old <> set_id").isEmpty():
            return labels


def set_classes(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """set_id, lsvs, gene_id (the commonest; of equal ones the first), gene_lsvs, set_class. genes: lsv_id, gene_id."""
    n = sets.join(genes, "lsv_id").groupBy("set_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("set_id")
    ranked = n.withColumns({"lsvs": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "gene_id"))}).filter("r = 1")
    return ranked.select("set_id", "lsvs", "gene_id", F.col("n").alias("gene_lsvs"), F.when(F.col("n") == 1, "single").when(F.col("n") == 2, "two").otherwise("three_plus").alias("set_class"))


def representatives(sets: DataFrame, quant: DataFrame) -> DataFrame:
    """set_id, lsv_id, max_dpsi: the LSV of each set that changes most (of equal ones the first id)."""
    most = quant.groupBy("lsv_id").agg(F.max(F.abs("dpsi")).alias("max_dpsi"))
    w = W.partitionBy("set_id").orderBy(F.desc("max_dpsi"), "lsv_id")
    return sets.join(most, "lsv_id").withColumn("r", F.row_number().over(w)).filter("r = 1").select("set_id", "lsv_id", "max_dpsi")


def set_matrix(sets: DataFrame, changing: DataFrame, comparisons: list[str]) -> DataFrame:
    """set_id and, for each comparison, 1 where a significant LSV of the set is in it."""
    return sets.join(changing, "lsv_id").groupBy("set_id").pivot("comparison", comparisons).agg(F.max(F.lit(1))).na.fill(0, comparisons)


def uniquely_changing(quant: DataFrame, dpsi: float = 0.2, prob: float = 0.95, still: float = 0.05) -> DataFrame:
    """lsv_id, comparison: LSVs significant in that comparison alone, whose changing connections are still in all others
    that have them (there must be one)."""
    sure = (F.abs("dpsi") >= dpsi) & (F.col("prob") >= prob)
    hits = quant.filter(sure).select("comparison", "lsv_id", "junc_idx")
    once = hits.groupBy("lsv_id").agg(F.count_distinct("comparison").alias("n"), F.first("comparison").alias("own")).filter("n = 1").select("lsv_id", "own")
    others = quant.join(once, "lsv_id").join(hits.select("lsv_id", "junc_idx").distinct(), ["lsv_id", "junc_idx"]).filter("comparison <> own")
    quiet = others.groupBy("lsv_id", "own").agg(F.bool_and(F.abs("dpsi") <= still).alias("ok")).filter("ok")
    return quiet.select("lsv_id", F.col("own").alias("comparison"))


def singly_unique(quant: DataFrame, dead: float = 0.05, prob: float = 0.95) -> DataFrame:
    """lsv_id, comparison: changes as -1, 0, 1 (0 inside +-dead or if unsure); a connection votes for the comparison that
    alone has some value; LSVs whose votes all name one comparison."""
    sign = F.when((F.abs("dpsi") <= dead) | (F.col("prob") < prob), 0).otherwise(F.signum("dpsi").cast("int"))
    marked = quant.select("comparison", "lsv_id", "junc_idx", sign.alias("v"))
    n = F.count(F.lit(1)).over(W.partitionBy("lsv_id", "junc_idx", "v"))
    others = F.count(F.lit(1)).over(W.partitionBy("lsv_id", "junc_idx"))
    votes = marked.withColumns({"n": n, "all": others}).filter("n = 1 and all > 2").groupBy("lsv_id", "junc_idx").agg(F.count(F.lit(1)).alias("k"), F.first("comparison").alias("comparison")).filter("k = 1")
    return votes.groupBy("lsv_id").agg(F.count_distinct("comparison").alias("n"), F.min("comparison").alias("comparison")).filter("n = 1").select("lsv_id", "comparison")


def cassette_groups(binary: DataFrame) -> DataFrame:
    """gene_id, excl_start, excl_end, lsvs, kind: binary LSVs by their exclusion junction, the one to the exon that lies
    farthest from the reference exon (ties: the longer, then the first); 1 is single, 2 a cassette or matched (by whether
    their other connections join the same exon), more complex.

    binary: gene_id, lsv_id, ref_start, ref_end (the reference exon), start, end, alt_start, alt_end: the exon that the
    connection joins to it."""
    far = F.greatest(F.col("alt_start") - F.col("ref_end"), F.col("ref_start") - F.col("alt_end"), F.lit(0))
    order = F.struct(far, F.col("end") - F.col("start"), -F.col("start"))
    each = binary.groupBy("gene_id", "lsv_id").agg(F.max_by(F.struct("start", "end"), order).alias("x"), F.min_by(F.struct("alt_start", "alt_end"), order).alias("alt"))
    grouped = each.groupBy("gene_id", F.col("x.start").alias("excl_start"), F.col("x.end").alias("excl_end")).agg(F.count(F.lit(1)).alias("lsvs"), F.count_distinct("alt").alias("alts"))
    kind = F.when(F.col("lsvs") == 1, "single").when(F.col("lsvs") > 2, "complex").when(F.col("alts") == 1, "cassette").otherwise("matched")
    return grouped.select("gene_id", "excl_start", "excl_end", "lsvs", kind.alias("kind"))


def uses_intron(quant: DataFrame, psi: float = 0.05) -> DataFrame:
    """lsv_id whose intron's PSI is over the cutoff in some condition."""
    introns = quant.filter(F.endswith("lsv_type", F.lit("i"))).withColumn("last", F.max("junc_idx").over(W.partitionBy(*LSV))).filter("junc_idx = last")
    return introns.filter(F.greatest("psi1", "psi2") > psi).select("lsv_id").distinct()


def touched_exons(connections: DataFrame, exons: DataFrame) -> DataFrame:
    """gene_id, lsv_id, junc_idx, side (start, end), e_start, e_end: the exons that the ends of LSVs' connections lie in.

    connections: gene_id, lsv_id, junc_idx, start, end; exons: gene_id, start, end, full (-1: half exons hold nothing).
    Ends meet exons by gene and coordinate bin.
    """
    ends = connections.select("gene_id", "lsv_id", "junc_idx", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end").alias("at")))).alias("x"))
    points = ends.select("gene_id", "lsv_id", "junc_idx", "x.side", F.col("x.at").alias("start"), F.col("x.at").alias("end")).distinct()
    full = exons.filter("start <> -1 and end <> -1 and end >= start").select("gene_id", "start", "end").distinct()
    return overlaps(points, full, ["gene_id"]).select("gene_id", "lsv_id", "junc_idx", "side", F.col("r_start").alias("e_start"), F.col("r_end").alias("e_end"))


def touched_merged(connections: DataFrame, reach: int = 20) -> DataFrame:
    """gene_id, lsv_id, junc_idx, start, end, s_start, s_end, e_start, e_end: the exons that a connection's start and end lie
    in, when a gene's exons are `reach` bases before the starts and behind the ends of its connections, merged. It is what
    touched_exons has of these exons; an end lies in the one that its own bases became part of, so that nothing is joined,
    and all is worked out where a gene's connections are.

    connections: gene_id, lsv_id, junc_idx, start, end, each once."""
    key = ["gene_id", "lsv_id", "junc_idx", "start", "end"]
    side = lambda at, s, e: F.struct(F.lit(at).alias("side"), s.cast("int").alias("x"), e.cast("int").alias("y"))
    sides = F.array(side("s", F.col("start") - reach, F.col("start")), side("e", F.col("end"), F.col("end") + reach))
    each = connections.select(*key, F.explode(sides).alias("p")).select(*key, "p.*").filter("x is not null")
    along = W.partitionBy("gene_id").orderBy("x", "y")
    before = F.max("y").over(along.rowsBetween(W.unboundedPreceding, -1))
    cut = each.withColumn("_new", F.coalesce((F.col("x") > before).cast("int"), F.lit(1)))
    island = cut.withColumn("_island", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("gene_id", "_island")
    held = island.withColumns({"_from": F.min("x").over(whole), "_to": F.max("y").over(whole)})
    of = lambda at, name: [F.max(F.when(F.col("side") == at, F.col(c))).alias(f"{name}_{n}") for c, n in (("_from", "start"), ("_to", "end"))]
    return held.groupBy(*key).agg(*of("s", "s"), *of("e", "e"))


def touched_rows(touched: DataFrame) -> DataFrame:
    """What touched_exons has, from touched_merged."""
    side = lambda name, n: F.struct(F.lit(name).alias("side"), F.col(f"{n}_start").alias("e_start"), F.col(f"{n}_end").alias("e_end"))
    each = touched.select("gene_id", "lsv_id", "junc_idx", F.explode(F.array(side("start", "s"), side("end", "e"))).alias("x"))
    return each.select("gene_id", "lsv_id", "junc_idx", "x.*").filter("e_start is not null")


def lsvs_of_first(touched: DataFrame) -> DataFrame:
    """query, gene_id, lsv_id: what lsvs_of_all has when a gene's query are the exons of connection 1 of one of its LSVs, the
    number `query` of touched's rows; worked out where a gene's connections are."""
    exon = F.struct("e_start", "e_end")
    asked = F.collect_set(F.when((F.col("junc_idx") == 1) & (F.col("lsv_id") == F.col("query")), exon)).over(W.partitionBy("gene_id"))
    own = touched.withColumn("_asked", asked).groupBy("gene_id", "lsv_id").agg(F.collect_set(exon).alias("_own"), F.first("_asked").alias("_asked"), F.first("query").alias("query"))
    return own.filter((F.size("_asked") > 0) & (F.size(F.array_except("_asked", "_own")) == 0)).select("query", "gene_id", "lsv_id")


def exon_index(touched: DataFrame) -> DataFrame:
    """gene_id, e_start, e_end, lsvs, lsv_ids: the LSVs that a connection joins to each exon. touched: of touched_exons."""
    return touched.groupBy("gene_id", "e_start", "e_end").agg(F.count_distinct("lsv_id").alias("lsvs"), F.array_join(F.sort_array(F.collect_set("lsv_id")), ";").alias("lsv_ids"))


def lsvs_at(touched: DataFrame, places: DataFrame) -> DataFrame:
    """gene_id, place, e_start, e_end, lsv_id: the LSVs of the exons that hold a coordinate. places: gene_id, place."""
    own = touched.select("gene_id", "lsv_id", "e_start", "e_end").distinct()
    return own.join(places.select("gene_id", "place").distinct(), "gene_id").filter("place between e_start and e_end").select("gene_id", "place", "e_start", "e_end", "lsv_id")


def lsvs_of_all(touched: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, gene_id, lsv_id: LSVs that touch every exon of a query. wanted: query, gene_id, e_start, e_end."""
    keys = ["gene_id", "e_start", "e_end"]
    asked = wanted.select("query", *keys).distinct().withColumn("n", F.count(F.lit(1)).over(W.partitionBy("query", "gene_id")))
    met = touched.select("lsv_id", *keys).distinct().join(asked, keys)
    return met.groupBy("query", "gene_id", "lsv_id", "n").agg(F.count(F.lit(1)).alias("k")).filter("k = n").select("query", "gene_id", "lsv_id")


def summed_change(quant: DataFrame, threshold: float = 0.2) -> DataFrame:
    """comparison, lsv_id where the positive changes add up to the threshold."""
    return quant.groupBy(*LSV).agg(F.sum(F.when(F.col("dpsi") > 0, F.col("dpsi")).otherwise(0.0)).alias("s")).filter(F.round("s", 9) >= threshold).select(*LSV)


def expressed_genes(results: DataFrame, fold: float = 1.2, padj: float = 0.05) -> DataFrame:
    """Differentially expressed genes of each comparison, by adjusted p. results: comparison, gene_id, log2fold, padj."""
    return results.filter((F.abs("log2fold") >= fold) & (F.col("padj") <= padj)).withColumn("rank", F.row_number().over(W.partitionBy("comparison").orderBy("padj", "gene_id")))


def looked_up(quant: DataFrame, name: str | Column) -> DataFrame:
    """Rows of a gene or LSV by id, whatever the case."""
    wanted = F.lower(F.lit(name) if isinstance(name, str) else name)
    return quant.filter((F.lower("gene_id") == wanted) | (F.lower("lsv_id") == wanted))


def nonchanging_connections(quant: DataFrame, most: float = 0.05) -> DataFrame:
    """lsv_id, junc_idx, comparisons: connections within `most` in every comparison, of LSVs that all comparisons have."""
    every = quant.agg(F.count_distinct("comparison").alias("every"))
    one = quant.groupBy("lsv_id", "junc_idx").agg(F.max(F.abs("dpsi")).alias("m"), F.count_distinct("comparison").alias("comparisons"))
    return one.crossJoin(F.broadcast(every)).filter((F.col("m") <= most) & (F.col("comparisons") == F.col("every"))).select("lsv_id", "junc_idx", "comparisons")


def without_genes(quant: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of all genes but the given ones (gene_id)."""
    return quant.join(genes.select("gene_id").distinct(), "gene_id", "left_anti")


def of_types(quant: DataFrame, intron: bool | None = None, connections: int | None = None) -> DataFrame:
    """Rows of LSVs with or without an intron, and of so many connections in their type."""
    t = F.col("lsv_type")
    if intron is not None:
        quant = quant.filter(F.endswith(t, F.lit("|i")) == intron)
    return quant if connections is None else quant.filter(F.size(F.split(t, r"\|")) - 1 == connections)


def dpsi_rows(quant: DataFrame) -> DataFrame:
    """A row for each LSV of a comparison: its connections' values as texts with semicolons, in order; NA where a value is
    missing, and probabilities as d.ddde-dd."""
    c = F.sort_array(F.collect_list(F.struct("junc_idx", "dpsi", "prob", "psi1", "psi2", "start", "end")))
    rows = quant.groupBy("comparison", "gene_id", "lsv_id", "lsv_type").agg(c.alias("c"))
    text = lambda name, form: F.array_join(F.transform("c", lambda x: F.when(x[name].isNull(), "NA").otherwise(F.format_string(form, x[name]))), ";")
    at = F.array_join(F.transform("c", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")
    return rows.select(*LSV, "gene_id", "lsv_type", F.size("c").alias("num_junctions"), text("dpsi", "%.4f").alias("mean_dpsi"), text("prob", "%.3e").alias("probability_changing"), text("psi1", "%.4f").alias("mean_psi_1"), text("psi2", "%.4f").alias("mean_psi_2"), at.alias("junctions_coords"))


CASSETTES = ("s|1e1.1o1|1e2.1o1", "t|1e1.1o1|1e2.1o1")  # fixed values: the types of single cassette exons


def of_events(quant: DataFrame, threshold: float = 0.2, cassettes: bool = False, introns: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """Rows of the LSVs of a comparison whose largest change is `threshold` or more; cassettes: of the exact types of single
    cassette exons only; introns: also of LSVs with an intron; ids: only of these (lsv_id)."""
    rows = quant if introns else quant.filter(~F.endswith("lsv_type", F.lit("i")))
    rows = rows.filter(F.col("lsv_type").isin(*CASSETTES)) if cassettes else rows
    rows = rows if ids is None else rows.join(ids.select("lsv_id").distinct(), "lsv_id", "left_semi")
    large = rows.groupBy(*LSV).agg(F.max(F.abs("dpsi")).alias("m")).filter(F.col("m") >= threshold).select(*LSV)
    return rows.join(large, LSV, "left_semi")


def with_junction(quant: DataFrame, junctions: DataFrame) -> DataFrame:
    """comparison, lsv_id, junc_idx, start, end of the connections at given coordinates (gene_id, start, end)."""
    return quant.join(junctions.select("gene_id", "start", "end").distinct(), ["gene_id", "start", "end"], "left_semi").select(*LSV, "junc_idx", "start", "end")


def intron_coordinates(quant: DataFrame) -> DataFrame:
    """comparison, lsv_id, start, end of the intron of each LSV with one: its last connection."""
    last = F.max_by(F.struct("start", "end"), "junc_idx").alias("x")
    return quant.filter(F.endswith("lsv_type", F.lit("i"))).groupBy(*LSV).agg(last).select(*LSV, "x.start", "x.end")
