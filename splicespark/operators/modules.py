"""Splicing modules and their events, as joins of connections within a module.

edges: gene_id, strand, src, dst (exon order in the gene), start, end, is_intron; with_modules() adds module_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import kept

KEY = ["gene_id", "module_idx"]


def with_modules(edges: DataFrame) -> DataFrame:
    """module_idx for each edge: a new module begins where no earlier edge reaches past the exon; numbered from the 5' end."""
    before = F.max("dst").over(W.partitionBy("gene_id").orderBy("src").rangeBetween(W.unboundedPreceding, -1))
    cut = edges.withColumn("_cut", F.col("src") >= F.coalesce(before, F.lit(-1)))
    # One cut for each exon that begins a module: edges of one exon count once.
    first = F.row_number().over(W.partitionBy("gene_id", "src").orderBy("dst", "start", "end")) == 1
    module = F.sum((F.col("_cut") & F.col("_first")).cast("int")).over(W.partitionBy("gene_id").orderBy("src").rangeBetween(W.unboundedPreceding, 0)).cast("int")
    numbered = cut.withColumn("_first", first).withColumn("_m", module).drop("_cut", "_first")
    last = F.max("_m").over(W.partitionBy("gene_id"))
    return numbered.withColumn("module_idx", F.when(F.col("strand") == "-", last - F.col("_m") + 1).otherwise(F.col("_m"))).drop("_m")


def multi_gene_regions(edges: DataFrame) -> DataFrame:
    """gene_id, region, modules: runs of modules without a break, where an exon without a forward edge divides."""
    m = edges.groupBy(*KEY).agg(F.min("src").alias("first"), F.max("dst").alias("last"))
    w = W.partitionBy("gene_id").orderBy("first")
    run = m.withColumn("new", (F.col("first") > F.coalesce(F.lag("last").over(w), F.lit(-1))).cast("int")).withColumn("region", F.sum("new").over(w))
    return run.groupBy("gene_id", "region").agg(F.count(F.lit(1)).alias("modules"))


def valid_modules(edges: DataFrame, least_edges: int = 2, lsvs: DataFrame | None = None, changing: DataFrame | None = None) -> DataFrame:
    """Edges of modules of `least_edges` edges or more (1 keeps constitutive ones); with lsvs also of modules that hold one of
    these LSVs, with changing of modules that hold one of those that change. lsvs, changing: gene_id, exon, side (s: the exon
    is left in the module, t: it is entered)."""
    found = edges.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*KEY))).filter(F.col("_n") >= least_edges).drop("_n")
    sides = edges.select(*KEY, F.explode(F.array(F.struct(F.col("src").alias("exon"), F.lit("s").alias("side")), F.struct(F.col("dst").alias("exon"), F.lit("t").alias("side")))).alias("x")).select(*KEY, "x.*").distinct()
    for wanted in (lsvs, changing):
        if wanted is not None:
            found = found.join(sides.join(wanted, ["gene_id", "exon", "side"], "left_semi").select(*KEY).distinct(), KEY, "left_semi")
    return found


def side(edges: DataFrame, p: str, introns: bool | None = False) -> DataFrame:
    kept = edges if introns is None else edges.filter(F.col("is_intron") == introns)
    return kept.select(*KEY, *(F.col(c).alias(f"{p}_{c}") for c in ("src", "dst", "start", "end")))


def cassette(edges: DataFrame) -> DataFrame:
    """An exon between two that are also joined past it, by connections that share the outer coordinates."""
    a, b, s = side(edges, "a"), side(edges, "b"), side(edges, "s")
    found = s.join(a, KEY).filter("a_src = s_src and a_start = s_start and a_dst < s_dst").join(b, KEY).filter("b_src = a_dst and b_dst = s_dst and b_end = s_end")
    return found.select(*KEY, F.col("s_src").alias("c1"), F.col("a_dst").alias("a1"), F.col("s_dst").alias("c2"), "s_start", "s_end", F.col("a_end").alias("a1_start"), F.col("b_start").alias("a1_end")).distinct()


def tandem_cassette(edges: DataFrame, inner: bool = False) -> DataFrame:
    """A connection past two exons or more of which each is joined to the next, the outer ones at its coordinates; inner: also
    first_end and last_start, where the inner exons begin and end, and bases, the inner exons' lengths together.

    Of several connections between two exons the one with the least start and end stands for them; the first step is the one
    that ends first, the last the one that starts last."""
    s, n = side(edges, "s"), side(edges, "n")
    first, last = F.col("n_src") == F.col("s_src"), F.col("n_dst") == F.col("s_dst")
    fits = F.when(first, F.col("n_start") == F.col("s_start")).otherwise(True) & F.when(last, F.col("n_end") == F.col("s_end")).otherwise(True)
    ways = s.filter("s_dst - s_src > 2").join(n, KEY).filter("n_dst = n_src + 1 and n_src >= s_src and n_dst <= s_dst").filter(fits)
    span = ["s_src", "s_dst", "s_start", "s_end"]
    steps = ways.groupBy(*KEY, *span, "n_src", "n_dst").agg(F.min(F.struct("n_start", "n_end")).alias("x"), F.max("n_start").alias("late"))
    start, end = F.when(last, F.col("late")).otherwise(F.col("x.n_start")), F.col("x.n_end")
    counted = steps.groupBy(*KEY, *span).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(first, end)).alias("first_end"), F.max(F.when(last, start)).alias("last_start"),
        (F.sum(F.when(~first, start)) - F.sum(F.when(~last, end)) + F.count(F.lit(1)) - 1).alias("bases"),
    )
    return counted.filter("n = s_dst - s_src").select(*KEY, F.col("s_src").alias("c1"), F.col("s_dst").alias("c2"), "s_start", "s_end", (F.col("n") - 1).alias("exons"), *(["first_end", "last_start", "bases"] if inner else []))


def multi_exon_spanning(edges: DataFrame) -> DataFrame:
    """Connections past two exons or more, with the nearest exon inside that the first exon is joined to (nearest) and the
    nearest that is joined to the second (nearest_in), by junctions or introns; null where none is."""
    s, i = side(edges, "s"), side(edges, "i", None)
    found = s.filter("s_dst - s_src > 2").join(i, KEY, "left")
    out = F.when((F.col("i_src") == F.col("s_src")) & (F.col("i_dst") < F.col("s_dst")), F.col("i_dst"))
    into = F.when((F.col("i_dst") == F.col("s_dst")) & (F.col("i_src") > F.col("s_src")), F.col("i_src"))
    return found.groupBy(*KEY, F.col("s_src").alias("c1"), F.col("s_dst").alias("c2"), "s_start", "s_end").agg(F.min(out).alias("nearest"), F.max(into).alias("nearest_in"))


def mutually_exclusive(edges: DataFrame) -> DataFrame:
    """Two unconnected exons, each joined to the same exon before and the same one behind."""
    a = edges.filter("not is_intron").select(*KEY, "src", "dst").distinct()
    name = lambda p: a.select(*KEY, F.col("src").alias(f"{p}s"), F.col("dst").alias(f"{p}d"))
    pair = name("p").join(name("q"), KEY).filter("ps = qs and pd < qd")
    closed = pair.join(name("r"), KEY).filter("rs = pd").join(name("t"), KEY).filter("ts = qd and td = rd")
    found = closed.select(*KEY, F.col("ps").alias("c1"), F.col("pd").alias("a1"), F.col("qd").alias("a2"), F.col("rd").alias("c2")).distinct()
    joined = edges.select(*KEY, F.col("src").alias("a1"), F.col("dst").alias("a2")).distinct()
    return found.filter("c2 > a2").join(joined, [*KEY, "a1", "a2"], "left_anti").select(*KEY, "c1", "a1", "a2", "c2")


def alternative_sites(edges: DataFrame) -> DataFrame:
    """Two connections between the same exons: kind alt5, alt3 (they share one end) or alt3and5 (neither).

    The proximal one is that with the shorter way. On the plus strand a shared end means alternative 5' sites, on the minus
    strand a shared start."""
    a, b = side(edges, "a"), side(edges, "b")
    pairs = a.join(b, KEY).filter("a_src = b_src and a_dst = b_dst and (a_end - a_start < b_end - b_start or (a_end - a_start = b_end - b_start and a_start < b_start))")
    strands = edges.select("gene_id", "strand").distinct()
    five = F.when(F.col("strand") == "-", F.col("a_start") == F.col("b_start")).otherwise(F.col("a_end") == F.col("b_end"))
    three = F.when(F.col("strand") == "-", F.col("a_end") == F.col("b_end")).otherwise(F.col("a_start") == F.col("b_start"))
    kind = F.when(five, "alt5").when(three, "alt3").otherwise("alt3and5")
    return pairs.join(strands, "gene_id").select(*KEY, kind.alias("kind"), F.col("a_src").alias("e1"), F.col("a_dst").alias("e2"), F.col("a_start").alias("proximal_start"), F.col("a_end").alias("proximal_end"), F.col("b_start").alias("distal_start"), F.col("b_end").alias("distal_end"))


def intron_islands(edges: DataFrame) -> DataFrame:
    """gene_id, module_idx, exon, next, island: a module's exons in order with the next one; exons that are joined from one to
    the next by introns have one island."""
    nodes = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("exon")).distinct()
    w = W.partitionBy(*KEY).orderBy("exon")
    steps = edges.filter("is_intron").select(*KEY, F.col("src").alias("exon"), F.col("dst").alias("next"), F.lit(True).alias("_on")).distinct()
    ordered = nodes.withColumn("next", F.lead("exon").over(w)).join(steps, [*KEY, "exon", "next"], "left")
    breaks = F.when(F.col("_on").isNull(), 1).otherwise(0)
    return ordered.withColumn("island", F.coalesce(F.sum(breaks).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(*KEY, "exon", "next", "island")


def putative_alternative_sites(edges: DataFrame, inner: bool = False) -> DataFrame:
    """As a cassette, but one side of the middle exon is joined by an intron, or by a chain of introns through the exons
    between: kind p_alt5 (intron first, on plus) or p_alt3; not where a junction between the two exons that the intron joins
    shares the outer coordinate. inner: also whether the intron is left, and the junction's and the intron's coordinates, of
    a chain those of its first intron."""
    s, i, j = side(edges, "s"), side(edges, "i", True), side(edges, "j")
    islands = intron_islands(edges)
    at = lambda p: islands.select(*KEY, *(F.col(c).alias(f"{p}_{c}") for c in ("exon", "next", "island")))
    before = s.join(j, KEY).filter("j_src > s_src and j_dst = s_dst and j_end = s_end").withColumns({"left": F.lit(True), "from": F.col("s_src"), "to": F.col("j_src")})
    behind = s.join(j, KEY).filter("j_src = s_src and j_dst < s_dst and j_start = s_start").withColumns({"left": F.lit(False), "from": F.col("j_dst"), "to": F.col("s_dst")})
    base = before.unionByName(behind)
    direct = base.join(i, KEY).filter("i_src = from and i_dst = to")
    joined = edges.filter("is_intron").select(*KEY, F.col("src").alias("from"), F.col("dst").alias("to")).distinct()
    linked = base.join(joined, [*KEY, "from", "to"], "left_anti").join(at("x"), KEY).filter("x_exon = from").join(at("y"), KEY).filter("y_exon = to and y_island = x_island")
    chained = linked.join(i, KEY).filter("i_src = x_exon and i_dst = x_next").select(direct.columns)
    both = direct.unionByName(chained).withColumn("a1", F.when(F.col("left"), F.col("to")).otherwise(F.col("from")))
    rival = edges.filter("not is_intron").select(*KEY, F.col("src").alias("from"), F.col("dst").alias("to"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    same = F.when(F.col("left"), F.col("r_start") == F.col("s_start")).otherwise(F.col("r_end") == F.col("s_end"))
    kept_ = both.alias("b").join(rival.alias("r"), [F.col(f"b.{c}") == F.col(f"r.{c}") for c in (*KEY, "from", "to")] + [same], "left_anti")
    strands = edges.select("gene_id", "strand").distinct()
    named = kept_.select(*KEY, "left", F.col("s_src").alias("c1"), "a1", F.col("s_dst").alias("c2"), "s_start", "s_end", "j_start", "j_end", "i_start", "i_end").join(strands, "gene_id")
    return named.withColumn("kind", F.when(F.col("left") == (F.col("strand") == "+"), "p_alt5").otherwise("p_alt3")).select(*KEY, "kind", "c1", "a1", "c2", "s_start", "s_end", *(["left", "j_start", "j_end", "i_start", "i_end"] if inner else [])).distinct()


def alternative_introns(edges: DataFrame) -> DataFrame:
    """Introns whose exons are also joined by a junction that leaves the first or enters the second."""
    i, j = side(edges, "i", True), side(edges, "j")
    return i.join(j, KEY).filter("j_src = i_src or j_dst = i_dst").groupBy(*KEY, F.col("i_src").alias("c1"), F.col("i_dst").alias("c2"), F.col("i_start").alias("start"), F.col("i_end").alias("end")).agg(F.count(F.lit(1)).alias("spliced"))


def alternative_ends(edges: DataFrame, half: DataFrame | None = None) -> DataFrame:
    """Two exons that nothing leaves (enters), joined to one exon: kind last (first on minus) and the reverse.

    The proximal one has the shorter connection. half: gene_id, exon of half exons, which have putative ends instead."""
    strands = edges.select("gene_id", "strand").distinct()
    dead = lambda here, there: edges.select("gene_id", F.col(there).alias("exon")).distinct().join(edges.select("gene_id", F.col(here).alias("exon")).distinct(), ["gene_id", "exon"], "left_anti")

    def pairs(ref: str, end: str, last: bool) -> DataFrame:
        ways = edges.filter("not is_intron").groupBy(*KEY, F.col(ref).alias("ref"), F.col(end).alias("exon")).agg(F.min(F.col("end") - F.col("start")).alias("length"))
        ends = ways.join(dead(ref, end), ["gene_id", "exon"])
        if half is not None:
            ends = ends.join(half.select("gene_id", "exon").distinct(), ["gene_id", "exon"], "left_anti")
        a, b = (ends.select(*KEY, "ref", F.col("exon").alias(f"{p}_exon"), F.col("length").alias(f"{p}_length")) for p in ("proximal", "distal"))
        return a.join(b, [*KEY, "ref"]).filter("proximal_length < distal_length or (proximal_length = distal_length and proximal_exon < distal_exon)").withColumn("right", F.lit(last))

    both = pairs("src", "dst", True).unionByName(pairs("dst", "src", False)).join(strands, "gene_id")
    return both.withColumn("kind", F.when(F.col("right") == (F.col("strand") == "+"), "last").otherwise("first")).select(*KEY, "kind", "ref", "proximal_exon", "distal_exon")


def putative_ends(edges: DataFrame, half: DataFrame) -> DataFrame:
    """gene_id, module_idx, kind (p_last, p_first), ref, half, other, half_start, half_end, other_start, other_end, distal:
    a half exon at the end (beginning) of transcripts, which a connection joins to a full exon that is also joined, on the
    same side, to another one; distal: whether the half exon's connection is the longer one.

    half: gene_id, exon of half exons. A half exon that is left (entered) again in its module is no end, and one that is
    joined to half exons only isn't either; its reference exon may be a half exon then as any other.
    """
    strands = edges.select("gene_id", "strand").distinct()
    halves = half.select("gene_id", "exon").distinct()

    def ends(ref: str, end: str, last: bool) -> DataFrame:
        into = edges.select(*KEY, F.col(ref).alias("ref"), F.col(end).alias("half"), F.col("start").alias("half_start"), F.col("end").alias("half_end")).distinct()
        own = into.join(halves.withColumnRenamed("exon", "half"), ["gene_id", "half"])
        own = own.join(edges.select(*KEY, F.col(ref).alias("half")).distinct(), [*KEY, "half"], "left_anti")
        full = own.select(*KEY, "half", "ref").distinct().join(halves.withColumnRenamed("exon", "ref"), ["gene_id", "ref"], "left_anti").select(*KEY, "half").distinct()
        others = edges.select(*KEY, F.col(ref).alias("ref"), F.col(end).alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end")).distinct()
        return own.join(full, [*KEY, "half"], "left_semi").join(others, [*KEY, "ref"]).filter("other <> half").withColumn("right", F.lit(last))

    both = ends("src", "dst", True).unionByName(ends("dst", "src", False)).join(strands, "gene_id")
    distal = F.col("half_end") - F.col("half_start") > F.col("other_end") - F.col("other_start")
    named = both.withColumns({"kind": F.when(F.col("right") == (F.col("strand") == "+"), "p_last").otherwise("p_first"), "distal": distal})
    return named.select(*KEY, "kind", "ref", "half", "other", "half_start", "half_end", "other_start", "other_end", "distal", "right")


def constitutive(edges: DataFrame) -> DataFrame:
    """The only edge between its two exons, which no other edge leaves or enters on these sides."""
    w = lambda c: F.count(F.lit(1)).over(W.partitionBy("gene_id", c))
    return edges.withColumns({"_o": w("src"), "_i": w("dst")}).filter("_o = 1 and _i = 1").select(*KEY, "src", "dst", "start", "end", "is_intron")


def exitrons(edges: DataFrame, exons: DataFrame) -> DataFrame:
    """Junctions inside an exon. exons: gene_id, exon, e_start, e_end."""
    return edges.filter("not is_intron").join(exons, "gene_id").filter("start > e_start and end < e_end").select("gene_id", "exon", "start", "end").distinct()


def orphans(edges: DataFrame, exons: DataFrame) -> DataFrame:
    """Junctions none of whose ends lies in an exon (half exon to half exon)."""
    e = exons.select("gene_id", "e_start", "e_end")
    touching = edges.join(e, "gene_id").filter("start between e_start and e_end or end between e_start and e_end").select("gene_id", "start", "end").distinct()
    return edges.filter("not is_intron").select("gene_id", "start", "end").distinct().join(touching, ["gene_id", "start", "end"], "left_anti")


def chains(edges: DataFrame, here: str, there: str) -> DataFrame:
    """gene_id, exon, regions: what lies before (here dst, there src) or behind an exon on the one way that there is.

    From an exon that one connection only enters, the exon before it follows if that connection is the only one that leaves
    it, and so on; introns on the way are named too, even one whose exon doesn't follow. Every exon knows its own step;
    steps are put together by pointer doubling, each round an equi-join and a written table, so chains of n exons take
    log2 n rounds.
    """
    name = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("i"))
    w = lambda c: F.count(F.lit(1)).over(W.partitionBy("gene_id", c))
    one = edges.withColumns({"_n": w(here), "_m": w(there)}).filter("_n = 1")
    intron = F.when(F.col("is_intron"), F.array(name)).otherwise(F.array().cast("array<string>"))
    goes = F.col("_m") == 1
    now = kept(one.select("gene_id", F.col(here).alias("exon"), F.when(goes, F.concat(intron, F.array(F.col(there).cast("string")))).otherwise(intron).alias("regions"), F.when(goes, F.col(there)).alias("next")))
    while not now.filter("next is not null").isEmpty():
        ahead = now.select("gene_id", F.col("exon").alias("next"), F.col("regions").alias("more"), F.col("next").alias("after"))
        met = now.join(ahead, ["gene_id", "next"], "left")
        now = kept(met.select("gene_id", "exon", F.concat("regions", F.coalesce("more", F.array().cast("array<string>"))).alias("regions"), F.col("after").alias("next")))
    return now.drop("next")


def primer_regions(edges: DataFrame) -> DataFrame:
    """gene_id, module_idx, kind (source, target), exon, edges, at_module_edge, edge_of_transcript, regions: the exons that
    two connections or more leave or enter, and the constitutive exons and introns on their other side, nearest first, where
    primers can lie.

    kind is along the strand. at_module_edge: the exon begins (ends) its module; edge_of_transcript: nothing is on its other
    side."""
    found = None
    for here, there, left in (("src", "dst", True), ("dst", "src", False)):
        many = edges.groupBy(*KEY, "strand", F.col(here).alias("exon")).agg(F.count(F.lit(1)).alias("edges"))
        total = edges.groupBy("gene_id", F.col(here).alias("exon")).agg(F.count(F.lit(1)).alias("all"))
        outer = edges.groupBy(*KEY).agg((F.min("src") if left else F.max("dst")).alias("outer"))
        other = edges.select("gene_id", F.col(there).alias("exon"), F.lit(False).alias("edge_of_transcript")).distinct()
        part = many.join(total, ["gene_id", "exon"]).filter("all > 1").join(outer, KEY).join(other, ["gene_id", "exon"], "left").join(chains(edges, there, here), ["gene_id", "exon"], "left")
        kind = F.when((F.col("strand") == "+") == F.lit(left), "source").otherwise("target")
        part = part.select(*KEY, kind.alias("kind"), "exon", "edges", (F.col("exon") == F.col("outer")).alias("at_module_edge"), F.coalesce("edge_of_transcript", F.lit(True)).alias("edge_of_transcript"), F.coalesce(F.array_join("regions", ";"), F.lit("")).alias("regions"))
        found = part if found is None else found.unionByName(part)
    return found


def all_events(edges: DataFrame) -> DataFrame:
    """gene_id, module_idx, event_type for every event of these kinds."""
    named = lambda df, k: df.select(*KEY, (F.lit(k) if isinstance(k, str) else k).alias("event_type"))
    found = named(cassette(edges), "cassette")
    for df, kind in (
        (tandem_cassette(edges), "tandem_cassette"),
        (multi_exon_spanning(edges), "multi_exon_spanning"),
        (mutually_exclusive(edges), "mutually_exclusive"),
        (alternative_sites(edges), F.col("kind")),
        (putative_alternative_sites(edges), F.col("kind")),
        (alternative_introns(edges), "alternative_intron"),
        (alternative_ends(edges), F.col("kind")),
    ):
        found = found.unionByName(named(df, kind))
    return found


EVENT_TYPES = ("cassette", "tandem_cassette", "multi_exon_spanning", "mutually_exclusive", "alt5", "alt3", "alt3and5", "p_alt5", "p_alt3", "alternative_intron", "first", "last")


def module_summary(events: DataFrame) -> DataFrame:
    """gene_id, module_idx, a count for each event type, total, complex (more than one event) and the collapsed name."""
    counts = events.groupBy(*KEY).agg(*(F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in EVENT_TYPES), F.count(F.lit(1)).alias("total"))
    parts = F.array(*(F.when(F.col(t) > 0, F.concat(F.lit(t + "^"), F.col(t).cast("string"))) for t in EVENT_TYPES))
    return counts.withColumns({"is_complex": F.col("total") > 1, "collapsed": F.array_join(F.array_compact(parts), "|")})


def heatmap_rows(edges: DataFrame) -> DataFrame:
    """One connection for each module: with an LSV first, then the largest change to 3 digits, then the shortest.

    edges: also lsv_id (null: none) and dpsi."""
    order = [F.col("lsv_id").isNull(), F.desc(F.round(F.abs("dpsi"), 3)), F.col("end") - F.col("start"), "start", "end"]
    return edges.withColumn("_r", F.row_number().over(W.partitionBy(*KEY).orderBy(*order))).filter("_r = 1").select(*KEY, "start", "end", "lsv_id", "dpsi")


def event_changing(junctions: DataFrame, primary: float = 0.2, secondary: float = 0.1) -> DataFrame:
    """event, changing: in some comparison all junctions of the event pass the secondary threshold and one the primary.

    junctions: event, comparison, dpsi (null: not quantified, which fails)."""
    size = F.coalesce(F.abs("dpsi"), F.lit(0.0))
    one = junctions.groupBy("event", "comparison").agg((F.bool_and(size >= secondary) & F.bool_or(size >= primary)).alias("c"))
    return one.groupBy("event").agg(F.bool_or("c").alias("changing"))


def event_nonchanging(junctions: DataFrame, most: float = 0.05, share: float = 1.0, primary: float = 0.2, least_reads: float | None = None) -> DataFrame:
    """event, nonchanging: no junction changes, and `share` of the results are within `most`; with least_reads also every LSV
    of the event has as many, the median reads of its junctions in the event added up.

    junctions: event, comparison, dpsi, and with least_reads lsv_id, junction, median_reads (null where the splicegraph has
    none; an LSV without any isn't asked)."""
    size = F.abs("dpsi")
    found = junctions.groupBy("event").agg(((F.coalesce(F.max(size), F.lit(1.0)) < primary) & (F.avg(F.when(size <= most, 1.0).otherwise(0.0)) >= share)).alias("nonchanging"))
    if least_reads is None:
        return found
    by_lsv = junctions.select("event", "lsv_id", "junction", "median_reads").distinct().groupBy("event", "lsv_id").agg(F.sum("median_reads").alias("reads"))
    enough = by_lsv.groupBy("event").agg(F.bool_and(F.coalesce(F.col("reads") >= least_reads, F.lit(True))).alias("_enough"))
    return found.join(enough, "event").select("event", (F.col("nonchanging") & F.col("_enough")).alias("nonchanging"))


def event_nonchanging_by_comparison(junctions: DataFrame, comparisons: list[str], most: float = 0.05) -> DataFrame:
    """event and a column for each comparison: whether all results of the event's junctions in it are within `most`; null
    where it has none."""
    one = junctions.filter("dpsi is not null").groupBy("event", "comparison").agg(F.bool_and(F.abs("dpsi") <= most).alias("c"))
    every = junctions.select("event").distinct()
    return every.join(one.groupBy("event").pivot("comparison", comparisons).agg(F.first("c")), "event", "left")


def event_changing_by_comparison(junctions: DataFrame, comparisons: list[str], primary: float = 0.2, secondary: float = 0.1) -> DataFrame:
    size = F.coalesce(F.abs("dpsi"), F.lit(0.0))
    one = junctions.groupBy("event", "comparison").agg((F.bool_and(size >= secondary) & F.bool_or(size >= primary)).alias("c"))
    return one.groupBy("event").pivot("comparison", comparisons).agg(F.first("c"))


def paths(edges: DataFrame) -> DataFrame:
    """gene_id, module_idx, path, junctions, length, frame: all ways from each exon that nothing enters to each that nothing
    leaves, through every different connection.

    path: exon numbers with dashes; junctions: start-end of each connection, an intron with an `i`; length: exons; frame:
    the sum of the inner exons' lengths (an exon is [entered at, left at]) mod 3. Ways grow by one connection in each
    round, an equi-join of their last exons with the module's connections, written, so that no task holds a module's ways.
    """
    step = edges.select(*KEY, F.col("src").alias("at"), F.col("dst").alias("to"), "start", "end", F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.when(F.col("is_intron"), "i").otherwise("")).alias("j")).distinct()
    step = kept(step)
    here = step.select(*KEY, "at").distinct()
    entered = step.select(*KEY, F.col("to").alias("at")).distinct()
    none = F.array().cast("array<string>")
    ways = here.join(entered, [*KEY, "at"], "left_anti").select(*KEY, "at", F.array(F.col("at").cast("string")).alias("path"), none.alias("junctions"), F.lit(0).alias("bases"), F.lit(None).cast("int").alias("in_at"))
    ways, done = kept(ways), []
    while not ways.isEmpty():
        inner = F.when(F.col("in_at").isNull(), 0).otherwise(F.col("start") - F.col("in_at") + 1)
        longer = ways.join(step, [*KEY, "at"]).select(*KEY, F.col("to").alias("at"), F.concat("path", F.array(F.col("to").cast("string"))).alias("path"), F.concat("junctions", F.array("j")).alias("junctions"), (F.col("bases") + inner).alias("bases"), F.col("end").alias("in_at"))
        longer = kept(longer.join(here.withColumn("open", F.lit(True)), [*KEY, "at"], "left"))
        done.append(longer.filter("open is null"))
        ways = longer.filter("open").drop("open")
    found = ways.withColumn("open", F.lit(True)) if not done else done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*KEY, F.array_join("path", "-").alias("path"), F.array_join("junctions", ",").alias("junctions"), F.size("path").alias("length"), F.pmod("bases", F.lit(3)).alias("frame"))


def adjacency(edges: DataFrame, value: Column | None = None) -> DataFrame:
    """gene_id, module_idx, i, j, value for each ordered pair of a module's exons: that of their edge (1 by default), else 0."""
    nodes = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("n")).distinct()
    pairs = nodes.withColumnRenamed("n", "i").join(nodes.withColumnRenamed("n", "j"), KEY)
    own = edges.groupBy(*KEY, F.col("src").alias("i"), F.col("dst").alias("j")).agg((F.max(F.lit(1)) if value is None else F.avg(value)).cast("double").alias("value"))
    return pairs.join(own, [*KEY, "i", "j"], "left").na.fill(0.0, ["value"])


def resolved_junctions(edges: DataFrame) -> DataFrame:
    """Each junction with every start of its first exon and every end of its second that some edge uses."""
    starts = edges.select("gene_id", F.col("dst").alias("src"), F.col("end").alias("exon_start")).distinct()
    ends = edges.select("gene_id", F.col("src").alias("dst"), F.col("start").alias("exon_end")).distinct()
    j = edges.filter("not is_intron").select(*KEY, "src", "dst", "start", "end").distinct()
    return j.join(starts, ["gene_id", "src"], "left").join(ends, ["gene_id", "dst"], "left").distinct()


def decomplexified(edges: DataFrame, reads: int = 1, psi: float = 0.05, dpsi: float = 0.0, keep: bool = False) -> DataFrame:
    """Edges with enough reads in some experiment and, of what their results have of PSI and change, enough of each in some
    result; those without any result stay if they are constitutive, or with keep.

    edges: also max_reads, max_psi, max_dpsi (null: no result), and is_constitutive if any can be."""
    stay = F.lit(keep) | (F.coalesce("is_constitutive", F.lit(False)) if "is_constitutive" in edges.columns else F.lit(False))
    none = F.col("max_psi").isNull() & F.col("max_dpsi").isNull()
    enough = F.coalesce(F.col("max_psi") >= psi, F.lit(True)) & F.coalesce(F.abs("max_dpsi") >= dpsi, F.lit(True))
    return edges.filter((F.col("max_reads") >= reads) & F.when(none, stay).otherwise(enough))


def edge_quantification(edges: DataFrame, quant: DataFrame) -> DataFrame:
    """gene_id, start, end, value: mean over the LSVs that hold an edge, by exact coordinates; -1 where none does.

    quant: gene_id, start, end, lsv_id, value, file_order; of several files' values for an LSV the first file's counts."""
    first = quant.withColumn("_r", F.row_number().over(W.partitionBy("gene_id", "lsv_id", "start", "end").orderBy("file_order"))).filter("_r = 1")
    mean = first.groupBy("gene_id", "start", "end").agg(F.avg("value").alias("value"))
    return edges.select("gene_id", "start", "end").distinct().join(mean, ["gene_id", "start", "end"], "left").na.fill(-1.0, ["value"])


def cassette_rows(found: DataFrame) -> DataFrame:
    """Four rows for each cassette exon: the skipping and the including connection seen from both outer exons.

    Columns: event_id, junction_name, side (s, t), start, end, event_size (the exon's length)."""
    row = lambda name, side_, s, e: F.struct(F.lit(name).alias("junction_name"), F.lit(side_).alias("side"), F.col(s).alias("start"), F.col(e).alias("end"))
    rows = F.array(row("C1_C2", "s", "s_start", "s_end"), row("C1_A", "s", "s_start", "a1_start"), row("C2_C1", "t", "s_start", "s_end"), row("C2_A", "t", "a1_end", "s_end"))
    order = F.row_number().over(W.partitionBy(*KEY).orderBy("c1", "a1", "c2", "s_start", "s_end", "a1_start", "a1_end"))
    named = found.withColumn("event_id", F.concat("gene_id", F.lit("_"), F.col("module_idx").cast("string"), F.lit("_CE_"), order.cast("string")))
    return named.select("event_id", (F.col("a1_end") - F.col("a1_start") + 1).alias("event_size"), F.explode(rows).alias("r")).select("event_id", "r.*", "event_size")


def trimmed_exons(exons: DataFrame, edges: DataFrame) -> DataFrame:
    """Exons drawn in to the outermost coordinates that edges use; a side that an intron touches, or none, stays, and exons
    without edges go. exons: gene_id, exon, e_start, e_end."""
    into = edges.groupBy("gene_id", F.col("dst").alias("exon")).agg(F.min("end").alias("l"), F.bool_or("is_intron").alias("li"))
    out = edges.groupBy("gene_id", F.col("src").alias("exon")).agg(F.max("start").alias("h"), F.bool_or("is_intron").alias("hi"))
    both = into.join(out, ["gene_id", "exon"], "full").join(exons, ["gene_id", "exon"])
    start = F.when(F.col("l").isNull() | F.col("li"), F.col("e_start")).otherwise(F.greatest("e_start", "l"))
    end = F.when(F.col("h").isNull() | F.col("hi"), F.col("e_end")).otherwise(F.least("e_end", "h"))
    return both.select("gene_id", "exon", start.alias("start"), end.alias("end"))
