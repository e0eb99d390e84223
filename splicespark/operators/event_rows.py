"""Rows of event tables: every connection of every event, seen from the reference exon that it is quantified at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import modules as M
from .tables import kept

KEY = M.KEY
NEED_EXONS = ("exitron", "orphan")
NEED_HALF = ("p_first", "p_last")
TYPES = ("cassette", "tandem_cassette", "mutually_exclusive", "alt5", "alt3", "alt3and5", "alternative_intron", "first", "last", "multi_exon_spanning", "p_alt5", "p_alt3", "constitutive")


def row(name: str, side: str | Column, exon: str, start: str | Column, end: str | Column) -> Column:
    """A connection of an event; side: s if its reference exon is its source, t if its target; exon: that exon."""
    at = lambda c, n: (F.col(c) if isinstance(c, str) else c).cast("int").alias(n)
    return F.struct(F.lit(name).alias("junction_name"), (F.lit(side) if side in ("s", "t") else F.col(side)).alias("side"), at(exon, "exon"), at(start, "start"), at(end, "end"))


def shortest(edges: DataFrame, p: str, introns: bool = False) -> DataFrame:
    """The junction (or, with introns, connection) that stands for two exons: the one with the least start, then end."""
    one = edges.filter(F.lit(introns) | ~F.col("is_intron")).groupBy(*KEY, F.col("src").alias(f"{p}_src"), F.col("dst").alias(f"{p}_dst")).agg(F.min(F.struct("start", "end")).alias("_x"))
    return one.select(*KEY, f"{p}_src", f"{p}_dst", F.col("_x.start").alias(f"{p}_start"), F.col("_x.end").alias(f"{p}_end"))


def between(events: DataFrame, edges: DataFrame, p: str, src: str, dst: str, how: str = "inner", introns: bool = False) -> DataFrame:
    """Adds the coordinates p_start and p_end of the connection that stands for the exons src and dst."""
    e = shortest(edges, p, introns).withColumnsRenamed({f"{p}_src": src, f"{p}_dst": dst})
    return events.join(e, [*KEY, src, dst], how)


def extents(edges: DataFrame) -> DataFrame:
    """gene_id, a1, x_start, x_end: the outermost coordinates that connections enter and leave an exon at."""
    into = edges.groupBy("gene_id", F.col("dst").alias("a1")).agg(F.min("end").alias("x_start"))
    return into.join(edges.groupBy("gene_id", F.col("src").alias("a1")).agg(F.max("start").alias("x_end")), ["gene_id", "a1"])


def none() -> Column:
    """No event size: these types have none."""
    return F.lit(None).cast("int").alias("event_size")


def cassette(edges: DataFrame) -> DataFrame:
    rows = F.array(row("C1_C2", "s", "c1", "s_start", "s_end"), row("C1_A", "s", "c1", "s_start", "a1_start"), row("C2_C1", "t", "c2", "s_start", "s_end"), row("C2_A", "t", "c2", "a1_end", "s_end"))
    return M.cassette(edges).select(*KEY, F.concat_ws("_", "c1", "a1", "c2", "s_start", "s_end", "a1_start", "a1_end").alias("event"), (F.col("a1_end") - F.col("a1_start") + 1).alias("event_size"), rows.alias("rows"))


def tandem_cassette(edges: DataFrame) -> DataFrame:
    rows = F.array(row("C1_C2", "s", "c1", "s_start", "s_end"), row("C1_A", "s", "c1", "s_start", "first_end"), row("C2_C1", "t", "c2", "s_start", "s_end"), row("C2_A_Last", "t", "c2", "last_start", "s_end"))
    return M.tandem_cassette(edges, inner=True).select(*KEY, F.concat_ws("_", "c1", "c2", "s_start", "s_end").alias("event"), F.col("bases").cast("int").alias("event_size"), rows.alias("rows"))


def mutually_exclusive(edges: DataFrame) -> DataFrame:
    found = M.mutually_exclusive(edges)
    for p, src, dst in (("x", "c1", "a1"), ("y", "c1", "a2"), ("u", "a1", "c2"), ("v", "a2", "c2")):
        found = between(found, edges, p, src, dst)
    rows = F.array(row("C1_A1", "s", "c1", "x_start", "x_end"), row("C1_A2", "s", "c1", "y_start", "y_end"), row("C2_A1", "t", "c2", "u_start", "u_end"), row("C2_A2", "t", "c2", "v_start", "v_end"))
    return found.select(*KEY, F.concat_ws("_", "c1", "a1", "a2", "c2").alias("event"), none(), rows.alias("rows"))


def alternative_sites(edges: DataFrame, kind: str, lsvs: DataFrame) -> DataFrame:
    """Alternative 3' sites are quantified at their common source if that is an LSV, else at the target; 5' sites the other
    way round (on the plus strand); at neither there are no rows. Both kinds at once have rows at the source and the target."""
    own = M.alternative_sites(edges).filter(F.col("kind") == kind)
    event = F.concat_ws("_", "e1", "e2", "proximal_start", "proximal_end", "distal_start", "distal_end").alias("event")
    if kind == "alt3and5":
        rows = F.array(*(row(f"{e}_{f}_{j}", side, e.lower(), f"{p}_start", f"{p}_end") for e, f, side in (("E1", "E2", "s"), ("E2", "E1", "t")) for j, p in (("J1", "proximal"), ("J2", "distal"))))
        return own.select(*KEY, event, none(), rows.alias("rows"))
    there = lambda side, exon, name: lsvs.filter(F.col("side") == side).select("gene_id", F.col("exon").alias(exon), F.lit(True).alias(name))
    own = own.join(there("s", "e1", "at_source"), ["gene_id", "e1"], "left").join(there("t", "e2", "at_target"), ["gene_id", "e2"], "left")
    left = F.col("proximal_start") == F.col("distal_start")  # the source is common
    source = F.when(left, F.col("at_source").isNotNull()).otherwise(F.col("at_target").isNull())
    own = own.filter("at_source or at_target").withColumn("side", F.when(source, "s").otherwise("t")).withColumn("ref", F.when(F.col("side") == "s", F.col("e1")).otherwise(F.col("e2")))
    size = F.abs(F.col("proximal_start") - F.col("distal_start")) + F.abs(F.col("proximal_end") - F.col("distal_end"))
    rows = F.array(row("Proximal", "side", "ref", "proximal_start", "proximal_end"), row("Distal", "side", "ref", "distal_start", "distal_end"))
    return own.select(*KEY, event, size.alias("event_size"), rows.alias("rows"))


def alternative_intron(edges: DataFrame) -> DataFrame:
    """An event for each intron and junction beside it, quantified at one exon: the target if the junction enters it too, else
    the source."""
    i = M.side(edges, "i", True)
    found = i.join(M.side(edges, "j"), KEY).filter("j_src = i_src or j_dst = i_dst").distinct()
    target = F.col("j_dst") == F.col("i_dst")
    at = lambda name: F.array(*(row(f"{name}_{k}", "side", "ref", f"{p}_start", f"{p}_end") for k, p in (("intron", "i"), ("spliced", "j"))))
    own = found.withColumns({"side": F.when(target, "t").otherwise("s"), "ref": F.when(target, F.col("i_dst")).otherwise(F.col("i_src"))})
    return own.select(*KEY, F.concat_ws("_", "i_src", "i_dst", "i_start", "i_end", "j_src", "j_dst", "j_start", "j_end").alias("event"), (F.col("i_end") - F.col("i_start") + 1).alias("event_size"), F.when(target, at("C2_C1")).otherwise(at("C1_C2")).alias("rows"))


def alternative_ends(edges: DataFrame, kind: str) -> DataFrame:
    own = M.alternative_ends(edges).filter(F.col("kind") == kind).join(edges.select("gene_id", "strand").distinct(), "gene_id")
    out = (F.lit(kind) == "last") == (F.col("strand") == "+")
    own = own.select(*KEY, "ref", "proximal_exon", "distal_exon", F.when(out, "s").otherwise("t").alias("side"))
    for p in ("proximal", "distal"):
        own = own.withColumns({f"{p}_from": F.when(F.col("side") == "s", F.col("ref")).otherwise(F.col(f"{p}_exon")), f"{p}_to": F.when(F.col("side") == "s", F.col(f"{p}_exon")).otherwise(F.col("ref"))})
        own = between(own, edges, p, f"{p}_from", f"{p}_to")
    rows = F.array(row("Proximal", "side", "ref", "proximal_start", "proximal_end"), row("Distal", "side", "ref", "distal_start", "distal_end"))
    return own.select(*KEY, F.concat_ws("_", "ref", "proximal_exon", "distal_exon", "side").alias("event"), F.lit(None).cast("int").alias("event_size"), rows.alias("rows"))


def multi_exon_spanning(edges: DataFrame) -> DataFrame:
    """From both ends the connection past the exons and the one to the nearest of them, without coordinates if there is none."""
    found = between(between(M.multi_exon_spanning(edges), edges, "x", "c1", "nearest", "left", True), edges, "y", "nearest_in", "c2", "left", True)
    rows = F.array(row("C1_C2", "s", "c1", "s_start", "s_end"), row("C1_A", "s", "c1", "x_start", "x_end"), row("C2_C1", "t", "c2", "s_start", "s_end"), row("A_C2", "t", "c2", "y_start", "y_end"))
    return found.select(*KEY, F.concat_ws("_", "c1", "c2", "s_start", "s_end").alias("event"), none(), rows.alias("rows"))


def putative_sites(edges: DataFrame, kind: str) -> DataFrame:
    """From both outer exons the connection past the middle one (Distal), and the intron or the junction (Proximal) to it. The
    size is that of the intron and the middle exon."""
    own = M.putative_alternative_sites(edges, inner=True).filter(F.col("kind") == kind).join(extents(edges), ["gene_id", "a1"])
    past = [row("Distal", s, e, "s_start", "s_end") for s, e in (("s", "c1"), ("t", "c2"))]
    way = lambda side, exon, intron: row("Intron" if intron else "Proximal", side, exon, "i_start" if intron else "j_start", "i_end" if intron else "j_end")
    rows = F.when(F.col("left"), F.array(past[0], way("s", "c1", True), past[1], way("t", "c2", False))).otherwise(F.array(past[0], way("s", "c1", False), past[1], way("t", "c2", True)))
    size = F.col("i_end") - F.col("i_start") + 1 + F.abs(F.col("x_end") - F.col("x_start")) + 1
    return own.select(*KEY, F.concat_ws("_", "c1", "a1", "c2", "s_start", "s_end", "j_start", "j_end", "i_start", "i_end").alias("event"), size.alias("event_size"), rows.alias("rows")).distinct()


def putative_ends(edges: DataFrame, kind: str, half: DataFrame) -> DataFrame:
    """The half exon's connection and the other one of their reference exon, the shorter one Proximal."""
    own = M.putative_ends(edges, half).filter(F.col("kind") == kind).withColumn("side", F.when(F.col("right"), "s").otherwise("t"))
    pair = lambda a, b: F.array(row("Proximal", "side", "ref", f"{a}_start", f"{a}_end"), row("Distal", "side", "ref", f"{b}_start", f"{b}_end"))
    event = F.concat_ws("_", "ref", "half", "other", "half_start", "half_end", "other_start", "other_end").alias("event")
    return own.select(*KEY, event, none(), F.when(F.col("distal"), pair("other", "half")).otherwise(pair("half", "other")).alias("rows"))


def exitron(edges: DataFrame, exons: DataFrame) -> DataFrame:
    """Junctions inside an exon, seen from both sides of it. exons: gene_id, exon, e_start, e_end."""
    own = edges.filter("not is_intron").join(exons, "gene_id").filter("start > e_start and end < e_end").select(*KEY, "exon", "start", "end").distinct()
    rows = F.array(row("exitron", "s", "exon", "start", "end"), row("exitron", "t", "exon", "start", "end"))
    return own.select(*KEY, F.concat_ws("_", "exon", "start", "end").alias("event"), none(), rows.alias("rows"))


def orphan(edges: DataFrame, exons: DataFrame, lsvs: DataFrame) -> DataFrame:
    """Junctions between half exons, quantified at the source if that is an LSV, else at the target; at neither there is no
    row."""
    own = edges.filter("not is_intron").join(M.orphans(edges, exons), ["gene_id", "start", "end"]).select(*KEY, "src", "dst", "start", "end").distinct()
    there = lambda side, exon, name: lsvs.filter(F.col("side") == side).select("gene_id", F.col("exon").alias(exon), F.lit(True).alias(name))
    own = own.join(there("s", "src", "at_source"), ["gene_id", "src"], "left").join(there("t", "dst", "at_target"), ["gene_id", "dst"], "left").filter("at_source or at_target")
    own = own.withColumns({"side": F.when(F.col("at_source"), "s").otherwise("t"), "ref": F.when(F.col("at_source"), F.col("src")).otherwise(F.col("dst"))})
    return own.select(*KEY, F.concat_ws("_", "src", "dst", "start", "end").alias("event"), none(), F.array(row("Orphan", "side", "ref", "start", "end")).alias("rows"))


def constitutive(edges: DataFrame) -> DataFrame:
    rows = F.array(row("C1_C2", "s", "src", "start", "end"), row("C2_C1", "t", "dst", "start", "end"))
    return M.constitutive(edges).select(*KEY, F.concat_ws("_", "src", "dst", "start", "end").alias("event"), F.lit(None).cast("int").alias("event_size"), rows.alias("rows"))


def connections(edges: DataFrame, kind: str, exons: DataFrame | None = None, lsvs: DataFrame | None = None, half: DataFrame | None = None) -> DataFrame:
    """gene_id, module_idx, event, event_size, junction_name, side, exon, start, end of all events of a type.

    exons: gene_id, exon, e_start, e_end, which exitrons and orphans need; half: gene_id, exon of half exons, which putative
    ends need; lsvs: gene_id, exon, side of those LSVs that are quantified, all by default."""
    if kind in NEED_EXONS and exons is None or kind in NEED_HALF and half is None:
        raise ValueError(f"{kind} needs {'exons' if kind in NEED_EXONS else 'half exons'}")
    there = lsv_sides(edges) if lsvs is None else lsvs
    find = {"alt5": alternative_sites, "alt3": alternative_sites, "alt3and5": alternative_sites}.get(kind)
    by_kind = {"first": alternative_ends, "last": alternative_ends, "p_alt5": putative_sites, "p_alt3": putative_sites}.get(kind)
    if find:
        found = find(edges, kind, there)
    elif by_kind:
        found = by_kind(edges, kind)
    elif kind == "orphan":
        found = orphan(edges, exons, there)
    elif kind in NEED_HALF:
        found = putative_ends(edges, kind, half)
    else:
        found = exitron(edges, exons) if kind == "exitron" else globals()[kind](edges)
    return found.select(*KEY, "event", "event_size", F.explode("rows").alias("r")).select(*KEY, "event", "event_size", "r.*")


def lsv_sides(edges: DataFrame) -> DataFrame:
    """gene_id, module_idx, exon, side, lsv_id: exons that two or more connections leave (s) or enter (t)."""
    many = lambda c, s: edges.groupBy("gene_id", F.col(c).alias("exon")).agg(F.count(F.lit(1)).alias("n"), F.min("module_idx").alias("module_idx")).filter("n > 1").select(*KEY, "exon", F.lit(s).alias("side"), F.concat_ws(":", "gene_id", F.lit(s), F.col("exon").cast("string")).alias("lsv_id"))
    return many("src", "s").unionByName(many("dst", "t"))


def event_rows(edges: DataFrame, kind: str, exons: DataFrame | None = None, lsvs: DataFrame | None = None, half: DataFrame | None = None) -> DataFrame:
    """event_id, junction_name, side, start, end, along, event_size, de_novo, lsv_id of all events of a type.

    along: the range in the direction of the strand; lsv_id: the LSV of the reference exon, null where fewer than two
    connections are on that side; de_novo: of the connection (edges' column, false without it). A row without coordinates
    has none of these.
    """
    each = connections(edges, kind, exons, lsvs, half).withColumn("event_id", F.concat_ws("_", "gene_id", F.col("module_idx").cast("string"), F.lit(kind), "event")).drop("module_idx", "event")
    lsvs = lsv_sides(edges).drop("module_idx")
    novel = (F.col("de_novo") if "de_novo" in edges.columns else F.lit(False)).alias("de_novo")
    marks = edges.select("gene_id", "strand", "start", "end", novel).groupBy("gene_id", "start", "end").agg(F.first("strand").alias("strand"), F.bool_and("de_novo").alias("de_novo"))
    whole = each.join(marks, ["gene_id", "start", "end"], "left").join(lsvs, ["gene_id", "exon", "side"], "left")
    along = F.when(F.col("strand") == "-", F.concat_ws("-", "end", "start")).when(F.col("start").isNotNull(), F.concat_ws("-", "start", "end"))
    return whole.select("event_id", "junction_name", "side", "start", "end", along.alias("along"), "event_size", "de_novo", "lsv_id")


def classified(edges: DataFrame, keep_constitutive: bool = False) -> tuple[DataFrame, DataFrame]:
    """used (gene_id, module_idx, event_type, event, side, exon, start, end): every connection of every event; others
    (gene_id, module_idx, lsvs, junctions): for the modules with LSVs that no event is quantified at, these LSVs and the
    connections in no event, as texts with semicolons in order. Constitutive connections are events if they are kept. Both
    tables are read often, so they are written once."""
    edges = kept(edges)
    named = lambda k: connections(edges, k).select(*KEY, F.lit(k).alias("event_type"), "event", "side", "exon", "start", "end")
    kinds = [k for k in TYPES if keep_constitutive or k != "constitutive"]
    used = named(kinds[0])
    for k in kinds[1:]:
        used = used.unionByName(named(k))
    used = kept(used.filter("start is not null"))
    listed = lambda df, c, name: df.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set(c)), ";").alias(name))
    lsvs = lsv_sides(edges).join(used.select("gene_id", "side", "exon").distinct(), ["gene_id", "side", "exon"], "left_anti")
    free = edges.select(*KEY, "start", "end").join(used.select("gene_id", "start", "end").distinct(), ["gene_id", "start", "end"], "left_anti")
    others = listed(lsvs, "lsv_id", "lsvs").join(listed(free, F.concat_ws("-", "start", "end"), "junctions"), KEY, "left")
    return used, others.na.fill("", ["junctions"])


def other_events(edges: DataFrame, keep_constitutive: bool = False) -> DataFrame:
    """gene_id, module_idx, lsvs, junctions of the modules that events don't explain."""
    return classified(edges, keep_constitutive)[1]


def module_complexity(edges: DataFrame, keep_constitutive: bool = False) -> DataFrame:
    """gene_id, module_idx, total (events that aren't constitutive, and the other event), is_complex.

    Over one event is complex, but for a tandem cassette with the multi-exon spanning of the same module and for an
    alternative intron with one kind of putative sites; so are LSVs and connections that no event explains.
    """
    used, others = classified(edges, keep_constitutive)
    events = used.filter("event_type <> 'constitutive'").select(*KEY, "event_type", "event").distinct()
    one = lambda t: F.count(F.when(F.col("event_type") == t, 1)) == 1
    pair = (one("multi_exon_spanning") & one("tandem_cassette")) | (one("alternative_intron") & (one("p_alt3") | one("p_alt5")))
    counts = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), pair.alias("pair"))
    whole = edges.select(*KEY).distinct().join(counts, KEY, "left").na.fill(0, ["n"]).na.fill(False, ["pair"]).join(others, KEY, "left")
    many = (F.col("n") > 1) & ~((F.col("n") == 2) & F.col("pair"))
    return whole.select(*KEY, (F.col("n") + F.col("lsvs").isNotNull().cast("int")).alias("total"), (many | F.coalesce(F.col("junctions") != "", F.lit(False))).alias("is_complex"))
