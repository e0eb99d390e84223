"""Event rows, intron chains, putative ends and primer chains on hand-made modules, both strands."""

import pytest

from splicespark.operators import event_rows as R
from splicespark.operators import modules as M

SCHEMA = "gene_id string, strand string, src int, dst int, start int, end int, is_intron boolean, module_idx int"


def edges_of(spark, *edges, strand="+"):
    """(src, dst, start, end[, intron]) of one module."""
    return spark.createDataFrame([("g", strand, *e[:4], bool(e[4]) if len(e) > 4 else False, 1) for e in edges], SCHEMA)


def rows_of(edges, kind, **more):
    got = R.event_rows(edges, kind, **more).collect()
    return sorted((r.junction_name, r.side, r.start, r.end, r.event_size) for r in got)


TANDEM = [(0, 1, 300, 1100), (1, 2, 1300, 2100), (2, 3, 2350, 3100), (0, 3, 300, 3100)]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_tandem_and_spanning(spark, strand):
    e = edges_of(spark, *TANDEM, strand=strand)
    size = (1300 - 1100 + 1) + (2350 - 2100 + 1)  # of the exons, not of the introns between
    assert rows_of(e, "tandem_cassette") == [("C1_A", "s", 300, 1100, size), ("C1_C2", "s", 300, 3100, size), ("C2_A_Last", "t", 2350, 3100, size), ("C2_C1", "t", 300, 3100, size)]
    assert rows_of(e, "multi_exon_spanning") == [("A_C2", "t", 2350, 3100, None), ("C1_A", "s", 300, 1100, None), ("C1_C2", "s", 300, 3100, None), ("C2_C1", "t", 300, 3100, None)]
    along = {r.along for r in R.event_rows(e, "tandem_cassette").collect()}
    assert ("3100-300" if strand == "-" else "300-3100") in along


def test_spanning_without_a_way_in(spark):
    e = edges_of(spark, (0, 3, 300, 3100), (1, 2, 1300, 2100), (0, 1, 300, 1100))
    got = rows_of(e, "multi_exon_spanning")
    assert ("A_C2", "t", None, None, None) in got and ("C1_A", "s", 300, 1100, None) in got and len(got) == 4
    used, _ = R.classified(e)
    assert used.filter("start is null").count() == 0


def test_three_and_five_prime(spark):
    e = edges_of(spark, (0, 1, 300, 1100), (0, 1, 260, 1130))
    assert rows_of(e, "alt3and5") == [("E1_E2_J1", "s", 300, 1100, None), ("E1_E2_J2", "s", 260, 1130, None), ("E2_E1_J1", "t", 300, 1100, None), ("E2_E1_J2", "t", 260, 1130, None)]


@pytest.mark.parametrize("there,side", [(["s", "t"], "s"), (["s"], "s"), (["t"], "t"), ([], None)])
def test_alternative_sites_take_the_lsv_that_is_there(spark, there, side):
    e = edges_of(spark, (0, 1, 300, 1100), (0, 1, 300, 1130))  # the source is common
    lsvs = spark.createDataFrame([("g", 0 if s == "s" else 1, s) for s in there], "gene_id string, exon int, side string")
    want = [] if side is None else [("Distal", side, 300, 1130, 30), ("Proximal", side, 300, 1100, 30)]
    assert rows_of(e, "alt3", lsvs=lsvs) == want
    five = edges_of(spark, (0, 1, 300, 1100), (0, 1, 260, 1100))
    want = {"s": "t", "t": "t"} if set(there) == {"s", "t"} else {s: s for s in there}
    assert {r[1] for r in rows_of(five, "alt5", lsvs=lsvs)} == set(want.values())


def test_mutually_exclusive_has_no_size(spark):
    e = edges_of(spark, (0, 1, 300, 1100), (0, 2, 300, 2100), (1, 3, 1300, 3100), (2, 3, 2300, 3100))
    assert rows_of(e, "mutually_exclusive") == [("C1_A1", "s", 300, 1100, None), ("C1_A2", "s", 300, 2100, None), ("C2_A1", "t", 1300, 3100, None), ("C2_A2", "t", 2300, 3100, None)]


def test_alternative_introns_are_quantified_at_one_exon(spark):
    e = edges_of(spark, (0, 1, 300, 1100, True), (0, 1, 310, 1100), (0, 2, 300, 2100))
    got = rows_of(e, "alternative_intron")
    assert got == [("C1_C2_intron", "s", 300, 1100, 801), ("C1_C2_spliced", "s", 300, 2100, 801), ("C2_C1_intron", "t", 300, 1100, 801), ("C2_C1_spliced", "t", 310, 1100, 801)]


@pytest.mark.parametrize("strand,left,right", [("+", "p_alt5", "p_alt3"), ("-", "p_alt3", "p_alt5")])
def test_putative_sites(spark, strand, left, right):
    e = edges_of(spark, (0, 2, 300, 2100), (0, 1, 300, 1100, True), (1, 2, 1300, 2100), strand=strand)
    size = 801 + 201
    assert rows_of(e, left) == [("Distal", "s", 300, 2100, size), ("Distal", "t", 300, 2100, size), ("Intron", "s", 300, 1100, size), ("Proximal", "t", 1300, 2100, size)]
    assert rows_of(e, right) == []
    e = edges_of(spark, (0, 2, 300, 2100), (0, 1, 300, 1100), (1, 2, 1300, 2100, True), strand=strand)
    size = 801 + 201
    assert rows_of(e, right) == [("Distal", "s", 300, 2100, size), ("Distal", "t", 300, 2100, size), ("Intron", "t", 1300, 2100, size), ("Proximal", "s", 300, 1100, size)]


def test_intron_chains_and_rivals(spark):
    chain = [(0, 3, 300, 3100), (0, 1, 300, 1100, True), (1, 2, 1300, 2100, True), (2, 3, 2300, 3100)]
    found = lambda *edges: [(r.kind, r.c1, r.a1, r.c2, r.i_start, r.i_end) for r in M.putative_alternative_sites(edges_of(spark, *edges), inner=True).collect()]
    assert found(*chain) == [("p_alt5", 0, 2, 3, 300, 1100)]  # through exon 1; the first intron stands for the chain
    assert found(*chain[:2], (1, 2, 1300, 2100), chain[3]) == []  # the chain is broken by a junction
    assert found(*chain, (0, 2, 300, 2100)) == []  # a junction between the exons shares the outer coordinate
    assert found(*chain, (0, 2, 280, 2100)) == [("p_alt5", 0, 2, 3, 300, 1100)]
    direct = found(*chain, (0, 2, 300, 2100, True))
    assert ("p_alt5", 0, 2, 3, 300, 2100) in direct and ("p_alt5", 0, 2, 3, 300, 1100) not in direct
    islands = {r.exon: r.island for r in M.intron_islands(edges_of(spark, *chain)).collect()}
    assert islands[0] == islands[1] == islands[2] != islands[3]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_putative_ends(spark, strand):
    half = spark.createDataFrame([("g", 2)], "gene_id string, exon int")
    e = edges_of(spark, (0, 1, 300, 1100), (0, 2, 300, 2100), (1, 3, 1300, 3100), strand=strand)
    kind, other = ("p_last", "p_first") if strand == "+" else ("p_first", "p_last")
    assert rows_of(e, kind, half=half) == [("Distal", "s", 300, 2100, None), ("Proximal", "s", 300, 1100, None)]
    assert rows_of(e, other, half=half) == []
    again = edges_of(spark, (0, 1, 300, 1100), (0, 2, 300, 2100), (2, 3, 2300, 3100), (1, 3, 1300, 3100), strand=strand)
    assert rows_of(again, kind, half=half) == []  # the half exon is left again
    alone = spark.createDataFrame([("g", 2), ("g", 0)], "gene_id string, exon int")
    assert rows_of(e, kind, half=alone) == []  # joined to half exons only
    ends = edges_of(spark, (0, 1, 300, 1100), (0, 2, 300, 2100), strand=strand)
    assert M.alternative_ends(ends).count() == 1 and M.alternative_ends(ends, half).count() == 0
    with pytest.raises(ValueError):
        R.connections(e, kind)


def test_exitrons_and_orphans(spark):
    exons = spark.createDataFrame([("g", 0, 100, 500), ("g", 1, 1000, 1300)], "gene_id string, exon int, e_start int, e_end int")
    e = edges_of(spark, (0, 0, 200, 400), (0, 1, 500, 1000), (2, 3, 2300, 3100), (2, 4, 2300, 4100))
    assert rows_of(e, "exitron", exons=exons) == [("exitron", "s", 200, 400, None), ("exitron", "t", 200, 400, None)]
    assert rows_of(e, "orphan", exons=exons) == [("Orphan", "s", 2300, 3100, None), ("Orphan", "s", 2300, 4100, None)]
    lone = edges_of(spark, (2, 3, 2300, 3100))
    assert rows_of(lone, "orphan", exons=exons) == []  # no LSV on either side


def test_primer_chains(spark):
    e = edges_of(spark, (0, 1, 300, 1100), (1, 2, 1300, 2100, True), (2, 3, 2300, 3100), (3, 4, 3300, 4100), (3, 5, 3300, 5100), (4, 5, 4300, 5100), (5, 6, 5300, 6100, True), (6, 7, 6300, 7100))
    got = {(r.kind, r.exon): (r.edges, r.at_module_edge, r.edge_of_transcript, r.regions) for r in M.primer_regions(e).collect()}
    assert got == {("source", 3): (2, False, False, "2;1300-2100i;1;0"), ("target", 5): (2, False, False, "5300-6100i;6;7")}
    minus = {r.kind: r.exon for r in M.primer_regions(edges_of(spark, *TANDEM, strand="-")).collect()}
    assert minus == {"target": 0, "source": 3}
    split = edges_of(spark, (0, 1, 300, 1100, True), (0, 2, 300, 2100), (1, 3, 1300, 3100), (1, 4, 1300, 4100))
    got = {(r.kind, r.exon): (r.at_module_edge, r.edge_of_transcript, r.regions) for r in M.primer_regions(split).collect()}
    assert got == {("source", 0): (True, True, ""), ("source", 1): (False, False, "300-1100i")}  # exon 0 has two ways out: the intron alone
    long = edges_of(spark, *((k, k + 1, 1000 * k + 300, 1000 * k + 1100) for k in range(40)), (40, 41, 40300, 41100), (40, 42, 40300, 42100))
    assert M.primer_regions(long).filter("kind = 'source'").first().regions == ";".join(map(str, range(39, -1, -1)))


def test_valid_modules(spark):
    rows = [("g", "+", 0, 1, 300, 1100, False, 1), ("g", "+", 0, 2, 300, 2100, False, 1), ("g", "+", 1, 2, 1300, 2100, False, 1), ("g", "+", 2, 3, 2300, 3100, False, 2), ("g", "+", 3, 4, 3300, 4100, False, 3), ("g", "+", 3, 4, 3310, 4100, False, 3)]
    e = spark.createDataFrame(rows, SCHEMA)
    of = lambda **k: sorted({r.module_idx for r in M.valid_modules(e, **k).collect()})
    lsvs = R.lsv_sides(e).select("gene_id", "exon", "side")
    assert of() == [1, 3] and of(least_edges=1) == [1, 2, 3] and of(least_edges=1, lsvs=lsvs) == [1, 3]
    some = spark.createDataFrame([("g", 3, "s"), ("g", 2, "s"), ("h", 0, "s")], "gene_id string, exon int, side string")
    assert of(lsvs=lsvs, changing=some) == [3] and of(lsvs=lsvs, changing=some.limit(0)) == []
    # exon 2 is entered in module 1 and left in module 2: its target is not of module 2
    entered = spark.createDataFrame([("g", 2, "t")], "gene_id string, exon int, side string")
    assert of(least_edges=1, lsvs=entered) == [1]


def test_decomplexified_by_what_is_known(spark):
    rows = [("psi", 5, 0.5, None, False), ("low", 5, 0.01, None, False), ("dpsi", 5, None, -0.3, False), ("still", 5, 0.5, 0.01, True), ("none", 5, None, None, False), ("constitutive", 5, None, None, True), ("unread", 0, 0.5, 0.5, True)]
    e = spark.createDataFrame(rows, "name string, max_reads int, max_psi double, max_dpsi double, is_constitutive boolean")
    of = lambda df, **k: {r.name for r in M.decomplexified(df, **k).collect()}
    assert of(e, dpsi=0.1) == {"psi", "dpsi", "constitutive"}
    assert of(e, dpsi=0.1, keep=True) == {"psi", "dpsi", "constitutive", "none"}
    assert of(e.drop("is_constitutive"), reads=0) == {"psi", "dpsi", "still", "unread"}


def test_events_that_do_not_change(spark):
    schema = "event string, comparison string, lsv_id string, junction int, dpsi double, median_reads int"
    rows = [("a", "x", "s", 0, 0.01, 3), ("a", "y", "s", 0, 0.02, 3), ("a", "x", "s", 1, 0.03, 2), ("a", "x", "t", 2, 0.0, None), ("b", "x", "s", 0, 0.01, 1), ("b", "y", "s", 0, 0.01, 1), ("c", "x", "s", 0, 0.5, 9), ("d", "x", "s", 0, None, 9)]
    e = spark.createDataFrame(rows, schema)
    of = lambda **k: {r.event: r.nonchanging for r in M.event_nonchanging(e, **k).collect()}
    assert of() == {"a": True, "b": True, "c": False, "d": False}
    assert of(least_reads=5) == {"a": True, "b": False, "c": False, "d": False}  # 3 + 2 at s; nothing is known of t
    assert of(least_reads=6)["a"] is False
    by = {r.event: (r.x, r.y) for r in M.event_nonchanging_by_comparison(e, ["x", "y"]).collect()}
    assert by == {"a": (True, True), "b": (True, True), "c": (False, None), "d": (None, None)}
