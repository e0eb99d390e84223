"""Hand-made cases of the operators that SQL can't check, and of their edges."""

import pytest
from pyspark.sql import functions as F

from splicespark.functions import lsv as L
from splicespark.operators import evidence as E
from splicespark.operators import modules as M
from splicespark.operators import quant as Q
from splicespark.operators import stats as S
from splicespark.operators import structure as T
from splicespark.sources import readers

READS = "experiment int, read_id string, flag int, chrom string, pos int, cigar string, seq_len int"


def hits(spark, *reads, **options):
    rows = [(0, str(k), flag, "c", 100, cigar, 50) for k, (flag, cigar) in enumerate(reads)]
    return [tuple(x) for x in E.junction_hits(spark.createDataFrame(rows, READS), **options).orderBy("start", "offset").collect()]


def test_junction_hits(spark):
    assert hits(spark, (0, "10M50N10M")) == [(0, "c", ".", 110, 161, 2)]
    assert hits(spark, (0, "7M50N10M"), (0, "10M50N7M"), (256, "10M50N10M"), (4, "10M50N10M"), (0, "20M")) == []
    assert hits(spark, (0, "8M50N8M")) == [(0, "c", ".", 108, 159, 0)]
    assert hits(spark, (0, "3S10M50N10M4S")) == [(0, "c", ".", 110, 161, 5)]
    assert hits(spark, (0, "2H10M50N10M")) == [(0, "c", ".", 110, 161, 2)]
    assert hits(spark, (0, "5M2I5M3D50N10M")) == [(0, "c", ".", 113, 164, 4)]
    assert hits(spark, (0, "10M50N10M60N10M")) == [(0, "c", ".", 110, 161, 2), (0, "c", ".", 170, 231, 12)]


@pytest.mark.parametrize("flag,forward", [(0, "+"), (16, "-"), (64, "+"), (80, "-"), (128, "-"), (144, "+")])
def test_strands(spark, flag, forward):
    other = {"+": "-", "-": "+"}[forward]
    for protocol, strand in (("forward", forward), ("reverse", other), ("none", ".")):
        assert hits(spark, (flag, "10M50N10M"), protocol=protocol)[0][2] == strand


def test_lsv_ids(spark):
    df = spark.createDataFrame([("a:b:s:10-20",), ("g:t:na-7",), ("g:s:-1-7",)], "x string")
    start, end = L.reference_exon(F.col("x"))
    got = [tuple(r) for r in df.select(L.gene_of(F.col("x")), L.kind_of(F.col("x")), start, end).collect()]
    assert got == [("a:b", "s", 10, 20), ("g", "t", None, 7), ("g", "s", -1, 7)]


EDGES = "gene_id string, strand string, src int, dst int, start int, end int, is_intron boolean"


def edges(spark, strand, *rows):
    return M.with_modules(spark.createDataFrame([("g", strand, *r[:4], len(r) > 4) for r in rows], EDGES))


@pytest.mark.parametrize("strand", ["+", "-"])
def test_events(spark, strand):
    cassette = edges(spark, strand, (0, 1, 100, 200), (1, 2, 300, 400), (0, 2, 100, 400))
    assert [tuple(r)[2:5] for r in M.cassette(cassette).collect()] == [(0, 1, 2)]
    assert M.tandem_cassette(cassette).count() == M.mutually_exclusive(cassette).count() == 0
    tandem = edges(spark, strand, (0, 1, 100, 200), (1, 2, 300, 400), (2, 3, 500, 600), (0, 3, 100, 600))
    assert [r.exons for r in M.tandem_cassette(tandem).collect()] == [2] and M.multi_exon_spanning(tandem).first().nearest == 1
    exclusive = edges(spark, strand, (0, 1, 100, 200), (0, 2, 100, 400), (1, 3, 300, 600), (2, 3, 500, 600))
    assert [tuple(r)[2:] for r in M.mutually_exclusive(exclusive).collect()] == [(0, 1, 2, 3)]
    five = edges(spark, strand, (0, 1, 100, 200), (0, 1, 120, 200))
    assert [(r.kind, r.proximal_start) for r in M.alternative_sites(five).collect()] == [("alt5" if strand == "+" else "alt3", 120)]
    intron = edges(spark, strand, (0, 1, 100, 200), (0, 1, 101, 199, True))
    assert [r.spliced for r in M.alternative_introns(intron).collect()] == [1]
    putative = edges(spark, strand, (0, 1, 100, 200, True), (1, 2, 300, 400), (0, 2, 100, 400))
    assert [r.kind for r in M.putative_alternative_sites(putative).collect()] == ["p_alt5" if strand == "+" else "p_alt3"]
    ends = edges(spark, strand, (0, 1, 100, 200), (0, 2, 100, 400))
    assert [(r.kind, r.proximal_exon) for r in M.alternative_ends(ends).collect()] == [("last" if strand == "+" else "first", 1)]


def test_modules_are_numbered_from_the_5_end(spark):
    for strand, numbers in (("+", [1, 1, 1, 2, 2]), ("-", [2, 2, 2, 1, 1])):
        rows = edges(spark, strand, (0, 1, 1, 2), (0, 2, 1, 3), (1, 2, 2, 3), (2, 3, 4, 5), (2, 3, 4, 6))
        assert [r.module_idx for r in rows.orderBy("src", "dst", "end").collect()] == numbers


def test_paths_take_every_connection(spark):
    e = edges(spark, "+", (0, 1, 10, 20), (0, 1, 12, 20), (0, 1, 13, 19, True), (1, 2, 30, 40), (0, 2, 10, 40))
    found = sorted((r.path, r.junctions, r.length, r.frame) for r in M.paths(e).collect())
    assert found == [("0-1-2", "10-20,30-40", 3, 11 % 3), ("0-1-2", "12-20,30-40", 3, 11 % 3), ("0-1-2", "13-19i,30-40", 3, 12 % 3), ("0-2", "10-40", 2, 0)]
    assert M.paths(e.filter("src > 5")).count() == 0


def test_redundant_lsvs(spark):
    rows = [("g", "s1", "s", ["a", "b"]), ("g", "t1", "t", ["a", "b"]), ("g", "t2", "t", ["a", "b", "c"]), ("h", "s2", "s", ["a", "b"])]
    lsvs = spark.createDataFrame(rows, "gene_id string, lsv_id string, kind string, connections array<string>")
    assert sorted(r.lsv_id for r in T.without_redundant(lsvs).collect()) == ["s2", "t2"]
    assert sorted(r.lsv_id for r in T.without_redundant(lsvs, strict=False).collect()) == ["s1", "s2", "t2"]


def test_bootstrap_and_samples_dont_depend_on_partitions(spark):
    rows = [(k, [1, 2, 3, 2, 5, k]) for k in range(40)] + [(100, []), (101, [4]), (102, [3, 3, 3]), (103, [1] * 30 + [500])]
    df = spark.createDataFrame(rows, "k int, counts array<int>")
    a = {r.k: list(r.boots) for r in Q.bootstrap(df.repartition(1), ["k"]).collect()}
    b = {r.k: list(r.boots) for r in Q.bootstrap(df.repartition(7), ["k"]).collect()}
    got = {r.k: (r.reads, r.npos) for r in Q.bootstrap(df, ["k"]).collect()}
    assert a == b and a[100] == [0.0] * 30
    assert got[103] == (30, 30) and got[100] == (0, 0) and got[10] == (23, 6)
    assert sum(a[10]) / 30 == pytest.approx(23, rel=0.4)


@pytest.mark.parametrize("stack", [9_000, 1_000_000])
def test_a_stack_of_reads_goes_alone(spark, stack):
    df = spark.createDataFrame([(0, [3, 4, 5, 6, stack]), (1, [1000, 1100, 990, 1010]), (2, [stack]), (3, [2, 3, 2, 1, 700, 800])], "k int, counts array<int>")
    got = {r.k: (r.reads, r.npos) for r in Q.bootstrap(df, ["k"]).collect()}
    # 800 and 700 are each judged by the mean of all others, stacks too: 800 is above 141.6, 700 above 161.6.
    assert got == {0: (18, 4), 1: (4100, 4), 2: (0, 0), 3: (8, 4)}


def test_bootstrap_moments(spark):
    df = spark.createDataFrame([(0, [2, 9, 4, 30, 1, 8, 12])], "k int, counts array<int>")
    boots = Q.bootstrap(df, ["k"], replicates=4000, limit=0).first().boots
    n, values = 7, [2, 9, 4, 30, 1, 8, 12]
    mean, var = sum(values) / n, sum(v * v for v in values) / n - (sum(values) / n) ** 2
    found = sum(boots) / len(boots)
    assert found == pytest.approx(mean * n, rel=0.03)
    assert sum((b - found) ** 2 for b in boots) / len(boots) == pytest.approx(var * (n - 1) * (n / (n - 1)) ** 2, rel=0.1)


JUNCTIONS = "chrom string, strand string, start int, end int"


def test_stages_of_junction_genes(spark):
    genes = spark.createDataFrame([("a", "c", "+", 20_000, 30_000), ("b", "c", "-", 20_000, 30_000)], "gene_id string, chrom string, strand string, start int, end int")
    exons = spark.createDataFrame([("a", 20_000, 20_100), ("a", 29_000, 30_000), ("b", -1, 25_000)], "gene_id string, start int, end int")
    known = spark.createDataFrame([("a", 22_000, 23_000)], "gene_id string, start int, end int")
    rows = [("c", ".", 22_000, 23_000), ("c", "-", 22_000, 23_000), ("c", ".", 20_200, 28_700), ("c", "+", 21_000, 22_500), ("c", "+", 15_000, 20_050), ("c", "+", 15_000, 22_000), ("c", "-", 15_000, 20_050), ("c", "+", 15_000, 35_000), ("c", "+", 5_000, 20_050), ("d", "+", 21_000, 22_500)]
    run = lambda **k: sorted(tuple(r)[1:] for r in E.junction_genes(spark.createDataFrame(rows, JUNCTIONS), genes, exons, known, **k).collect())
    expected = [("+", 15_000, 20_050, "a", 3), ("+", 21_000, 22_500, "a", 3), ("-", 22_000, 23_000, "b", 3), (".", 20_200, 28_700, "a", 2), (".", 22_000, 23_000, "a", 1)]
    assert run() == expected
    assert run(full_intergene=True) == sorted([*expected, ("+", 15_000, 22_000, "a", 3), ("-", 15_000, 20_050, "b", 3)])


def test_statistics_of_empty_groups(spark):
    psi = spark.createDataFrame([("A", 0, "l", 0, 0.5), ("A", 1, "l", 0, 0.5)], "grp string, experiment int, lsv_id string, junc_idx int, psi double")
    assert tuple(S.welch(psi).first())[2:] == (None, None)
    assert S.mann_whitney(psi).first().u == 0 and S.tnom(psi).first().score == 0


def test_readers(spark, tmp_path):
    gff = "##gff\nchr1\t.\tgene\t1\t90\t.\t+\t.\tID=g%201;Name=n;x=1;x=2\nchr1\t.\tmRNA\t1\t90\t.\t+\t.\tID=t;Parent=g%201\nchr1\t.\texon\t1\t20\t.\t+\t.\tParent=t\nchr1\t.\texon\t30\t90\t.\t+\t.\tParent=t,nowhere\nbroken\n"
    path = tmp_path / "a.gff3"
    path.write_text(gff)
    parsed = readers.read_gff(spark, str(path))
    assert parsed.count() == 4 and parsed.first().attributes["x"] == "1,2"
    genes, exons = readers.annotation(parsed)
    assert [tuple(r) for r in genes.collect()] == [("g 1", "n", "chr1", "+", 1, 90)]
    assert sorted((r.start, r.end) for r in exons.collect()) == [(1, 20), (30, 90)]
    assert T.transcript_junctions(exons).filter("start = 20 and end = 30").count() == 1
    twice = spark.createDataFrame([(line,) for line in [gff.split("\n")[1]] * 2], "value string")
    with pytest.raises(Exception, match="used twice"):
        readers.annotation(readers.parsed_gff(twice))[0].collect()
    rows = spark.createDataFrame([("l", "0.1;0.2")], "lsv_id string, dpsi string")
    readers.write_results(rows, str(tmp_path / "res" / "a_b.tsv"), {"v": 1})
    assert readers.read_results(spark, str(tmp_path / "res" / "a_b.tsv")).count() == 1
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\n" + "\t".join(["r", "0", "c", "101", "60", "10M50N10M", "*", "0", "0", "A" * 20, "*"]) + "\n")
    assert hits(spark, (0, "10M50N10M")) == [tuple(r) for r in E.junction_hits(readers.read_sam(spark, str(sam), "e").withColumn("experiment", F.lit(0))).collect()]
