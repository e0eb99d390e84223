"""Stored tables, long-read files and unclassified events on hand-made rows."""

import json

import pytest

from splicespark.operators import event_rows, longread
from splicespark.sources import readers, stored


def test_splicegraph_of_named_genes(spark, tmp_path):
    rows = [(f"G{k}", 10 * k, 10 * k + 5) for k in range(50)]
    stored.write_splicegraph({"exons": spark.createDataFrame(rows, "gene_id string, start int, end int")}, str(tmp_path))
    assert sorted(tuple(x) for x in stored.read_splicegraph(spark, str(tmp_path), "exons").collect()) == sorted(rows)
    some = stored.read_splicegraph(spark, str(tmp_path), "exons", ["G3", "G41", "none"])
    assert sorted(tuple(x) for x in some.collect()) == [rows[3], rows[41]]
    assert "PartitionFilters: [isnotnull(slice" in some._jdf.queryExecution().toString() or "PartitionFilters: [slice" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        stored.write_splicegraph({"other": some}, str(tmp_path))


def test_quantifications_keep_their_metadata(spark, tmp_path):
    rows = [("A", "l1", 0, [0.5, 0.5]), ("B", "l1", 0, None)]
    stored.write_quantifications(spark.createDataFrame(rows, "grp string, lsv_id string, junc_idx int, bins array<double>"), f"{tmp_path}/q", metadata={"groups": ["A", "B"]})
    found, metadata = stored.read_quantifications(spark, f"{tmp_path}/q")
    assert sorted((x.grp, x.lsv_id, x.junc_idx, x.bins) for x in found.collect()) == rows and metadata == {"groups": ["A", "B"]}


def test_result_slices_come_together(spark, tmp_path):
    rows = [(f"G{k % 7}", "a;b", None if k % 5 == 0 else k) for k in range(40)]
    stored.write_result_slices(spark.createDataFrame(rows, "gene_id string, texts string, n int"), f"{tmp_path}/r", 4)
    key = lambda x: (x[0], x[2] or -1)
    assert sorted((tuple(x) for x in stored.recombined(spark, f"{tmp_path}/r", "gene_id string, texts string, n int").collect()), key=key) == sorted(rows, key=key)


def test_long_read_files(spark, tmp_path):
    at = 'chr1\tlr\t{}\t{}\t{}\t.\t+\t.\t{}'
    gtf = ["# made by hand", at.format("transcript", 1, 90, 'gene_id "G"; transcript_id "T";'), at.format("exon", 1, 20, 'gene_id "G"; transcript_id "T";'), at.format("exon", 50, 90, 'transcript_id "T"; gene_id "G"'), at.format("exon", 5, 9, 'gene_id "G"; transcript_id "U";'), at.format("exon", 5, 9, 'gene_name "G";'), "short line"]
    (tmp_path / "a.gtf").write_text("\n".join(gtf))
    (tmp_path / "a.tsv").write_text("isoform\treads\nT\t2.2\nU\t7\n")
    exons, counts = readers.read_long_reads(spark, f"{tmp_path}/a.gtf", f"{tmp_path}/a.tsv")
    assert sorted(tuple(x) for x in exons.collect()) == [("G", "T", 1, 20), ("G", "T", 50, 90), ("G", "U", 5, 9)]
    assert sorted(tuple(x) for x in counts.collect()) == [("T", 3), ("U", 7)]
    assert sorted(tuple(x) for x in longread.exon_counts(exons, counts).collect()) == [("G", 1, 20, 3), ("G", 50, 90, 3)]
    assert [tuple(x) for x in longread.junction_counts(exons, counts).collect()] == [("G", 20, 50, 3)]


EDGES = "gene_id string, module_idx int, strand string, src int, dst int, start int, end int, is_intron boolean"


def test_other_events_and_complexity(spark):
    j = lambda g, s, t: (g, 1, "+", s, t, 1000 * s + 300, 1000 * t + 100, False)
    cassette = [j("C", 0, 1), j("C", 1, 2), j("C", 0, 2)]
    # Two ways out of 0 that meet again at 3 by unlike numbers of exons, with no exon that ends a gene: nothing names them.
    other = [j("O", 0, 1), j("O", 1, 3), j("O", 0, 2), j("O", 2, 4), j("O", 4, 3)]
    edges = spark.createDataFrame(cassette + other, EDGES)
    others = {x.gene_id: (x.lsvs, x.junctions) for x in event_rows.other_events(edges).collect()}
    assert others == {"O": ("O:s:0;O:t:3", "1300-3100;2300-4100;300-1100;300-2100;4300-3100")}
    found = {x.gene_id: (x.total, x.is_complex) for x in event_rows.module_complexity(edges).collect()}
    assert found == {"C": (1, False), "O": (1, True)}


def test_counts_by_experiment(spark, tmp_path):
    rows = [(k % 3, f"c:+:{k}-{k + 9}", k % 2 == 0, k, k % 5) for k in range(30)]
    counts = spark.createDataFrame(rows, "experiment int, id string, is_intron boolean, reads long, npos long")
    stored.write_counts(counts, str(tmp_path / "c"), {"strandness": "none"})
    some = stored.read_counts(spark, str(tmp_path / "c"), [1])
    assert sorted((r.experiment, r.id) for r in some.collect()) == sorted((r[0], r[1]) for r in rows if r[0] == 1)
    assert "PartitionFilters: [" in (plan := some._jdf.queryExecution().toString()) and "experiment" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert stored.read_counts(spark, str(tmp_path / "c")).count() == 30


def test_result_files_with_headers(spark, tmp_path):
    rows = spark.createDataFrame([("a_b", "l2", "0.1;0.2"), ("a_b", "l1", None), ("c_d", "l#3", "0.5")], "comparison string, lsv_id string, dpsi string")
    path = str(tmp_path / "r")
    stored.write_result_files(rows, path, {"a_b": {"group_names": ["a", "b"], "n": 1}, "c_d": {"group_names": ["c", "d"], "n": 2}})
    found, heads = stored.read_result_files(spark, path)
    assert sorted(tuple(r) for r in found.select("comparison", "lsv_id", "dpsi").collect()) == [("a_b", "l1", None), ("a_b", "l2", "0.1;0.2"), ("c_d", "l#3", "0.5")]
    assert {r.comparison: json.loads(r.metadata)["group_names"] for r in heads.collect()} == {"a_b": ["a", "b"], "c_d": ["c", "d"]}
    file = next((tmp_path / "r" / "comparison=a_b").glob("part-*")).read_text().splitlines()
    assert file[0] == "# {" and file[file.index("lsv_id\tdpsi") - 1] == "# }" and file[-2:] == ["l1\tNA", "l2\t0.1;0.2"]
