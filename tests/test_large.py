"""What keeps jobs small on large tables: what is shuffled, and steps in one pass against the same by joins."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from splicespark.functions import kernels as K
from splicespark.operators import compare as C
from splicespark.operators import evidence as E
from splicespark.operators import placing as P
from splicespark.operators import quant as Q
from splicespark.operators import stats as S
from splicespark.operators import structure as T
from splicespark.plans import build
from splicespark.sources import driver_views as V
from splicespark.sources import readers, stored

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan_of(df))


@pytest.mark.parametrize("name", ["positional_counts", "welch_statistic", "psi_of_groups", "delta_psi", "sampled_histograms", "heterogen_classes", "bootstrap_replicates"])
def test_reads_are_not_shuffled(spark, name):
    keys = exchanges(entry.queries()[name](spark, SF))
    assert keys and not any(re.search(r"\b(position|bin)#", k) for k in keys)


def test_passing_in_one_pass_is_the_same(spark):
    rows = [(g, e, lsv, j, r, n) for g, e in (("A", 0), ("A", 1), ("B", 4), ("B", 5)) for lsv in "xyz" for j, r, n in ((0, 3 * e + 8, 4), (1, 12 if lsv == "x" else 1, 3 if e != 1 else 2))]
    summed = spark.createDataFrame(rows, "grp string, experiment int, lsv_id string, junc_idx int, reads long, npos long")
    groups = summed.select("grp", "experiment").distinct()
    assert sorted(Q.in_passing(summed).collect()) == sorted(summed.join(Q.passing_lsvs(summed), ["grp", "experiment", "lsv_id"], "left_semi").select(summed.columns).collect())
    for value in (0.5, 1.0, 2):
        good = Q.quantifiable(summed, value)
        assert sorted(Q.in_quantifiable(summed, groups, value).select(summed.columns).collect()) == sorted(summed.join(good, ["grp", "lsv_id"], "left_semi").select(summed.columns).collect())
        assert sorted(good.collect()) == sorted(Q.quantifiable(summed, value, groups=groups).collect())


@pytest.mark.parametrize("name", ["junction_genes", "junction_gene_distances"])
def test_no_bin_of_genes_is_one_array(spark, name):
    assert "genes#" not in plan_of(entry.queries()[name](spark, SF))


def test_gene_exons_outside_the_gene_count(spark):
    genes = spark.createDataFrame([("a", "c", "+", 20_000, 21_000), ("b", "c", "+", 20_000, 21_000), ("m", "c", "-", 500, 900)], "gene_id string, chrom string, strand string, start int, end int")
    exons = spark.createDataFrame([("a", 16_000, 16_500), ("a", 20_500, 20_900), ("b", 20_500, 20_900)], "gene_id string, start int, end int")
    none = spark.createDataFrame([], "gene_id string, start int, end int")
    rows = spark.createDataFrame([("c", "+", 16_400, 20_200), ("c", ".", 20_100, 20_950), ("c", "+", 100, 200)], "chrom string, strand string, start int, end int")
    found = sorted(tuple(r)[2:] for r in E.junction_genes(rows, genes, exons, none).collect())
    assert found == [(16_400, 20_200, "a", 2), (20_100, 20_950, "a", 3), (20_100, 20_950, "b", 3)]


def test_gene_overlaps_shuffle_no_pairs(spark):
    rows = [("a", "c", 1, 5000), ("b", "c", 4000, 4100), ("b", "d", 10, 20), ("e", "d", 20, 3000), ("f", "c", 5001, 5002), ("b", "c", 4500, 4600)]
    genes = spark.createDataFrame(rows, "gene_id string, chrom string, start int, end int")
    assert sorted(map(tuple, T.gene_overlaps(genes).collect())) == [("a", "b"), ("b", "e")]
    single = T.gene_overlaps(genes.limit(2).unionByName(genes.filter("gene_id = 'f'")))
    assert sorted(map(tuple, single.collect())) == [("a", "b")]
    assert sum("gene_id_1" in k and "gene_id_2" in k for k in exchanges(T.gene_overlaps(genes))) == 1


def test_reads_of_introns_counts_a_read_once(spark):
    rows = [("r", 0, "20M"), ("r", 5, "20M"), ("s", 5, "20M"), ("t", 5, "5M50N15M"), ("u", 300, "20M")]
    reads = spark.createDataFrame([(1, name, 0, "c", pos, cigar, 20) for name, pos, cigar in rows], "experiment int, read_id string, flag int, chrom string, pos int, cigar string, seq_len int")
    introns = spark.createDataFrame([("a", "c", "+", 10, 200), ("b", "c", "+", 10, 200), ("z", "c", "-", 12, 40)], "gene_id string, chrom string, strand string, start int, end int")
    spans = E.intron_spans(reads)
    found = E.reads_of_introns(spans, introns)
    assert sorted(found.select("gene_id", "start", "end", "experiment", "reads").collect()) == sorted(E.intron_reads(E.intron_hits(spans, introns)).collect())
    assert {(r.gene_id, r.reads) for r in found.collect()} == {("a", 2), ("b", 2), ("z", 2)}


def test_quantifications_are_few_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("if(id % 2 = 0, 'A', 'B') AS grp", "id").repartition(40, "id")
    stored.write_quantifications(rows, str(tmp_path / "q"))
    assert len(list((tmp_path / "q").rglob("*.parquet"))) <= 8
    assert stored.read_quantifications(spark, str(tmp_path / "q"))[0].count() == 400


@pytest.mark.parametrize("name", ["gff_exons", "gff_genes"])
def test_gff_attributes_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Filter ", line)]
    assert filters and not any("map_from_arrays" in line for line in filters)


def test_gff_attributes(spark):
    texts = ["ID=a;Name=x%20y+z;tag=1;tag=2%2C3", "Parent=p=q; ID = b;none;=v", "k%3D=%zz;K=", "."]
    lines = spark.createDataFrame([("\t".join(["c%201", ".", "gene", "1", "x", ".", "+", ".", t]),) for t in texts] + [("#c",), ("a\tb",)], "value string")
    found = [(r.seqid, r.start, r.end, r.attributes) for r in readers.parsed_gff(lines).collect()]
    maps = [{"ID": "a", "Name": "x y+z", "tag": "1,2,3"}, {"Parent": "p=q", "ID": " b", "": "v"}, {"k=": "", "K": ""}, None]
    assert found == [("c 1", 1, None, m) for m in maps]


@pytest.mark.parametrize("name", ["sample_histogram", "info_score", "both_group_lsvs", "best_set_psi", "stored_lsv_coverage", "psi_posterior"])
def test_summaries_have_no_row_for_each_read(spark, name):
    query = entry.queries()[name]
    if name == "stored_lsv_coverage":
        query = build.summary_of
    plan = plan_of(query(spark, SF))
    assert "positions#" in plan and not re.search(r"Generate explode\(sequence", plan)


def test_summary_of_bundles(spark):
    rows = [("a", [1, 6, 11]), ("a", [1, 6, 11]), ("a", [49, None]), ("b", [7]), ("c", [])]
    bundles = spark.createDataFrame(rows, "k string, positions array<int>")
    each = bundles.selectExpr("k", "explode(positions) AS position")
    old = Q.folded(E.positional_counts(each, ["k"], "position"), ["k"])
    new = E.summary_of_bundles(bundles, ["k"], folds=5).select(old.columns)
    assert sorted(map(tuple, new.filter("k <> 'c'").collect())) == sorted(map(tuple, old.collect()))
    assert tuple(new.filter("k = 'c'").first()) == ("c", 0, 0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("name", ["read_hits", "summary"])
def test_bundles_are_the_reads(spark, name):
    hits = V.read_hits(spark, SF)
    if name == "read_hits":
        each = V.read_bundles(spark, SF).selectExpr("experiment", "lsv_id", "junc_idx", "explode(positions) AS position")
        assert not each.exceptAll(hits.select(each.columns)).count() and each.count() == hits.count()
    else:
        keys = ["experiment", "lsv_id", "junc_idx"]
        old = E.summary(E.positional_counts(hits, keys, "position"), keys)
        assert sorted(map(tuple, build.summary_of(spark, SF).select(old.columns).collect())) == sorted(map(tuple, old.collect()))


def test_equal_stacks_and_posteriors_are_worked_out_once(spark, monkeypatch):
    tried = []
    inner = K.poisson_above
    monkeypatch.setattr(K, "poisson_above", lambda k, mean: tried.append(len(k)) or inner(k, mean))
    v, begin, n = Q.without_stacks(pa.array([[2, 0, 1, 900], [1, 2, 900], [], [900, 800], [0]]), 1e-7)
    assert [v[b : b + k].tolist() for b, k in zip(begin, n)] == [[1, 2], [1, 2], [], [800, 900], []] and tried == [5]
    cdf = K.beta_cdf
    monkeypatch.setattr(K, "beta_cdf", lambda x, a, b: tried.append(len(a)) or cdf(x, a, b))
    a, b = np.array([[1.5, 2.0], [2.0, 1.5]]), np.array([[3.0, 4.0], [4.0, 3.0]])
    h = Q.psi_masses(a, b, 40)
    assert tried[1:] == [2] and (h[0, 0] == h[1, 1]).all() and (h[0, 1] == h[1, 0]).all() and abs(h[0, 0] - np.diff(cdf(np.linspace(0, 1, 41), 1.5, 3.0))).max() < 1e-12


@pytest.mark.parametrize("name", ["best_set_psi", "median_dpsi", "both_group_lsvs", "welch_statistic"])
def test_lsvs_are_numbers_and_places_are_bits(spark, name):
    df = entry.queries()[name](spark, SF)
    keys = [k for k in exchanges(df) if "lsv_id#" in k]
    assert keys and all(re.search(r"\blsv_id#\d+L", k) for k in keys)
    assert not re.search(r"collect_set\(positions", plan_of(df))


@pytest.mark.parametrize("numbers", [True, False])
def test_places_as_bits_are_the_reads(spark, tmp_path, numbers):
    odd = [None, -3.0, -60.0, 0.0, 1.0, 49.0, 50.0, 51.0, 1e6 + 7]
    rows = [(o, 8 * gene + 5, s, n, q) for gene in (0, 1, 7, 15, 16, 31) for k, q in enumerate(odd) for o, s, n in ((k % 2, 0, 1), (k % 3, k % 3, 2), (6, 5, 1))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    keys = ["experiment", "lsv_id", "junc_idx"]
    found = E.summary_of_masks(V.read_masks(spark, str(tmp_path), numbers), keys, folds=5)
    found = V.named(found).select("experiment", "lsv_id", "junc_idx", *found.columns[3:]) if numbers else found
    bundles = E.summary_of_bundles(V.read_bundles(spark, str(tmp_path)), keys, folds=5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bundles.select(found.columns).collect()))
    hits = E.summary(E.positional_counts(V.read_hits(spark, str(tmp_path)), keys, "position"), keys)
    assert sorted(map(tuple, found.select(hits.columns).collect())) == sorted(map(tuple, hits.collect()))


@pytest.mark.parametrize("name", ["median_dpsi", "heterogen_index"])
def test_summary_of_groups_is_worked_out_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert plan.count("FileScan") == 1 and "Join" not in plan and "percentile" not in plan


def test_samples_in_one_pass_are_the_same(spark):
    rows = [(g, e, lsv, j, 5 * e + 6 * j, 2 + j) for g, e in (("A", 0), ("A", 1), ("B", 4), ("B", 5)) for lsv in "xyz" for j in range(4) if (e + j + ord(lsv)) % 3 and (lsv != "z" or e > 0)]
    summed = spark.createDataFrame(rows, "grp string, experiment int, lsv_id string, junc_idx int, reads long, npos long")
    connections = summed.select("lsv_id", "junc_idx", F.lit(False).alias("is_intron"))
    every = Q.dense(Q.in_passing(summed), connections, ["grp", "experiment"], "reads")
    expected = sorted((r.grp, r.experiment, r.lsv_id, c.junc_idx, (c.reads + 1 / len(r.connections)) / (sum(x.reads for x in r.connections) + 1)) for r in every.collect() for c in r.connections)
    found = Q.samples_of(summed)
    assert sorted(map(tuple, found.select("grp", "experiment", "lsv_id", "junc_idx", "psi").collect())) == expected
    assert len(expected) > len({r[:4] for r in expected} & {r[:4] for r in rows}) > 0


def test_group_summary_and_heat_map_are_the_same(spark):
    values = {("x", 0, "A"): [0.1, None, 0.7, 0.4], ("x", 0, "B"): [0.25, 0.25], ("x", 0, "C"): [0.9], ("x", 1, "A"): [None], ("x", 1, "C"): [0.3, 0.2, 0.2, 0.8, 0.55], ("y", 0, "B"): [0.5]}
    psi = spark.createDataFrame([(*k, v) for k, vs in values.items() for v in vs], "lsv_id string, junc_idx int, grp string, psi double")
    new = S.group_summary(psi).collect()
    old = psi.groupBy("lsv_id", "junc_idx", "grp").agg(F.count("psi").alias("n"), F.median("psi").alias("median_psi"), F.percentile("psi", F.lit(0.25)).alias("q25"), F.percentile("psi", F.lit(0.75)).alias("q75"))
    old = old.withColumn("iqr", F.col("q75") - F.col("q25"))
    assert sorted(map(str, new)) == sorted(map(str, old.select(new[0].__fields__).collect()))
    one, two = old.selectExpr("lsv_id", "junc_idx", "grp AS g1", "median_psi AS m1"), old.selectExpr("lsv_id", "junc_idx", "grp AS g2", "median_psi AS m2")
    pairs = one.join(two, ["lsv_id", "junc_idx"]).filter("g1 < g2").selectExpr("lsv_id", "junc_idx", "g1", "g2", "m2 - m1 AS dpsi").collect()
    assert len(pairs) == 4 and sorted(map(str, S.group_heat_map(S.group_summary(psi)).collect())) == sorted(map(str, pairs))
    index = {r.lsv_id: (r.max_abs_dpsi, r.min_quantified) for r in S.heterogen_index(S.group_summary(psi)).collect()}
    assert index == {"x": (max(abs(r.dpsi) for r in pairs if r.dpsi is not None), 0), "y": (None, 1)}


@pytest.mark.parametrize("name", ["junction_genes", "junction_gene_distances", "alignment_lsv_coverage"])
def test_pairs_of_junctions_and_genes_are_not_shuffled(spark, name):
    keys = exchanges(entry.queries()[name](spark, SF))
    assert keys and not any("gene_id#" in k and ("start#" in k or "end#" in k) for k in keys)


def test_placing_has_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 50)
    rng = np.random.default_rng(5)
    genes = [(f"g{k}", "c" if k % 3 else "d", "+-"[k % 2], s, s + n) for k, (s, n) in enumerate(zip(rng.integers(0, 20_000, 60).tolist(), rng.choice([40, 900, 6000], 60).tolist()))]
    genes.append(("same", *genes[1][1:]))
    exons = [(g, x, x + 150) for g, _, _, s, e in genes if g != "g7" for x in (s, (s + e) // 2, e - 150)] + [("g9", 0, 30), ("g1", -1, 500)]
    exons += [("same", *x[1:]) for x in exons if x[0] == "g1"]
    rows = [("c" if k % 4 else "d", "+-."[k % 3], s, s + n) for k, (s, n) in enumerate(zip((rng.integers(0, 60, 300) * 400).tolist(), rng.choice([-20, 60, 200, 950, 1000, 1001, 2500, 9000], 300).tolist()))]
    marked = lambda s, e, a, b: (s % 3 == 0) & (a <= s) & (s <= b)
    full = lambda g: [(s, e) for n, s, e in exons if n == g and s >= 0 and e >= 0]
    for rule in (P.Rule(), P.Rule(3000, 100, True), P.Rule(annotated=marked)):
        right = set()
        for chrom, strand, s, e in set(rows):
            found = {}
            for g, c, t, a, b in genes:
                if c != chrom or strand not in (".", t) or s < a - rule.reach or e > b + rule.reach or (s < a and e > b):
                    continue
                touches = any(x <= s <= y or x <= e <= y for x, y in full(g))
                if rule.annotated and marked(s, e, a, b):
                    found[g] = 1
                elif rule.full_intergene or (s >= a and e <= b) or touches:
                    near = any(x < s <= y + rule.near for x, y in full(g)) and any(x - rule.near <= e < y for x, y in full(g))
                    found[g] = 2 if near else 3
            right |= {(chrom, strand, s, e, g, x) for g, x in found.items() if x == min(found.values())}
        frames = (spark.createDataFrame(rows, "chrom string, strand string, start int, end int").distinct(), spark.createDataFrame(genes, "gene_id string, chrom string, strand string, start int, end int"), spark.createDataFrame(exons, "gene_id string, start int, end int"))
        got = [tuple(r) for r in P.genes_of_junctions(*frames, rule).collect()]
        assert len(got) == len(set(got)) and set(got) == right and {x[-1] for x in right} >= {3}
        far = {}
        for _, _, s, e, g, _ in right:
            a, b = next((a, b) for n, _, _, a, b in genes if n == g)
            key = (g, max(0, a - s, e - b))
            far[key] = far.get(key, 0) + 1
        assert {(r.gene_id, r.distance): r.junctions for r in P.gene_distances(*frames, rule).collect()} == far


@pytest.mark.parametrize("name", ["cassette_groups", "exon_constrained_lsvs"])
def test_connections_are_shuffled_once_by_gene(spark, name):
    keys = exchanges(entry.queries()[name](spark, SF))
    assert len(keys) == 1 and keys[0].startswith("gene_id#")


def test_merged_exons_hold_their_ends(spark):
    rows = [(g, g * 10 + k % 3, k, s, s + n) for g in (1, 2) for k, (s, n) in enumerate([(100, 50), (115, 300), (400, 10), (430, 900), (2000, 30), (2021, 5)])]
    c = spark.createDataFrame([*rows, (2, 29, 7, None, 50)], "gene_id long, lsv_id long, junc_idx int, start int, end int")
    ends = c.selectExpr("gene_id", "start - 20 AS start", "start AS end").unionByName(c.selectExpr("gene_id", "end AS start", "end + 20 AS end")).dropna()
    right = C.touched_exons(c, T.merged_exons(ends))
    got = C.touched_rows(C.touched_merged(c)).select(right.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, right.collect())) and got.count() == 25


def test_means_are_those_of_the_posteriors(spark):
    keys = ["experiment", "lsv_id", "junc_idx"]
    summed = build.summary_of(spark, SF, folds=5)
    old = Q.mean_psi(Q.dense(Q.boots_of_folds(Q.in_passing(summed), keys), summed.withColumn("is_intron", F.lit(False)), ["experiment"]), ["experiment"])
    right = {tuple(r)[:3]: r.mean_psi for r in old.collect()}
    got = {(r.experiment, r.lsv_id, r.junc_idx): r.psi for r in Q.mean_samples_of(summed).collect()}
    assert got.keys() == right.keys() and max(abs(got[k] - right[k]) for k in right) < 1e-12


def test_connections_are_tested_at_once(spark, monkeypatch):
    rows = [(g, e, lsv, 0, [0.1 * e + lsv / 7 * (g == "A"), 0.3 + e / 9]) for lsv in range(6) for g, e in (("A", 0), ("A", 1), ("A", 2), ("B", 3), ("B", 4)) if lsv != 5 or g == "A"]
    samples = spark.createDataFrame(rows, "grp string, experiment int, lsv_id long, junc_idx int, psi array<double>")
    found = {(r.lsv_id, r.stat): tuple(r)[3:] for r in S.tests_of_samples(samples, ["ALL"]).collect()}
    assert len(found) == 24
    for lsv in range(6):
        one = S.tests_of_samples(samples.filter(F.col("lsv_id") == lsv), ["ALL"]).collect()
        assert all(tuple(r)[3:] == pytest.approx(found[lsv, r.stat], abs=1e-12) for r in one) and len(one) == 4
    plan = plan_of(entry.queries()["heterogen_mean_tests"](spark, SF))
    assert "shares#" not in plan and plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_genes_of_one_start_are_met_as_lists(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{k}", "cd"[k % 2], s, s + n) for k, (s, n) in enumerate(zip((rng.integers(0, 12, 40) * 300).tolist(), rng.choice([0, 299, 300, 2500], 40).tolist()))] + [("g3", "c", 5000, 5100), ("x", "d", 5050, 5000), ("y", "d", 4900, 5060)]
    genes = spark.createDataFrame(rows, "gene_id string, chrom string, start int, end int")
    right = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows[:-2] for b in rows[:-2] if a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    for most in (1, 3, 1000):
        got = [tuple(r) for r in T.gene_overlaps(genes.filter("gene_id not in ('x', 'y')"), most).collect()]
        assert len(got) == len(set(got)) and set(got) == right
    assert "ids#" in plan_of(T.gene_overlaps(genes))
