"""Registered queries on stored tables, long-read files, unclassified events and tested classes, with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import event_rows as R
from ..operators import evidence as E
from ..operators import longread as L
from ..operators import stats as T
from ..operators import structure as S
from ..operators.tables import shared_folder
from ..sources import driver_views as V
from ..sources import readers, stored
from .build import CIGAR_SQL, MERGED_SQL, WITH_SUMMARY, summary_of
from .compare import LISTED, NAMES, QUANT_SQL, quant_of
from .modules import EDGES_SQL, ENDS_WITH, EVENT_SQL, edges_of
from .quant import FOLDS_SQL, SUMMARY_SQL, psi_of_groups, rounded, sample_psi
from .summarize import LONG_SQL, TX_SQL, inner_junctions, transcript_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored/{uuid.uuid4().hex}"


@query(f"""{TX_SQL} SELECT 'genes' AS name, gene_id, min("start") AS "start", max("end") AS "end" FROM merged GROUP BY gene_id UNION ALL SELECT 'exons', gene_id, "start", "end" FROM merged
  UNION ALL SELECT 'junctions', gene_id, "start", "end" FROM tj UNION ALL SELECT 'introns', gene_id, "start", "end" FROM gaps WHERE "start" <= "end" + 1""")
def stored_splicegraph(spark, sf_dir):
    """The tables of a splicegraph, written and read again."""
    exons = S.merged_exons(V.transcript_exons(spark, sf_dir))
    tables = {"genes": exons.groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end")), "exons": exons, "junctions": inner_junctions(spark, sf_dir), "introns": S.potential_introns(exons)}
    path = folder(spark)
    stored.write_splicegraph(tables, path)
    read = lambda name: stored.read_splicegraph(spark, path, name).select(F.lit(name).alias("name"), "gene_id", "start", "end")
    return read("genes").unionByName(read("exons")).unionByName(read("junctions")).unionByName(read("introns"))


@query(f"{FOLDS_SQL} SELECT grp, lsv_id, junc_idx, round(median((x + 1.0 / n) / (total + 1.0)), 6) AS mean_psi FROM n GROUP BY ALL")
def stored_quantifications(spark, sf_dir):
    """Quantified connections, written by group with the run's metadata and read again."""
    path = folder(spark)
    stored.write_quantifications(psi_of_groups(spark, sf_dir), path, metadata={"analysis": "psi", "groups": ["A", "B"]})
    return stored.read_quantifications(spark, path)[0].select("grp", "lsv_id", "junc_idx", "mean_psi")


@query(f"""{MERGED_SQL} SELECT gene_id, "start", "end" FROM merged""")
def recombined_slices(spark, sf_dir):
    """A result table split by gene and put together again."""
    path = folder(spark)
    stored.write_result_slices(S.merged_exons(V.transcript_exons(spark, sf_dir)), path)
    return stored.recombined(spark, path, "gene_id string, start int, end int")


def long_read_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """GTF and count lines of the transcripts, as a long-read tool writes them."""
    e = V.transcript_exons(spark, sf_dir)
    line = lambda kind, s, t: F.concat_ws("\t", F.lit("chr1"), F.lit("lr"), F.lit(kind), s.cast("string"), t.cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";'))).alias("value")
    whole = e.groupBy("gene_id", "transcript_id").agg(F.min("start").alias("s"), F.max("end").alias("t")).select(line("transcript", F.col("s"), F.col("t")))
    counts = transcript_counts(spark, sf_dir).select(F.concat_ws("\t", "transcript_id", F.col("count").cast("string")).alias("value"))
    return whole.unionByName(e.select(line("exon", F.col("start"), F.col("end")))), counts


@query(f"""{LONG_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY gene_id, transcript_id) AS n FROM transcript_exons) SELECT gene_id, w."start", w."end", CAST(sum(ceil(c)) AS BIGINT) AS reads FROM w JOIN cnt USING (transcript_id) WHERE n >= 2 GROUP BY ALL""")
def long_read_exon_counts(spark, sf_dir):
    """Reads of the exons in a long-read tool's GTF and count files."""
    path = folder(spark)
    for name, lines in zip(("gtf", "counts"), long_read_lines(spark, sf_dir)):
        lines.write.text(f"{path}/{name}")
    return L.exon_counts(*readers.read_long_reads(spark, f"{path}/gtf", f"{path}/counts"))


OTHERS_SQL = f"""{EDGES_SQL}{ENDS_WITH}, used AS ({" UNION ALL ".join(f"SELECT gene_id, module_idx, '{k}' AS k, event, r.side AS side, r.exon AS exon, r.s AS s, r.e AS t FROM (SELECT *, unnest(rows) AS r FROM ({EVENT_SQL[k]}))" for k in R.TYPES if k != "constitutive")}),
  mkd AS (SELECT DISTINCT u.* FROM used u WHERE s IS NOT NULL), lv AS (SELECT gene_id, 's' AS side, src AS exon, min(module_idx) AS module_idx FROM e GROUP BY gene_id, src HAVING count(*) > 1 UNION ALL SELECT gene_id, 't', dst, min(module_idx) FROM e GROUP BY gene_id, dst HAVING count(*) > 1),
  ul AS (SELECT gene_id, module_idx, string_agg(lsv, ';' ORDER BY lsv) AS lsvs FROM (SELECT gene_id, module_idx, gene_id || ':' || side || ':' || exon AS lsv FROM lv WHERE NOT EXISTS (SELECT 1 FROM mkd u WHERE u.gene_id = lv.gene_id AND u.side = lv.side AND u.exon = lv.exon)) GROUP BY ALL),
  ue AS (SELECT gene_id, module_idx, string_agg(x, ';' ORDER BY x) AS junctions FROM (SELECT DISTINCT gene_id, module_idx, "start" || '-' || "end" AS x FROM e WHERE NOT EXISTS (SELECT 1 FROM mkd u WHERE u.gene_id = e.gene_id AND u.s = e."start" AND u.t = e."end")) GROUP BY ALL),
  o AS (SELECT gene_id, module_idx, lsvs, coalesce(junctions, '') AS junctions FROM ul LEFT JOIN ue USING (gene_id, module_idx))"""


@query(f"{OTHERS_SQL} SELECT * FROM o")
def other_events(spark, sf_dir):
    return R.other_events(edges_of(spark, sf_dir))


@query(
    f"""{OTHERS_SQL}, ev AS (SELECT DISTINCT gene_id, module_idx, k, event FROM mkd), c AS (SELECT gene_id, module_idx, count(*) AS n, count(*) FILTER (k = 'multi_exon_spanning') AS sp, count(*) FILTER (k = 'tandem_cassette') AS tc, count(*) FILTER (k = 'alternative_intron') AS ai, count(*) FILTER (k = 'p_alt3') AS p3, count(*) FILTER (k = 'p_alt5') AS p5 FROM ev GROUP BY ALL)
    SELECT a.gene_id, a.module_idx, coalesce(n, 0) + CASE WHEN lsvs IS NULL THEN 0 ELSE 1 END AS total, (coalesce(n, 0) > 1 AND NOT (n = 2 AND ((sp = 1 AND tc = 1) OR (ai = 1 AND (p3 = 1 OR p5 = 1))))) OR coalesce(junctions, '') <> '' AS is_complex
    FROM (SELECT DISTINCT gene_id, module_idx FROM e) a LEFT JOIN c USING (gene_id, module_idx) LEFT JOIN o USING (gene_id, module_idx)"""
)
def module_complexity(spark, sf_dir):
    return R.module_complexity(edges_of(spark, sf_dir))


@query(
    f"""{SUMMARY_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY lsv_id, junc_idx ORDER BY psi) + (count(*) OVER (PARTITION BY lsv_id, junc_idx, psi) - 1) / 2.0 AS r FROM samples),
    u AS (SELECT lsv_id, junc_idx, count(*) FILTER (grp = 'A') AS n1, count(*) FILTER (grp = 'B') AS n2, sum(r) FILTER (grp = 'A') - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0 AS u FROM r GROUP BY ALL HAVING n1 > 0 AND n2 > 0),
    orders AS (SELECT n.n AS n, m.m AS m, k.k AS k FROM (SELECT unnest(range(1, 5)) AS n) n, (SELECT unnest(range(1, 5)) AS m) m, (SELECT unnest(range(256)) AS k) k WHERE k.k < (1 << (n.n + m.m)::INT) AND bit_count(k.k) = n.n),
    us AS (SELECT n, m, k, sum(CASE WHEN (k >> i.i) & 1 = 1 AND (k >> j.j) & 1 = 0 AND j.j < i.i AND i.i < n + m THEN 1 ELSE 0 END) AS u FROM orders, (SELECT unnest(range(8)) AS i) i, (SELECT unnest(range(8)) AS j) j GROUP BY ALL),
    p AS (SELECT u.lsv_id, u.junc_idx, least(1.0, 2.0 * count(*) FILTER (us.u <= floor(least(u.u, n1 * n2 - u.u))) / count(*)) AS p FROM u JOIN us ON us.n = n1 AND us.m = n2 GROUP BY ALL),
    b AS (SELECT a.lsv_id, a.junc_idx, a.q75 - a.q25 AS a_iqr, b.q75 - b.q25 AS b_iqr, b.median_psi - a.median_psi AS dpsi FROM gs a JOIN gs b ON a.lsv_id = b.lsv_id AND a.junc_idx = b.junc_idx AND a.grp = 'A' AND b.grp = 'B')
    SELECT lsv_id, junc_idx, round(p, 6) AS p, p <= 0.05 AND round(abs(dpsi), 6) >= 0.1 AS changing, p >= 0.05 AND round(greatest(a_iqr, b_iqr), 6) <= 0.1 AND round(abs(dpsi), 6) <= 0.05 AS nonchanging FROM b JOIN p USING (lsv_id, junc_idx)"""
)
def heterogen_tested_classes(spark, sf_dir):
    """Changing and non-changing connections by the exact U test of their experiments."""
    samples = sample_psi(spark, sf_dir)
    p = T.tests_of_samples(samples.withColumn("psi", F.array("psi")), ["WILCOXON"]).select("lsv_id", "junc_idx", F.col("p_mean").alias("p"))
    both = rounded(T.two_groups(T.group_summary(samples)), "a_iqr", "b_iqr", "dpsi").join(p, ["lsv_id", "junc_idx"])
    found = T.heterogen_nonchanging(T.heterogen_changing(both, dpsi=0.1))
    return found.select("lsv_id", "junc_idx", F.round("p", 6).alias("p"), "changing", "nonchanging")


@query(
    f"""{CIGAR_SQL}, k AS (SELECT experiment, chrom || ':' || CASE WHEN ((flag & 16) <> 0) = ((flag & 128) <> 0) THEN '+' ELSE '-' END || ':' || (pos + g) || '-' || (pos + g + n + 1) AS id, r + clip AS o FROM walked WHERE c = 'N' AND r >= 8 AND length - r >= 8)
    SELECT experiment, id, false AS is_intron, count(*) AS reads, count(DISTINCT o) AS npos FROM k GROUP BY experiment, id"""
)
def stored_counts(spark, sf_dir):
    """Each experiment's junction counts, written and read again."""
    hits, path = E.junction_hits(V.alignments(spark, sf_dir), protocol="forward"), folder(spark)
    place = ["experiment", "chrom", "strand", "start", "end"]
    counts = E.summary(E.positional_counts(hits, place, "offset"), place)
    rows = counts.select("experiment", E.junction_id(*(F.col(c) for c in place[1:])).alias("id"), F.lit(False).alias("is_intron"), "reads", "npos")
    stored.write_counts(rows, path, {"strandness": "forward"})
    return stored.read_counts(spark, path).select("experiment", "id", "is_intron", "reads", "npos")


@query(f"""{WITH_SUMMARY}, {V.LSV_CONNECTIONS_SQL}, t AS (SELECT lsv_id, split_part(lsv_id, ':', 2) || '|' || count(*) || CASE WHEN bool_or(is_intron) THEN 'i' ELSE '' END AS lsv_type FROM connections GROUP BY lsv_id) SELECT experiment, lsv_id, junc_idx, reads, npos, lsv_type FROM summary JOIN t USING (lsv_id)""")
def stored_lsv_coverage(spark, sf_dir):
    """Coverage of LSVs by experiment and the table of their types, written and read again."""
    path = folder(spark)
    types = V.lsv_connections(spark, sf_dir).groupBy("lsv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_intron").alias("i"))
    text = F.concat(F.split_part("lsv_id", F.lit(":"), F.lit(2)), F.lit("|"), F.col("n").cast("string"), F.when(F.col("i"), "i").otherwise("")).alias("lsv_type")
    stored.write_lsv_coverage(summary_of(spark, sf_dir).select("experiment", "lsv_id", "junc_idx", "reads", "npos"), types.select("lsv_id", text), path)
    return stored.read_lsv_coverage(spark, path).select("experiment", "lsv_id", "junc_idx", "reads", "npos", "lsv_type")


@query(f"""{QUANT_SQL} SELECT comparison, split_part(comparison, '_', 1) AS first, split_part(comparison, '_', 2) AS second, 0.2::DOUBLE AS threshold, lsv_id, lsv_type, {LISTED('%.4f', 'dpsi')} AS mean_dpsi FROM q GROUP BY ALL""")
def result_files(spark, sf_dir):
    """Result tables of three comparisons, written with metadata in their headers and read with it."""
    path = folder(spark)
    rows = C.dpsi_rows(quant_of(spark, sf_dir)).select("comparison", "lsv_id", "lsv_type", "mean_dpsi")
    stored.write_result_files(rows, path, {n: {"group_names": n.split("_"), "threshold": 0.2} for n in NAMES})
    found, heads = stored.read_result_files(spark, path)
    value = lambda place, name: F.get_json_object("metadata", place).alias(name)
    own = heads.select("comparison", value("$.group_names[0]", "first"), value("$.group_names[1]", "second"), value("$.threshold", "threshold").cast("double").alias("threshold"))
    return found.join(F.broadcast(own), "comparison").select("comparison", "first", "second", "threshold", "lsv_id", "lsv_type", "mean_dpsi")
