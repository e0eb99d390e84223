"""Registered queries of summaries, readers, long reads and ingest, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import histogram as H
from ..functions import lsv as L
from ..operators import longread as R
from ..operators import structure as S
from ..operators import summarize as M
from ..sources import driver_views as V
from ..sources import readers
from ..streaming import ingest
from .build import MERGED_SQL, WITH_SUMMARY, summary_of
from .quant import AREA, FOLDS_SQL, HISTOGRAM_SQL, SAMPLE_SQL, psi_of_groups, sample_psi, test_histograms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""{WITH_SUMMARY}, r AS (SELECT lsv_id, junc_idx, sum(reads) AS reads FROM summary GROUP BY ALL), p AS (SELECT *, round(reads / CAST(sum(reads) OVER (PARTITION BY lsv_id) AS DOUBLE), 4) AS psi FROM r)
    SELECT regexp_extract(lsv_id, '^(.*):([st]):', 1) AS gene_id, lsv_id, regexp_extract(lsv_id, '^(.*):([st]):', 2) AS kind, CAST(regexp_extract(lsv_id, ':([0-9]+)-', 1) AS INT) AS ref_start, CAST(regexp_extract(lsv_id, '-([0-9]+)$', 1) AS INT) AS ref_end,
    CAST(count(*) AS INT) AS connections, string_agg(printf('%.4f', psi), ';' ORDER BY junc_idx) AS mean_psi, string_agg(CAST(reads AS VARCHAR), ';' ORDER BY junc_idx) AS reads FROM p GROUP BY lsv_id"""
)
def psi_rows(spark, sf_dir):
    r = summary_of(spark, sf_dir).groupBy("lsv_id", "junc_idx").agg(F.sum("reads").alias("reads"))
    psi = r.withColumn("mean_psi", F.round(F.col("reads") / F.sum("reads").over(W.partitionBy("lsv_id")), 4))
    return M.psi_rows(psi)


EXPERIMENTS = list(range(8))


@query(f"{WITH_SUMMARY} SELECT lsv_id, junc_idx, " + ", ".join(f"CAST(coalesce(sum(reads) FILTER (experiment = {e}), 0) AS BIGINT) AS reads_{e}" for e in EXPERIMENTS) + " FROM summary GROUP BY ALL")
def reads_by_experiment(spark, sf_dir):
    return M.reads_by_experiment(summary_of(spark, sf_dir), EXPERIMENTS)


@query(f"{WITH_SUMMARY} SELECT grp, lsv_id, junc_idx, CAST(sum(reads) AS BIGINT) AS reads, CAST(ceil(median(reads)) AS BIGINT) AS median_reads FROM summary GROUP BY ALL")
def group_reads(spark, sf_dir):
    return M.group_reads(summary_of(spark, sf_dir))


@query(f'{MERGED_SQL} SELECT gene_id, min("start") AS "start", max("end") AS "end", count(*) AS exons FROM merged GROUP BY ALL')
def gene_extents(spark, sf_dir):
    return M.gene_extents(S.merged_exons(V.transcript_exons(spark, sf_dir)))


TX_SQL = f"""{MERGED_SQL}, tj AS (SELECT DISTINCT gene_id, "end" AS "start", nx AS "end" FROM (SELECT *, lead("start") OVER (PARTITION BY gene_id, transcript_id ORDER BY "start", "end") AS nx FROM transcript_exons) WHERE nx IS NOT NULL)"""


def inner_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transcript_junctions(V.transcript_exons(spark, sf_dir)).filter("start <> -2 and end <> -2").select("gene_id", "start", "end").distinct()


@query(f"""{TX_SQL} SELECT gene_id, j."start", j."end", (SELECT min(m."start") FROM merged m WHERE m.gene_id = j.gene_id AND j."start" BETWEEN m."start" AND m."end") AS donor_exon, (SELECT min(m."start") FROM merged m WHERE m.gene_id = j.gene_id AND j."end" BETWEEN m."start" AND m."end") AS acceptor_exon FROM tj j""")
def containing_exons(spark, sf_dir):
    return M.containing_exons(inner_junctions(spark, sf_dir), S.merged_exons(V.transcript_exons(spark, sf_dir)))


@query(f"""{TX_SQL} SELECT gene_id, "start", "end" FROM merged m WHERE EXISTS (SELECT 1 FROM tj j WHERE j.gene_id = m.gene_id AND (j."start" + j."end") % 3 > 0 AND (j."start" BETWEEN m."start" AND m."end" OR j."end" BETWEEN m."start" AND m."end"))""")
def exons_with_reads(spark, sf_dir):
    j = inner_junctions(spark, sf_dir).withColumn("reads", (F.col("start") + F.col("end")) % 3)
    return M.exons_with_reads(S.merged_exons(V.transcript_exons(spark, sf_dir)), j)


@query(f"""{TX_SQL}, k AS (SELECT * FROM tj WHERE "start" % 4 <> 0) SELECT gene_id, "start", "end", k.gene_id IS NULL AS de_novo, CASE WHEN k.gene_id IS NULL THEN 'de_novo' WHEN tj."end" % 3 > 0 THEN 'annotated_with_reads' ELSE 'annotated_only' END AS presence FROM tj LEFT JOIN k USING (gene_id, "start", "end")""".replace("k.gene_id IS NULL", 'tj."start" % 4 = 0'))
def annotation_flags(spark, sf_dir):
    j = inner_junctions(spark, sf_dir)
    marked = M.annotated_flags(j, j.filter("start % 4 <> 0"))
    return marked.withColumn("presence", M.presence(~F.col("de_novo"), F.col("end") % 3 > 0))


@query(f"""{TX_SQL}, c AS (SELECT *, "start" % 2 = 0 AS s, "end" % 3 = 0 AS l, ("start" + "end") % 5 <> 0 AS a FROM tj) SELECT concat_ws('+', CASE WHEN s THEN 'short' END, CASE WHEN l THEN 'long' END, CASE WHEN a THEN 'annotation' END) AS class, count(*) AS n FROM c WHERE s OR l OR a GROUP BY ALL""")
def overlap_classes(spark, sf_dir):
    j = inner_junctions(spark, sf_dir)
    found = M.overlap_class(F.col("start") % 2 == 0, F.col("end") % 3 == 0, (F.col("start") + F.col("end")) % 5 != 0)
    return j.select(found.alias("class")).filter("class <> ''").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FOLDS_SQL}, p AS (SELECT grp, lsv_id, junc_idx, round(median((x + 1.0 / n) / (total + 1.0)), 6) AS mean_psi FROM n GROUP BY ALL), i AS (SELECT grp, lsv_id, max(mean_psi) AS max_psi FROM p GROUP BY ALL) SELECT * FROM i ORDER BY max_psi DESC, grp, lsv_id LIMIT 50 OFFSET 100")
def index_page(spark, sf_dir):
    i = psi_of_groups(spark, sf_dir).groupBy("grp", "lsv_id").agg(F.max("mean_psi").alias("max_psi"))
    return M.index_page(i, [F.desc("max_psi"), "grp", "lsv_id"], 100, 50)


def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LSV types from orders: two or three connections with sites and exons from the keys, some with an intron."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda s, e, k: F.concat(s.cast("string"), F.lit("e"), e.cast("string"), F.lit("."), k.cast("string"), F.lit("o2"))
    text = F.concat(F.when(o % 2 == 0, "s").otherwise("t"), F.lit("|"), part(1 + o % 2, 1 + c % 2, 1 + o % 2), F.lit("|"), part(1 + c % 2, 1 + o % 3, 1 + c % 2), F.when(c % 5 == 0, "|i").otherwise(""))
    return V.table(spark, sf_dir, "orders").select(text.alias("lsv_type")).distinct()


@query("""WITH p AS (SELECT DISTINCT o_orderkey % 2 AS o2, o_custkey % 2 AS c2, o_orderkey % 3 AS o3, o_custkey % 5 = 0 AS i FROM orders),
  t AS (SELECT *, 1 + o2 AS s1, 1 + c2 AS e1, 1 + o2 AS k1, 1 + c2 AS s2, 1 + o3 AS e2, 1 + c2 AS k2 FROM p), f AS (SELECT *, s1 <> s2 AS own, e1 = e2 AND k1 <> k2 AS other FROM t)
  SELECT DISTINCT CASE WHEN o2 = 0 THEN 's' ELSE 't' END || '|' || s1 || 'e' || e1 || '.' || k1 || 'o2|' || s2 || 'e' || e2 || '.' || k2 || 'o2' || CASE WHEN i THEN '|i' ELSE '' END AS lsv_type, i AS has_intron, NOT i AS is_binary, i AS is_complex,
  CAST(CASE WHEN e1 = e2 THEN 2 ELSE 3 END AS INT) AS exon_count, e1 <> e2 AS exon_skipping, CASE WHEN o2 = 0 THEN own ELSE other END AS a5ss, CASE WHEN o2 = 0 THEN other ELSE own END AS a3ss FROM f""")
def lsv_type_columns(spark, sf_dir):
    return M.type_columns(type_texts(spark, sf_dir))


@query(f"""WITH {V.MODULE_EDGES_SQL}, c AS (SELECT gene_id || ':s:' || src AS lsv_id, CASE WHEN CAST(substr(gene_id, 2) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS g, "start" AS ref, dst AS exon, "end" AS pos, is_intron FROM module_edges),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY lsv_id ORDER BY g * ref) AS s, dense_rank() OVER (PARTITION BY lsv_id ORDER BY g * exon) AS e, dense_rank() OVER (PARTITION BY lsv_id, exon ORDER BY g * pos) AS k FROM c WHERE NOT is_intron),
  n AS (SELECT DISTINCT lsv_id, s, e, k, max(k) OVER (PARTITION BY lsv_id, exon) AS n FROM r),
  t AS (SELECT lsv_id, 's|' || string_agg(s || 'e' || e || '.' || k || 'o' || n, '|' ORDER BY s, e, k) || CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.lsv_id = n.lsv_id AND is_intron) THEN '|i' ELSE '' END AS lsv_type FROM n GROUP BY lsv_id)
  SELECT lsv_id, CASE WHEN length(lsv_type) > 245 THEN 's|na' ELSE lsv_type END AS lsv_type FROM t""")
def lsv_types_built(spark, sf_dir):
    e = V.module_edges(spark, sf_dir)
    strand = F.when(F.substring("gene_id", 2, 9).cast("int") % 2 == 0, "+").otherwise("-")
    return M.built_types(e.select(F.concat("gene_id", F.lit(":s:"), F.col("src").cast("string")).alias("lsv_id"), F.lit("s").alias("kind"), strand.alias("strand"), F.col("start").alias("ref"), F.col("dst").alias("exon"), F.col("end").alias("at"), "is_intron"))


@query(f"""WITH {V.GENE_INTERVALS_SQL} SELECT gene_id, 'https://genome.example.org/tracks?db=hg38&position=' || replace(chrom || ':' || "start" || '-' || "end", ':', '%3A') AS link, CASE WHEN strand = '-' THEN "end" || '-' || "start" ELSE "start" || '-' || "end" END AS along, CASE WHEN "start" % 5 = 0 THEN 'na' ELSE CAST("start" AS VARCHAR) END || '-' || "end" AS exon FROM gene_intervals""")
def browser_links(spark, sf_dir):
    g = V.gene_intervals(spark, sf_dir)
    along = F.when(F.col("strand") == "-", F.concat_ws("-", "end", "start")).otherwise(F.concat_ws("-", "start", "end"))
    return g.select("gene_id", M.browser_link("https://genome.example.org/tracks", F.lit("hg38"), F.col("chrom"), F.col("start"), F.col("end")).alias("link"), along.alias("along"), L.exon_text(F.when(F.col("start") % 5 == 0, -1).otherwise(F.col("start")), F.col("end")).alias("exon"))


@query(f"""{MERGED_SQL} SELECT gene_id, "start", "end", CAST(row_number() OVER (PARTITION BY gene_id ORDER BY CASE WHEN CAST(substr(gene_id, 2) AS INT) % 2 = 0 THEN "start" ELSE -"start" END) AS INT) AS exon_number FROM merged""")
def exon_numbers(spark, sf_dir):
    e = S.merged_exons(V.transcript_exons(spark, sf_dir)).withColumn("strand", F.when(F.substring("gene_id", 2, 9).cast("int") % 2 == 0, "+").otherwise("-"))
    return S.exon_numbers(e).drop("strand")


def gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GFF3 text of the transcripts: genes, transcripts and exons."""
    e = V.transcript_exons(spark, sf_dir)
    line = lambda kind, s, t, attributes: F.concat_ws("\t", F.lit("chr1"), F.lit("."), F.lit(kind), s.cast("string"), t.cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    span = lambda *k: e.groupBy(*k).agg(F.min("start").alias("s"), F.max("end").alias("t"))
    genes = span("gene_id").select(line("gene", F.col("s"), F.col("t"), F.concat(F.lit("ID="), "gene_id", F.lit(";Name=gene%20"), "gene_id", F.lit(";tag=a;tag=b"))).alias("value"))
    transcripts = span("gene_id", "transcript_id").select(line("mRNA", F.col("s"), F.col("t"), F.concat(F.lit("ID="), "transcript_id", F.lit(";Parent="), "gene_id")).alias("value"))
    exons = e.select(line("exon", F.col("start"), F.col("end"), F.concat(F.lit("Parent="), "transcript_id")).alias("value"))
    return genes.unionByName(transcripts).unionByName(exons)


@query(f"""WITH {V.TRANSCRIPT_EXONS_SQL} SELECT gene_id, 'gene ' || gene_id AS gene_name, 'chr1' AS chrom, '+' AS strand, min("start") AS "start", max("end") AS "end" FROM transcript_exons GROUP BY gene_id""")
def gff_genes(spark, sf_dir):
    return readers.annotation(readers.parsed_gff(gff_lines(spark, sf_dir)))[0]


@query(f"""WITH {V.TRANSCRIPT_EXONS_SQL} SELECT gene_id, transcript_id, "start", "end" FROM transcript_exons""")
def gff_exons(spark, sf_dir):
    return readers.annotation(readers.parsed_gff(gff_lines(spark, sf_dir)))[1]


@query(f"WITH {V.ALIGNMENTS_SQL} SELECT 'x' AS experiment, read_id, flag, chrom, pos, cigar, CAST(10 + flag % 7 AS INT) AS seq_len FROM alignments")
def sam_reads(spark, sf_dir):
    a = V.alignments(spark, sf_dir)
    line = F.concat_ws("\t", "read_id", F.col("flag").cast("string"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.expr("repeat('A', 10 + flag % 7)"), F.lit("*"))
    return readers.parsed_sam(a.select(line.alias("value")), "x")


LONG_SQL = f"""{MERGED_SQL}, cnt AS (SELECT DISTINCT transcript_id, (CAST(substr(transcript_id, 3) AS BIGINT) % 40) / 4.0 AS c FROM transcript_exons)"""


def transcript_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transcript_exons(spark, sf_dir).select("transcript_id").distinct().withColumn("count", F.substring("transcript_id", 3, 12).cast("long") % 40 / 4.0)


@query(f"""{LONG_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY gene_id, transcript_id) AS n, lead("start") OVER (PARTITION BY gene_id, transcript_id ORDER BY "start", "end") AS nx FROM transcript_exons) SELECT gene_id, w."end" AS "start", nx AS "end", CAST(sum(ceil(c)) AS BIGINT) AS reads FROM w JOIN cnt USING (transcript_id) WHERE n >= 2 AND nx IS NOT NULL GROUP BY ALL""")
def long_read_junctions(spark, sf_dir):
    return R.junction_counts(V.transcript_exons(spark, sf_dir), transcript_counts(spark, sf_dir))


LONG_EXONS = 'long AS (SELECT DISTINCT gene_id, transcript_id, "start" - 500 + far AS "start", "end" + ("start" % 3) * 400 + far AS "end" FROM (SELECT *, CASE WHEN CAST(substr(transcript_id, 3) AS BIGINT) % 5 = 0 THEN 50000 ELSE 0 END AS far FROM transcript_exons))'


def long_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of long reads: wider ones; those of every fifth transcript lie behind all others."""
    e = V.transcript_exons(spark, sf_dir)
    far = F.when(F.substring("transcript_id", 3, 12).cast("long") % 5 == 0, 50_000).otherwise(0)
    return e.select("gene_id", "transcript_id", (F.col("start") - 500 + far).alias("start"), (F.col("end") + F.col("start") % 3 * 400 + far).alias("end")).distinct()


@query(f"""{LONG_SQL}, {LONG_EXONS}, gp AS (SELECT * FROM gaps WHERE "start" <= "end" + 1), h AS (SELECT DISTINCT gene_id, transcript_id, gp."start" AS s, gp."end" AS t FROM long JOIN gp USING (gene_id) WHERE long."start" <= gp."start" AND gp."end" <= long."end") SELECT gene_id, s AS "start", t AS "end", CAST(sum(ceil(c)) AS BIGINT) AS reads FROM h JOIN cnt USING (transcript_id) GROUP BY ALL""")
def long_read_introns(spark, sf_dir):
    gaps = S.potential_introns(S.merged_exons(V.transcript_exons(spark, sf_dir)))
    return R.intron_reads(long_exons(spark, sf_dir), gaps, transcript_counts(spark, sf_dir))


@query(f"""{LONG_SQL}, {LONG_EXONS}, d AS (SELECT DISTINCT gene_id, "start", "end" FROM long), mm AS (SELECT d.*, a."start" AS s, a."end" AS e FROM d JOIN merged a ON d.gene_id = a.gene_id AND a."start" <= d."end" AND d."start" <= a."end"),
  n AS (SELECT *, count(*) OVER w AS n, lead(s) OVER (w ORDER BY s, e) AS nx FROM mm WINDOW w AS (PARTITION BY gene_id, "start", "end"))
  SELECT DISTINCT * FROM (SELECT gene_id, greatest(s, "start") AS "start", least(e, "end") AS "end", 'exon' AS kind FROM n WHERE n > 1 UNION ALL SELECT gene_id, e + 1, nx - 1, 'intron' FROM n WHERE n > 1 AND nx IS NOT NULL UNION ALL SELECT gene_id, "start", "end", 'exon' FROM d WHERE (gene_id, "start", "end") NOT IN (SELECT (gene_id, "start", "end") FROM n WHERE n > 1))""")
def long_read_exon_parts(spark, sf_dir):
    return R.exon_parts(long_exons(spark, sf_dir), S.merged_exons(V.transcript_exons(spark, sf_dir)))


COMBINED_SQL = f"""{LONG_SQL}, {LONG_EXONS}, sh AS (SELECT * FROM merged), d AS (SELECT DISTINCT gene_id, "start", "end" FROM long), p AS (SELECT d.*, s."start" AS s, s."end" AS e FROM d JOIN sh s ON d.gene_id = s.gene_id AND s."start" <= d."end" AND d."start" <= s."end"), w AS (SELECT gene_id, s, e, min("start") AS l, max("end") AS h FROM p GROUP BY ALL), combined AS (SELECT sh.gene_id, least("start", coalesce(l, "start")) AS "start", greatest("end", coalesce(h, "end")) AS "end", CASE WHEN l IS NULL THEN 'short' ELSE 'both' END AS source FROM sh LEFT JOIN w ON sh.gene_id = w.gene_id AND sh."start" = w.s AND sh."end" = w.e UNION ALL SELECT gene_id, "start", "end", 'long' FROM d WHERE (gene_id, "start", "end") NOT IN (SELECT (gene_id, "start", "end") FROM p))"""


@query(f"{COMBINED_SQL} SELECT * FROM combined")
def combined_exons(spark, sf_dir):
    return R.combined_exons(S.merged_exons(V.transcript_exons(spark, sf_dir)), long_exons(spark, sf_dir))


@query(f"""{COMBINED_SQL}, n AS (SELECT *, CASE WHEN CAST(substr(gene_id, 2) AS BIGINT) % 2 = 0 THEN "start" ELSE -"start" END AS along FROM combined) SELECT gene_id, "start", "end", source, CAST(CASE WHEN source <> 'long' THEN count(*) FILTER (source <> 'long') OVER (PARTITION BY gene_id ORDER BY along, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS BIGINT) AS number FROM n""")
def long_read_exon_numbers(spark, sf_dir):
    short = S.merged_exons(V.transcript_exons(spark, sf_dir))
    strands = short.select("gene_id").distinct().withColumn("strand", F.when(F.substring("gene_id", 2, 12).cast("long") % 2 == 0, "+").otherwise("-"))
    return R.numbered_exons(R.combined_exons(short, long_exons(spark, sf_dir)), strands)


@query(f"""{TX_SQL}, lj AS (SELECT gene_id, "start", "end", 'x' || ("start" % 5) AS transcript_id, "end" % 90 AS reads FROM tj WHERE "end" % 4 > 0) SELECT gene_id || ':s:' || tj."start" AS lsv_id, CAST(row_number() OVER (PARTITION BY gene_id, tj."start" ORDER BY tj."end") - 1 AS INT) AS junc_idx, CAST(coalesce(reads, 0) AS BIGINT) AS reads FROM tj LEFT JOIN lj USING (gene_id, "start", "end")""")
def long_read_lsv_reads(spark, sf_dir):
    j = inner_junctions(spark, sf_dir)
    lsv = j.select("gene_id", "start", "end", F.concat("gene_id", F.lit(":s:"), F.col("start").cast("string")).alias("lsv_id"), (F.row_number().over(W.partitionBy("gene_id", "start").orderBy("end")) - 1).alias("junc_idx"))
    long = j.filter("end % 4 > 0").select("gene_id", "start", "end", F.explode(F.array(F.concat(F.lit("x"), (F.col("start") % 5).cast("string")), F.lit("z"))).alias("transcript_id"), (F.col("end") % 90).cast("long").alias("reads"))
    return R.lsv_reads(lsv, long)


@query(f"""{TX_SQL}, sp AS (SELECT gene_id, "start", "end" FROM merged UNION ALL SELECT gene_id, "start", "end" FROM tj WHERE "start" % 3 = 0), c AS (SELECT *, CASE WHEN "start" >= max("end") OVER (PARTITION BY gene_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM sp),
  il AS (SELECT *, sum(new) OVER (PARTITION BY gene_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c) SELECT gene_id, min("start") AS "start", max("end") AS "end" FROM il GROUP BY gene_id, island""")
def extended_modules(spark, sf_dir):
    return R.extended_modules(S.merged_exons(V.transcript_exons(spark, sf_dir)), inner_junctions(spark, sf_dir).filter("start % 3 = 0"))


@query(f"{WITH_SUMMARY} SELECT grp, lsv_id, junc_idx, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(CASE WHEN npos >= 2 AND reads >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM summary GROUP BY ALL")
def group_evidence(spark, sf_dir):
    return ingest.group_evidence(ingest.once_each(summary_of(spark, sf_dir)))


@query(f"""WITH {V.READ_HITS_SQL}, f AS (SELECT DISTINCT gene_id || '/' || (position % 9) AS file, grp, CASE WHEN position % 9 = 4 AND experiment = 5 THEN 7 ELSE experiment END AS experiment FROM read_hits), m AS (SELECT file, grp, list_sort(list(experiment)) AS m FROM f GROUP BY ALL) SELECT grp, count(DISTINCT m) AS versions FROM m GROUP BY grp HAVING count(DISTINCT m) > 1""")
def inconsistent_groups(spark, sf_dir):
    file = F.col("position") % 9
    experiment = F.when((file == 4) & (F.col("experiment") == 5), 7).otherwise(F.col("experiment"))
    return M.inconsistent_groups(V.read_hits(spark, sf_dir).select(F.concat_ws("/", "gene_id", file.cast("string")).alias("file"), "grp", experiment.alias("experiment")))


@query(f"""{HISTOGRAM_SQL}, m AS (SELECT gene, junc, round(sum(b * c), 6) AS mean, round(sum(b) - {AREA.format(t=0.2)}, 6) AS p FROM h GROUP BY ALL) SELECT gene AS lsv FROM m GROUP BY gene HAVING bool_or(abs(mean) >= 0.02) AND bool_or(p >= 0.844)""")
def changing_lsvs(spark, sf_dir):
    b = F.col("bins")
    means = test_histograms(spark, sf_dir).select(F.col("gene").alias("lsv"), F.round(H.expected(b, 39, -1.0, 1.0), 6).alias("mean"), F.round(H.share_outside(b, 39, 0.2), 6).alias("p"))
    return M.changing_lsvs(means, 0.02, 0.844)


@query(f"""{HISTOGRAM_SQL}, m AS (SELECT gene, junc, round({AREA.format(t=0.05)}, 6) AS p FROM h GROUP BY ALL) SELECT gene, max(p) AS p FROM m GROUP BY gene HAVING max(p) >= 0.084""")
def nonchanging_lsvs(spark, sf_dir):
    p = test_histograms(spark, sf_dir).select("gene", F.round(H.share_within(F.col("bins"), 39, 0.05), 6).alias("p"))
    return p.groupBy("gene").agg(F.max("p").alias("p")).filter("p >= 0.084")


@query(f"SELECT lsv_type FROM ({SQL['lsv_type_columns']}) WHERE is_binary AND a5ss AND contains(lsv_type, 'e2.2')")
def index_filter(spark, sf_dir):
    return M.index_filter(M.type_columns(type_texts(spark, sf_dir)), "E2.2", is_binary=True, a5ss=True).select("lsv_type")


@query(f"""{MERGED_SQL}, g2 AS (SELECT * FROM gaps WHERE "start" <= "end" + 1) SELECT DISTINCT m.gene_id || ':s:' || m."start" AS lsv_id, m.gene_id, g2."start", g2."end" FROM merged m JOIN g2 ON m.gene_id = g2.gene_id AND g2."start" = m."end" + 1""")
def lsv_introns(spark, sf_dir):
    e = S.merged_exons(V.transcript_exons(spark, sf_dir))
    own = e.select(F.concat("gene_id", F.lit(":s:"), F.col("start").cast("string")).alias("lsv_id"), "gene_id", "end")
    return M.introns_of(own, S.potential_introns(e))


@query(f"{SAMPLE_SQL} SELECT grp, experiment, lsv_id, junc_idx, psi FROM samples")
def merged_samples(spark, sf_dir):
    one = sample_psi(spark, sf_dir)
    later = one.filter("junc_idx < 2").withColumn("psi", F.lit(-1.0))
    return M.merged_samples(one.withColumn("file", F.lit("a")).unionByName(later.withColumn("file", F.lit("b"))))


@query(f"{WITH_SUMMARY} SELECT lsv_id, CAST(count(*) AS BIGINT) AS n FROM summary JOIN (SELECT DISTINCT 'G' || (p_partkey // 8) AS gene_id FROM part WHERE p_size = 7) USING (gene_id) GROUP BY lsv_id")
def gene_subset(spark, sf_dir):
    wanted = V.table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit("G"), F.expr("p_partkey div 8").cast("string")).alias("gene_id"))
    return readers.subset({"counts": summary_of(spark, sf_dir)}, wanted)["counts"].groupBy("lsv_id").agg(F.count(F.lit(1)).alias("n"))
