"""Registered queries on modules and events, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import event_rows as R
from ..operators import modules as M
from ..sources import driver_views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All connections with their modules."""
    number = F.substring("gene_id", 2, 9).cast("int")
    return M.with_modules(V.module_edges(spark, sf_dir).withColumn("strand", F.when(number % 2 == 0, "+").otherwise("-")))


EDGES_SQL = f"""WITH {V.MODULE_EDGES_SQL}, picked AS (SELECT *, CASE WHEN CAST(substr(gene_id, 2) AS INT) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM module_edges),
  cuts AS (SELECT *, src >= coalesce(max(dst) OVER (PARTITION BY gene_id ORDER BY src RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cut FROM picked),
  firsts AS (SELECT DISTINCT gene_id, src FROM cuts WHERE cut),
  m AS (SELECT p.*, (SELECT count(*) FROM firsts f WHERE f.gene_id = p.gene_id AND f.src <= p.src) AS m FROM picked p),
  e AS (SELECT gene_id, strand, src, dst, "start", "end", is_intron, CAST(CASE WHEN strand = '-' THEN max(m) OVER (PARTITION BY gene_id) - m + 1 ELSE m END AS INT) AS module_idx FROM m),
  j AS (SELECT * FROM e WHERE NOT is_intron), i AS (SELECT * FROM e WHERE is_intron),
  nx AS (SELECT *, EXISTS (SELECT 1 FROM i WHERE i.gene_id = o.gene_id AND i.module_idx = o.module_idx AND i.src = o.n AND i.dst = o.nxt) AS joined FROM (SELECT gene_id, module_idx, n, lead(n) OVER (PARTITION BY gene_id, module_idx ORDER BY n) AS nxt FROM (SELECT gene_id, module_idx, src AS n FROM e UNION SELECT gene_id, module_idx, dst FROM e)) o)"""
CASSETTE_SQL = """SELECT DISTINCT s.gene_id, s.module_idx, s.src AS c1, a.dst AS a1, s.dst AS c2, s."start" AS s_start, s."end" AS s_end, a."end" AS a1_start, b."start" AS a1_end FROM j s JOIN j a USING (gene_id, module_idx) JOIN j b USING (gene_id, module_idx)
  WHERE a.src = s.src AND a."start" = s."start" AND a.dst < s.dst AND b.src = a.dst AND b.dst = s.dst AND b."end" = s."end" """
TANDEM_SQL = """SELECT gene_id, module_idx, s_src AS c1, s_dst AS c2, s_start, s_end, n - 1 AS exons FROM (SELECT s.gene_id, s.module_idx, s.src AS s_src, s.dst AS s_dst, s."start" AS s_start, s."end" AS s_end, count(DISTINCT n.src) AS n FROM j s JOIN j n USING (gene_id, module_idx)
  WHERE s.dst - s.src > 2 AND n.dst = n.src + 1 AND n.src >= s.src AND n.dst <= s.dst AND (n.src <> s.src OR n."start" = s."start") AND (n.dst <> s.dst OR n."end" = s."end") GROUP BY ALL) WHERE n = s_dst - s_src"""
SPANNING_SQL = """SELECT s.gene_id, s.module_idx, s.src AS c1, s.dst AS c2, s."start" AS s_start, s."end" AS s_end, min(CASE WHEN x.src = s.src AND x.dst < s.dst THEN x.dst END) AS nearest, max(CASE WHEN x.dst = s.dst AND x.src > s.src THEN x.src END) AS nearest_in FROM j s JOIN e x USING (gene_id, module_idx) WHERE s.dst - s.src > 2 GROUP BY ALL"""
MXE_SQL = """SELECT DISTINCT p.gene_id, p.module_idx, p.src AS c1, p.dst AS a1, q.dst AS a2, r.dst AS c2 FROM j p JOIN j q USING (gene_id, module_idx) JOIN j r USING (gene_id, module_idx) JOIN j t USING (gene_id, module_idx)
  WHERE p.src = q.src AND p.dst < q.dst AND r.src = p.dst AND t.src = q.dst AND t.dst = r.dst AND r.dst > q.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.gene_id = p.gene_id AND x.module_idx = p.module_idx AND x.src = p.dst AND x.dst = q.dst)"""
SITES_SQL = """SELECT a.gene_id, a.module_idx, CASE WHEN (a.strand = '-' AND a."start" = b."start") OR (a.strand = '+' AND a."end" = b."end") THEN 'alt5' WHEN (a.strand = '-' AND a."end" = b."end") OR (a.strand = '+' AND a."start" = b."start") THEN 'alt3' ELSE 'alt3and5' END AS kind,
  a.src AS e1, a.dst AS e2, a."start" AS proximal_start, a."end" AS proximal_end, b."start" AS distal_start, b."end" AS distal_end FROM j a JOIN j b ON a.gene_id = b.gene_id AND a.module_idx = b.module_idx AND a.src = b.src AND a.dst = b.dst
  AND (a."end" - a."start" < b."end" - b."start" OR (a."end" - a."start" = b."end" - b."start" AND a."start" < b."start"))"""
PUTATIVE_INNER = """SELECT b.*, i."start" AS i_start, i."end" AS i_end FROM (
    SELECT s.gene_id, s.module_idx, s.strand, true AS is_left, s.src AS f, x.src AS t, s.src AS c1, x.src AS a1, s.dst AS c2, s."start" AS s_start, s."end" AS s_end, x."start" AS j_start, x."end" AS j_end FROM j s JOIN j x USING (gene_id, module_idx) WHERE x.src > s.src AND x.dst = s.dst AND x."end" = s."end"
    UNION ALL SELECT s.gene_id, s.module_idx, s.strand, false, x.dst, s.dst, s.src, x.dst, s.dst, s."start", s."end", x."start", x."end" FROM j s JOIN j x USING (gene_id, module_idx) WHERE x.src = s.src AND x.dst < s.dst AND x."start" = s."start") b
  JOIN i ON i.gene_id = b.gene_id AND i.module_idx = b.module_idx AND i.src = f WHERE (i.dst = t OR (NOT EXISTS (SELECT 1 FROM i d WHERE d.gene_id = b.gene_id AND d.module_idx = b.module_idx AND d.src = f AND d.dst = t)
    AND EXISTS (SELECT 1 FROM nx WHERE nx.gene_id = b.gene_id AND nx.module_idx = b.module_idx AND nx.n = f AND nx.nxt = i.dst) AND NOT EXISTS (SELECT 1 FROM nx WHERE nx.gene_id = b.gene_id AND nx.module_idx = b.module_idx AND nx.n >= f AND nx.n < t AND NOT nx.joined)))
  AND NOT EXISTS (SELECT 1 FROM j r WHERE r.gene_id = b.gene_id AND r.module_idx = b.module_idx AND r.src = f AND r.dst = t AND CASE WHEN is_left THEN r."start" = s_start ELSE r."end" = s_end END)"""
PUTATIVE_SQL = f"""SELECT DISTINCT gene_id, module_idx, CASE WHEN is_left = (strand = '+') THEN 'p_alt5' ELSE 'p_alt3' END AS kind, c1, a1, c2, s_start, s_end FROM ({PUTATIVE_INNER})"""
INTRON_SQL = """SELECT i.gene_id, i.module_idx, i.src AS c1, i.dst AS c2, i."start", i."end", count(*) AS spliced FROM i JOIN j USING (gene_id, module_idx) WHERE j.src = i.src OR j.dst = i.dst GROUP BY ALL"""
ENDS_SQL = """SELECT gene_id, module_idx, CASE WHEN is_right = (strand = '+') THEN 'last' ELSE 'first' END AS kind, ref, proximal_exon, distal_exon FROM (
  SELECT a.gene_id, a.module_idx, a.strand, true AS is_right, a.ref, a.exon AS proximal_exon, b.exon AS distal_exon FROM outs a JOIN outs b ON a.gene_id = b.gene_id AND a.module_idx = b.module_idx AND a.ref = b.ref AND (a.length < b.length OR (a.length = b.length AND a.exon < b.exon))
  UNION ALL SELECT a.gene_id, a.module_idx, a.strand, false, a.ref, a.exon, b.exon FROM ins a JOIN ins b ON a.gene_id = b.gene_id AND a.module_idx = b.module_idx AND a.ref = b.ref AND (a.length < b.length OR (a.length = b.length AND a.exon < b.exon)))"""
ENDS_WITH = """, outs AS (SELECT gene_id, module_idx, strand, src AS ref, dst AS exon, min("end" - "start") AS length FROM j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.gene_id = j.gene_id AND e.src = j.dst) GROUP BY ALL),
  ins AS (SELECT gene_id, module_idx, strand, dst AS ref, src AS exon, min("end" - "start") AS length FROM j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.gene_id = j.gene_id AND e.dst = j.src) GROUP BY ALL)"""


@query(f"{EDGES_SQL} SELECT gene_id, src, dst, \"start\", \"end\", is_intron, module_idx FROM e")
def module_boundaries(spark, sf_dir):
    return edges_of(spark, sf_dir).select("gene_id", "src", "dst", "start", "end", "is_intron", "module_idx")


@query(f"{EDGES_SQL}, b AS (SELECT gene_id, module_idx, min(src) AS f, max(dst) AS l FROM e GROUP BY ALL), n AS (SELECT *, CASE WHEN f > coalesce(lag(l) OVER w, -1) THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY gene_id ORDER BY f)), r AS (SELECT gene_id, CAST(sum(new) OVER (PARTITION BY gene_id ORDER BY f) AS BIGINT) AS region FROM n) SELECT gene_id, region, count(*) AS modules FROM r GROUP BY ALL")
def multi_gene_regions(spark, sf_dir):
    return M.multi_gene_regions(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} SELECT gene_id, module_idx, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2")
def valid_modules(spark, sf_dir):
    return M.valid_modules(edges_of(spark, sf_dir)).groupBy("gene_id", "module_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"{EDGES_SQL} {CASSETTE_SQL}")
def event_cassette(spark, sf_dir):
    return M.cassette(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {TANDEM_SQL}")
def event_tandem_cassette(spark, sf_dir):
    return M.tandem_cassette(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {SPANNING_SQL}")
def event_multi_exon_spanning(spark, sf_dir):
    return M.multi_exon_spanning(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {MXE_SQL}")
def event_mutually_exclusive(spark, sf_dir):
    return M.mutually_exclusive(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {SITES_SQL}")
def event_alternative_sites(spark, sf_dir):
    return M.alternative_sites(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {PUTATIVE_SQL}")
def event_putative_sites(spark, sf_dir):
    return M.putative_alternative_sites(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL} {INTRON_SQL}")
def event_alternative_intron(spark, sf_dir):
    return M.alternative_introns(edges_of(spark, sf_dir))


@query(f"{EDGES_SQL}{ENDS_WITH} {ENDS_SQL}")
def event_alternative_ends(spark, sf_dir):
    return M.alternative_ends(edges_of(spark, sf_dir))


@query(f'{EDGES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY gene_id, src) AS o, count(*) OVER (PARTITION BY gene_id, dst) AS t FROM e) SELECT gene_id, module_idx, src, dst, "start", "end", is_intron FROM c WHERE o = 1 AND t = 1')
def event_constitutive(spark, sf_dir):
    return M.constitutive(edges_of(spark, sf_dir))


EXONS_SQL = """, x AS (SELECT gene_id, CAST(k.k AS INT) AS exon, CAST(1000 * k.k + 90 AS INT) AS e_start, CAST(1000 * k.k + CASE WHEN (CAST(substr(gene_id, 2) AS INT) + k.k) % 5 = 0 THEN 1400 ELSE 265 END AS INT) AS e_end FROM (SELECT DISTINCT gene_id FROM e), (SELECT unnest(range(0, 17, 2)) AS k) k)"""


def exons_of(edges: DataFrame) -> DataFrame:
    genes = edges.select("gene_id").distinct()
    k = F.col("exon")
    number = F.substring("gene_id", 2, 9).cast("int")
    return genes.select("gene_id", F.explode(F.array(*map(F.lit, range(0, 17, 2)))).alias("exon")).select("gene_id", "exon", (1000 * k + 90).alias("e_start"), (1000 * k + F.when((number + k) % 5 == 0, 1400).otherwise(265)).alias("e_end"))


@query(f'{EDGES_SQL}{EXONS_SQL} SELECT DISTINCT gene_id, exon, "start", "end" FROM j JOIN x USING (gene_id) WHERE "start" > e_start AND "end" < e_end')
def event_exitron(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return M.exitrons(e, exons_of(e))


@query(f'{EDGES_SQL}{EXONS_SQL} SELECT DISTINCT gene_id, "start", "end" FROM j WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.gene_id = j.gene_id AND (j."start" BETWEEN e_start AND e_end OR j."end" BETWEEN e_start AND e_end))')
def event_orphan(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return M.orphans(e, exons_of(e))


HALF_SQL = """, hf AS (SELECT gene_id, CAST(k AS INT) AS exon FROM (SELECT DISTINCT gene_id FROM e), (SELECT unnest(range(17)) AS k) WHERE (CAST(substr(gene_id, 2) AS INT) + k) % 6 = 5)"""


def half_exons_of(edges: DataFrame) -> DataFrame:
    """gene_id, exon: every sixth exon, from a place that depends on the gene."""
    number = F.substring("gene_id", 2, 9).cast("int")
    return edges.select("gene_id").distinct().select("gene_id", F.explode(F.array(*map(F.lit, range(17)))).alias("exon")).filter((number + F.col("exon")) % 6 == 5)


def putative_ends_sql() -> str:
    side = lambda ref, end, right: f"""SELECT a.gene_id, a.module_idx, a.strand, {right} AS is_right, a.{ref} AS ref, a.{end} AS half, b.{end} AS other, a."start" AS half_start, a."end" AS half_end, b."start" AS other_start, b."end" AS other_end FROM e a JOIN e b ON b.gene_id = a.gene_id AND b.module_idx = a.module_idx AND b.{ref} = a.{ref} AND b.{end} <> a.{end}
    WHERE (a.gene_id, a.{end}) IN (SELECT (gene_id, exon) FROM hf) AND NOT EXISTS (SELECT 1 FROM e n WHERE n.gene_id = a.gene_id AND n.module_idx = a.module_idx AND n.{ref} = a.{end}) AND EXISTS (SELECT 1 FROM e n WHERE n.gene_id = a.gene_id AND n.module_idx = a.module_idx AND n.{end} = a.{end} AND (n.gene_id, n.{ref}) NOT IN (SELECT (gene_id, exon) FROM hf))"""  # noqa: E731
    return f"""SELECT DISTINCT gene_id, module_idx, CASE WHEN is_right = (strand = '+') THEN 'p_last' ELSE 'p_first' END AS kind, ref, half, other, half_start, half_end, other_start, other_end, half_end - half_start > other_end - other_start AS is_distal, is_right FROM ({side("src", "dst", "true")} UNION ALL {side("dst", "src", "false")})"""


@query(f"{EDGES_SQL}{HALF_SQL} SELECT gene_id, module_idx, kind, ref, half, other, half_start, half_end, other_start, other_end, is_distal AS distal FROM ({putative_ends_sql()})")
def event_putative_ends(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return M.putative_ends(e, half_exons_of(e)).drop("right")


@query(
    EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, dg AS (SELECT gene_id, exon, count(*) FILTER (left_) AS n_out, count(*) FILTER (NOT left_) AS n_in FROM (SELECT gene_id, src AS exon, true AS left_ FROM e UNION ALL SELECT gene_id, dst, false FROM e) GROUP BY ALL),
    rf AS (SELECT DISTINCT e.gene_id, module_idx, strand, exon, is_left, count(*) OVER (PARTITION BY e.gene_id, module_idx, exon, is_left) AS edges FROM (SELECT gene_id, module_idx, strand, src AS exon, true AS is_left FROM e UNION ALL SELECT gene_id, module_idx, strand, dst, false FROM e) e),
    ref AS (SELECT rf.*, CASE WHEN is_left THEN n_out ELSE n_in END AS own, CASE WHEN is_left THEN n_in ELSE n_out END AS other FROM rf JOIN dg USING (gene_id, exon)),
    wk AS (SELECT gene_id, exon, is_left, exon AS at, 0 AS k, CAST([] AS VARCHAR[]) AS regions, true AS going FROM ref WHERE own > 1
      UNION ALL SELECT w.gene_id, w.exon, w.is_left, CASE WHEN w.is_left THEN e.src ELSE e.dst END, k + 1, list_concat(regions, list_concat(CASE WHEN e.is_intron THEN [e."start" || '-' || e."end" || 'i'] ELSE [] END, CASE WHEN (CASE WHEN w.is_left THEN d.n_out ELSE d.n_in END) = 1 THEN [CAST(d.exon AS VARCHAR)] ELSE [] END)), (CASE WHEN w.is_left THEN d.n_out ELSE d.n_in END) = 1
      FROM wk w JOIN dg h ON h.gene_id = w.gene_id AND h.exon = w.at JOIN e ON e.gene_id = w.gene_id AND (CASE WHEN w.is_left THEN e.dst ELSE e.src END) = w.at JOIN dg d ON d.gene_id = w.gene_id AND d.exon = (CASE WHEN w.is_left THEN e.src ELSE e.dst END)
      WHERE going AND (CASE WHEN w.is_left THEN h.n_in ELSE h.n_out END) = 1),
    lw AS (SELECT gene_id, exon, is_left, max_by(regions, k) AS regions FROM wk GROUP BY ALL)
    SELECT r.gene_id, r.module_idx, CASE WHEN (r.strand = '+') = r.is_left THEN 'source' ELSE 'target' END AS kind, r.exon, edges, r.exon = (SELECT CASE WHEN r.is_left THEN min(src) ELSE max(dst) END FROM e WHERE e.gene_id = r.gene_id AND e.module_idx = r.module_idx) AS at_module_edge, other = 0 AS edge_of_transcript, array_to_string(regions, ';') AS regions
    FROM ref r JOIN lw ON lw.gene_id = r.gene_id AND lw.exon = r.exon AND lw.is_left = r.is_left WHERE own > 1"""
)
def primer_regions(spark, sf_dir):
    return M.primer_regions(edges_of(spark, sf_dir))


ALL_EVENTS_SQL = f"""{EDGES_SQL}{ENDS_WITH}, ev AS (SELECT gene_id, module_idx, 'cassette' AS t FROM ({CASSETTE_SQL}) UNION ALL SELECT gene_id, module_idx, 'tandem_cassette' FROM ({TANDEM_SQL}) UNION ALL SELECT gene_id, module_idx, 'multi_exon_spanning' FROM ({SPANNING_SQL})
  UNION ALL SELECT gene_id, module_idx, 'mutually_exclusive' FROM ({MXE_SQL}) UNION ALL SELECT gene_id, module_idx, kind FROM ({SITES_SQL}) UNION ALL SELECT gene_id, module_idx, kind FROM ({PUTATIVE_SQL}) UNION ALL SELECT gene_id, module_idx, 'alternative_intron' FROM ({INTRON_SQL}) UNION ALL SELECT gene_id, module_idx, kind FROM ({ENDS_SQL}))"""


@query(f"{ALL_EVENTS_SQL}, c AS (SELECT gene_id, module_idx, " + ", ".join(f"count(*) FILTER (t = '{t}') AS {t}" for t in M.EVENT_TYPES) + ", count(*) AS total FROM ev GROUP BY ALL) SELECT *, total > 1 AS is_complex, concat_ws('|', " + ", ".join(f"CASE WHEN {t} > 0 THEN '{t}^' || {t} END" for t in M.EVENT_TYPES) + ") AS collapsed FROM c")
def module_summary(spark, sf_dir):
    return M.module_summary(M.all_events(edges_of(spark, sf_dir)))


JUNCTIONS_SQL = f"""{EDGES_SQL}, c AS ({CASSETTE_SQL}), r AS (SELECT gene_id || '_' || module_idx || '_' || c1 || '_' || a1 || '_' || c2 || '_' || s_start || '_' || s_end AS event, s_start, s_end, a1_start, a1_end, k.k AS k, g.g AS g FROM c, (SELECT unnest(range(3)) AS k) k, (SELECT unnest(range(2)) AS g) g),
  q AS (SELECT event, CASE WHEN g = 0 THEN 'x_y' ELSE 'x_z' END AS comparison, CASE WHEN (s_start + a1_end + k) % 17 = 0 THEN NULL ELSE ((s_start * 3 + s_end + a1_start * 7 + k * 13 + g * 29) % 61 - 30) / 100.0 END AS dpsi FROM r)"""


def event_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, comparison, dpsi: the three connections of each cassette in two comparisons, with values from coordinates."""
    c = M.cassette(edges_of(spark, sf_dir))
    rows = c.select(F.concat_ws("_", "gene_id", "module_idx", "c1", "a1", "c2", "s_start", "s_end").alias("event"), "s_start", "s_end", "a1_start", "a1_end", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    value = ((F.col("s_start") * 3 + F.col("s_end") + F.col("a1_start") * 7 + F.col("k") * 13 + F.col("g") * 29) % 61 - 30) / 100.0
    return rows.select("event", F.when(F.col("g") == 0, "x_y").otherwise("x_z").alias("comparison"), F.when((F.col("s_start") + F.col("a1_end") + F.col("k")) % 17 != 0, value).alias("dpsi"))


@query(f"{JUNCTIONS_SQL}, o AS (SELECT event, comparison, bool_and(coalesce(abs(dpsi), 0) >= 0.1) AND bool_or(coalesce(abs(dpsi), 0) >= 0.2) AS c FROM q GROUP BY ALL) SELECT event, bool_or(c) AS changing FROM o GROUP BY ALL")
def event_changing(spark, sf_dir):
    return M.event_changing(event_junctions(spark, sf_dir))


@query(f"{JUNCTIONS_SQL} SELECT event, coalesce(max(abs(dpsi)), 1) < 0.25 AND avg(CASE WHEN abs(dpsi) <= 0.15 THEN 1.0 ELSE 0 END) >= 0.5 AS nonchanging FROM q GROUP BY ALL")
def event_nonchanging(spark, sf_dir):
    return M.event_nonchanging(event_junctions(spark, sf_dir), 0.15, 0.5, 0.25)


@query(f"{JUNCTIONS_SQL}, o AS (SELECT event, comparison, bool_and(coalesce(abs(dpsi), 0) >= 0.1) AND bool_or(coalesce(abs(dpsi), 0) >= 0.2) AS c FROM q GROUP BY ALL) SELECT event, bool_or(c) FILTER (comparison = 'x_y') AS x_y, bool_or(c) FILTER (comparison = 'x_z') AS x_z FROM o GROUP BY ALL")
def event_changing_by_comparison(spark, sf_dir):
    return M.event_changing_by_comparison(event_junctions(spark, sf_dir), ["x_y", "x_z"])


READ_SQL = JUNCTIONS_SQL.replace("q AS (SELECT event,", "q AS (SELECT event, CASE WHEN k = 2 THEN 't' ELSE 's' END AS lsv_id, k AS junction, CASE WHEN (s_start + k) % 5 <> 0 OR k = 1 THEN (s_end + a1_start + k * 7) % 9 END AS median_reads,", 1)


@query(f"""{READ_SQL}, b AS (SELECT event, coalesce(max(abs(dpsi)), 1) < 0.29 AND avg(CASE WHEN abs(dpsi) <= 0.15 THEN 1.0 ELSE 0 END) >= 0.4 AS ok FROM q GROUP BY ALL), lr AS (SELECT event, bool_and(coalesce(n >= 4, true)) AS enough FROM (SELECT event, lsv_id, sum(median_reads) AS n FROM (SELECT DISTINCT event, lsv_id, junction, median_reads FROM q) GROUP BY ALL) GROUP BY event)
  SELECT event, ok AND enough AS nonchanging FROM b JOIN lr USING (event)""")
def event_nonchanging_reads(spark, sf_dir):
    """Events that don't change and whose LSVs have reads enough."""
    c = M.cassette(edges_of(spark, sf_dir)).withColumn("event", F.concat_ws("_", "gene_id", "module_idx", "c1", "a1", "c2", "s_start", "s_end"))
    k = F.explode(F.array(*map(F.lit, range(3)))).alias("junction")
    rows = c.select("event", "s_start", "s_end", "a1_start", "a1_end", k)
    k = F.col("junction")
    known = rows.select("event", "junction", "s_start", "s_end", "a1_start", "a1_end", F.when(k == 2, "t").otherwise("s").alias("lsv_id"), F.when(((F.col("s_start") + k) % 5 != 0) | (k == 1), (F.col("s_end") + F.col("a1_start") + k * 7) % 9).alias("median_reads"), F.explode(F.array(F.lit(0), F.lit(1))).alias("g"))
    value = ((F.col("s_start") * 3 + F.col("s_end") + F.col("a1_start") * 7 + k * 13 + F.col("g") * 29) % 61 - 30) / 100.0
    valued = known.withColumn("dpsi", F.when((F.col("s_start") + F.col("a1_end") + k) % 17 != 0, value))
    return M.event_nonchanging(valued, 0.15, 0.4, 0.29, least_reads=4)


@query(f"""{JUNCTIONS_SQL}, o AS (SELECT event, comparison, bool_and(abs(dpsi) <= 0.2) AS c FROM q WHERE dpsi IS NOT NULL GROUP BY ALL) SELECT event, bool_or(c) FILTER (comparison = 'x_y') AS x_y, bool_or(c) FILTER (comparison = 'x_z') AS x_z FROM (SELECT DISTINCT event FROM q) LEFT JOIN o USING (event) GROUP BY ALL""")
def event_nonchanging_by_comparison(spark, sf_dir):
    return M.event_nonchanging_by_comparison(event_junctions(spark, sf_dir), ["x_y", "x_z"], 0.2)


VALUED_SQL = f"""{EDGES_SQL}, v AS (SELECT *, CASE WHEN (src + dst) % 3 = 0 THEN NULL ELSE gene_id || ':s:' || src END AS lsv_id, (("start" * 3 + "end" * 7) % 1999 - 999) / 1000.0 AS dpsi, ("start" + "end") // 10 % 7 AS max_reads, ("start" * 11 + "end") // 10 % 10 / 100.0 AS max_psi FROM e)"""


def valued_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("start"), F.col("end")
    return edges_of(spark, sf_dir).withColumns({"lsv_id": F.when((F.col("src") + F.col("dst")) % 3 != 0, F.concat("gene_id", F.lit(":s:"), F.col("src").cast("string"))), "dpsi": ((s * 3 + e * 7) % 1999 - 999) / 1000.0, "max_reads": F.floor((s + e) / 10) % 7, "max_psi": F.floor((s * 11 + e) / 10) % 10 / 100.0})


@query(f"""{VALUED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gene_id, module_idx ORDER BY lsv_id IS NULL, round(abs(dpsi), 3) DESC, "end" - "start", "start", "end") AS r FROM v) SELECT gene_id, module_idx, "start", "end", lsv_id, CAST(dpsi AS DOUBLE) AS dpsi FROM r WHERE r = 1""")
def heatmap_rows(spark, sf_dir):
    return M.heatmap_rows(valued_edges(spark, sf_dir))


RESULTS_SQL = f"""{VALUED_SQL}, w AS (SELECT *, CASE WHEN src % 4 <> 1 OR lsv_id IS NOT NULL THEN max_psi END AS p, CASE WHEN lsv_id IS NOT NULL THEN abs(dpsi) END AS d, dst % 3 = 0 AS c FROM v)"""


@query(f"""{RESULTS_SQL} SELECT gene_id, src, dst, "start", "end", is_intron FROM w WHERE max_reads >= 1 AND CASE WHEN p IS NULL AND d IS NULL THEN c ELSE coalesce(p >= 0.05, true) AND coalesce(d >= 0.1, true) END""")
def decomplexified(spark, sf_dir):
    there = F.col("lsv_id").isNotNull()
    e = valued_edges(spark, sf_dir).withColumns({"max_psi": F.when((F.col("src") % 4 != 1) | there, F.col("max_psi")), "max_dpsi": F.when(there, F.col("dpsi")), "is_constitutive": F.col("dst") % 3 == 0})
    return M.decomplexified(e, dpsi=0.1).select("gene_id", "src", "dst", "start", "end", "is_intron")


@query(
    f"""{EDGES_SQL}, lv AS (SELECT gene_id, src AS exon, 's' AS side, max(abs(("start" * 3 + "end" * 7) % 1999 - 999)) AS d FROM e GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT gene_id, dst, 't', max(abs(("start" * 3 + "end" * 7) % 1999 - 999)) FROM e GROUP BY gene_id, dst HAVING count(*) > 1),
    ok AS (SELECT e.gene_id, e.module_idx FROM e JOIN lv ON lv.gene_id = e.gene_id AND ((lv.side = 's' AND lv.exon = e.src) OR (lv.side = 't' AND lv.exon = e.dst)) GROUP BY ALL HAVING max(d) >= 800)
    SELECT gene_id, module_idx, count(*) AS n FROM e JOIN ok USING (gene_id, module_idx) GROUP BY ALL HAVING count(*) >= 2"""
)
def changing_modules(spark, sf_dir):
    """Modules that hold an LSV with a large change."""
    e = edges_of(spark, sf_dir).withColumn("d", F.abs((F.col("start") * 3 + F.col("end") * 7) % 1999 - 999))
    lsvs = R.lsv_sides(e)
    largest = e.groupBy("gene_id", F.col("src").alias("exon")).agg(F.max("d").alias("m")).withColumn("side", F.lit("s")).unionByName(e.groupBy("gene_id", F.col("dst").alias("exon")).agg(F.max("d").alias("m")).withColumn("side", F.lit("t")))
    changing = lsvs.join(largest, ["gene_id", "exon", "side"]).filter("m >= 800").select("gene_id", "exon", "side")
    return M.valid_modules(e, lsvs=lsvs, changing=changing).groupBy("gene_id", "module_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{VALUED_SQL} SELECT gene_id, "start", "end", round(coalesce(avg(CASE WHEN lsv_id IS NOT NULL THEN dpsi END), -1), 6) AS value FROM v GROUP BY ALL""")
def edge_quantification(spark, sf_dir):
    e = valued_edges(spark, sf_dir)
    q = e.filter("lsv_id is not null").select("gene_id", "start", "end", "lsv_id", F.col("dpsi").alias("value"), F.lit(0).alias("file_order"))
    q = q.unionByName(q.withColumns({"value": F.lit(9.0), "file_order": F.lit(1)}))
    return M.edge_quantification(e, q).withColumn("value", F.round("value", 6))


@query(f"""{EDGES_SQL}, nodes AS (SELECT gene_id, module_idx, src AS n FROM e UNION SELECT gene_id, module_idx, dst FROM e) SELECT a.gene_id, a.module_idx, a.n AS i, b.n AS j, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.gene_id = a.gene_id AND e.module_idx = a.module_idx AND e.src = a.n AND e.dst = b.n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM nodes a JOIN nodes b USING (gene_id, module_idx)""")
def module_adjacency(spark, sf_dir):
    return M.adjacency(edges_of(spark, sf_dir))


@query(f"""{EDGES_SQL}, st AS (SELECT DISTINCT gene_id, dst AS src, "end" AS exon_start FROM e), en AS (SELECT DISTINCT gene_id, src AS dst, "start" AS exon_end FROM e) SELECT DISTINCT gene_id, module_idx, src, dst, "start", "end", exon_start, exon_end FROM j LEFT JOIN st USING (gene_id, src) LEFT JOIN en USING (gene_id, dst)""")
def resolved_junctions(spark, sf_dir):
    return M.resolved_junctions(edges_of(spark, sf_dir)).select("gene_id", "module_idx", "src", "dst", "start", "end", "exon_start", "exon_end")


PATHS_SQL = EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, one AS (SELECT DISTINCT gene_id, module_idx, src, dst, "start" AS s, "end" AS t, "start" || '-' || "end" || CASE WHEN is_intron THEN 'i' ELSE '' END AS j FROM e),
  p AS (SELECT gene_id, module_idx, src AS at, CAST(src AS VARCHAR) AS path, '' AS junctions, 1 AS length, 0 AS bases, CAST(NULL AS INT) AS entered FROM (SELECT DISTINCT gene_id, module_idx, src FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.gene_id = a.gene_id AND b.module_idx = a.module_idx AND b.dst = a.src))
    UNION ALL SELECT p.gene_id, p.module_idx, o.dst, p.path || '-' || o.dst, p.junctions || CASE WHEN p.length > 1 THEN ',' ELSE '' END || o.j, p.length + 1, p.bases + coalesce(o.s - p.entered + 1, 0), o.t FROM p JOIN one o ON o.gene_id = p.gene_id AND o.module_idx = p.module_idx AND o.src = p.at)
  SELECT gene_id, module_idx, path, junctions, length, CAST(((bases % 3) + 3) % 3 AS INT) AS frame FROM p WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.gene_id = p.gene_id AND o.module_idx = p.module_idx AND o.src = p.at)"""


@query(PATHS_SQL)
def module_paths(spark, sf_dir):
    return M.paths(edges_of(spark, sf_dir))


@query(f"""{EDGES_SQL}, c AS ({CASSETTE_SQL}), n AS (SELECT *, gene_id || '_' || module_idx || '_CE_' || row_number() OVER (PARTITION BY gene_id, module_idx ORDER BY c1, a1, c2, s_start, s_end, a1_start, a1_end) AS event_id, a1_end - a1_start + 1 AS event_size FROM c)
  SELECT event_id, 'C1_C2' AS junction_name, 's' AS side, s_start AS "start", s_end AS "end", event_size FROM n UNION ALL SELECT event_id, 'C1_A', 's', s_start, a1_start, event_size FROM n UNION ALL SELECT event_id, 'C2_C1', 't', s_start, s_end, event_size FROM n UNION ALL SELECT event_id, 'C2_A', 't', a1_end, s_end, event_size FROM n""")
def cassette_rows(spark, sf_dir):
    return M.cassette_rows(M.cassette(edges_of(spark, sf_dir)))


@query(f"""{EDGES_SQL}{EXONS_SQL}, t AS (SELECT gene_id, dst AS exon, min("end") AS l, bool_or(is_intron) AS li FROM e GROUP BY ALL), o AS (SELECT gene_id, src AS exon, max("start") AS h, bool_or(is_intron) AS hi FROM e GROUP BY ALL)
  SELECT gene_id, exon, CASE WHEN l IS NULL OR li THEN e_start ELSE greatest(e_start, l) END AS "start", CASE WHEN h IS NULL OR hi THEN e_end ELSE least(e_end, h) END AS "end" FROM t FULL JOIN o USING (gene_id, exon) JOIN x USING (gene_id, exon)""")
def trimmed_exons(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return M.trimmed_exons(exons_of(e), e)


def ranged(*rows: tuple[str, str, str, str, str]) -> str:
    """SQL for an event's rows: name, side, exon, start, end of each."""
    return "[" + ", ".join(f"{{'junction_name': '{n}', 'side': {repr(s) if s in ('s', 't') else s}, 'exon': {x}, 's': {a}, 'e': {b}}}" for n, s, x, a, b in rows) + "]"


ONE = """SELECT gene_id, module_idx, src, dst, min((("start"), ("end"))) AS x FROM j GROUP BY ALL"""
ANY = """SELECT gene_id, module_idx, src, dst, min((("start"), ("end"))) AS x FROM e GROUP BY ALL"""
# Every exon side with two connections or more is an LSV here, so both sides of two connections between the same exons are.
SITES_FROM = f"""(SELECT *, proximal_start = distal_start AS l FROM ({SITES_SQL}))"""
sites = ranged(*((n, "CASE WHEN l THEN 's' ELSE 't' END", "CASE WHEN l THEN e1 ELSE e2 END", f"{p}_start", f"{p}_end") for n, p in (("Proximal", "proximal"), ("Distal", "distal"))))
both_sites = ranged(*((f"{e}_{f}_{j}", side, e.lower(), f"{p}_start", f"{p}_end") for e, f, side in (("E1", "E2", "s"), ("E2", "E1", "t")) for j, p in (("J1", "proximal"), ("J2", "distal"))))
ends = lambda kind: f"""SELECT z.gene_id, z.module_idx, concat_ws('_', ref, proximal_exon, distal_exon, sd) AS event, NULL::INT AS event_size, {ranged(('Proximal', 'sd', 'ref', 'p.x[1]', 'p.x[2]'), ('Distal', 'sd', 'ref', 'd.x[1]', 'd.x[2]'))} AS rows
  FROM (SELECT q.*, CASE WHEN ('{kind}' = 'last') = (strand = '+') THEN 's' ELSE 't' END AS sd FROM ({ENDS_SQL}) q JOIN (SELECT DISTINCT gene_id, strand FROM e) USING (gene_id) WHERE kind = '{kind}') z
  JOIN ({ONE}) p ON p.gene_id = z.gene_id AND p.module_idx = z.module_idx AND p.src = CASE WHEN sd = 's' THEN ref ELSE proximal_exon END AND p.dst = CASE WHEN sd = 's' THEN proximal_exon ELSE ref END
  JOIN ({ONE}) d ON d.gene_id = z.gene_id AND d.module_idx = z.module_idx AND d.src = CASE WHEN sd = 's' THEN ref ELSE distal_exon END AND d.dst = CASE WHEN sd = 's' THEN distal_exon ELSE ref END"""  # noqa: E731
past = [("Distal", "s", "c1", "s_start", "s_end"), ("Distal", "t", "c2", "s_start", "s_end")]
way = lambda side, exon, intron: ("Intron" if intron else "Proximal", side, exon, "i_start" if intron else "j_start", "i_end" if intron else "j_end")
putative = lambda kind: f"""SELECT DISTINCT p.gene_id, module_idx, concat_ws('_', c1, a1, c2, s_start, s_end, j_start, j_end, i_start, i_end) AS event, i_end - i_start + 1 + abs(x_end - x_start) + 1 AS event_size, CASE WHEN is_left THEN {ranged(past[0], way("s", "c1", True), past[1], way("t", "c2", False))} ELSE {ranged(past[0], way("s", "c1", False), past[1], way("t", "c2", True))} END AS rows
  FROM ({PUTATIVE_INNER}) p JOIN (SELECT gene_id, dst AS a1, min("end") AS x_start FROM e GROUP BY ALL) USING (gene_id, a1) JOIN (SELECT gene_id, src AS a1, max("start") AS x_end FROM e GROUP BY ALL) USING (gene_id, a1) WHERE CASE WHEN is_left = (strand = '+') THEN 'p_alt5' ELSE 'p_alt3' END = '{kind}'"""  # noqa: E731
EVENT_SQL = {
    "cassette": f"""SELECT gene_id, module_idx, concat_ws('_', c1, a1, c2, s_start, s_end, a1_start, a1_end) AS event, a1_end - a1_start + 1 AS event_size, {ranged(("C1_C2", "s", "c1", "s_start", "s_end"), ("C1_A", "s", "c1", "s_start", "a1_start"), ("C2_C1", "t", "c2", "s_start", "s_end"), ("C2_A", "t", "c2", "a1_end", "s_end"))} AS rows FROM ({CASSETTE_SQL})""",
    "tandem_cassette": f"""SELECT gene_id, module_idx, concat_ws('_', c1, c2, s_start, s_end) AS event, sum(st) FILTER (src <> c1) - sum(en) FILTER (dst <> c2) + count(*) - 1 AS event_size, {ranged(("C1_C2", "s", "c1", "s_start", "s_end"), ("C1_A", "s", "c1", "s_start", "min(en) FILTER (src = c1)"), ("C2_C1", "t", "c2", "s_start", "s_end"), ("C2_A_Last", "t", "c2", "max(st) FILTER (dst = c2)", "s_end"))} AS rows
      FROM (SELECT *, mn.b AS en, CASE WHEN dst = c2 THEN mx ELSE mn.a END AS st FROM (SELECT t.gene_id, t.module_idx, c1, c2, s_start, s_end, x.src, x.dst, min({{'a': x."start", 'b': x."end"}}) AS mn, max(x."start") AS mx FROM ({TANDEM_SQL}) t JOIN j x ON x.gene_id = t.gene_id AND x.module_idx = t.module_idx AND x.src >= c1 AND x.dst <= c2 AND x.dst = x.src + 1 AND (x.src <> c1 OR x."start" = s_start) AND (x.dst <> c2 OR x."end" = s_end)
      GROUP BY t.gene_id, t.module_idx, c1, c2, s_start, s_end, x.src, x.dst)) GROUP BY gene_id, module_idx, c1, c2, s_start, s_end""",
    "mutually_exclusive": f"""SELECT m.gene_id, m.module_idx, concat_ws('_', c1, a1, a2, c2) AS event, NULL::INT AS event_size, {ranged(("C1_A1", "s", "c1", "x.x[1]", "x.x[2]"), ("C1_A2", "s", "c1", "y.x[1]", "y.x[2]"), ("C2_A1", "t", "c2", "u.x[1]", "u.x[2]"), ("C2_A2", "t", "c2", "v.x[1]", "v.x[2]"))} AS rows FROM ({MXE_SQL}) m
      """ + " ".join(f"JOIN ({ONE}) {p} ON {p}.gene_id = m.gene_id AND {p}.module_idx = m.module_idx AND {p}.src = {a} AND {p}.dst = {b}" for p, a, b in (("x", "c1", "a1"), ("y", "c1", "a2"), ("u", "a1", "c2"), ("v", "a2", "c2"))),
    **{k: f"""SELECT gene_id, module_idx, concat_ws('_', e1, e2, proximal_start, proximal_end, distal_start, distal_end) AS event, {"NULL::INT" if k == "alt3and5" else "abs(proximal_start - distal_start) + abs(proximal_end - distal_end)"} AS event_size, {both_sites if k == "alt3and5" else sites} AS rows FROM {SITES_FROM} WHERE kind = '{k}'""" for k in ("alt5", "alt3", "alt3and5")},
    "alternative_intron": f"""SELECT DISTINCT i.gene_id, i.module_idx, concat_ws('_', i.src, i.dst, i."start", i."end", j.src, j.dst, j."start", j."end") AS event, i."end" - i."start" + 1 AS event_size, CASE WHEN j.dst = i.dst THEN {ranged(("C2_C1_intron", "t", "i.dst", 'i."start"', 'i."end"'), ("C2_C1_spliced", "t", "i.dst", 'j."start"', 'j."end"'))}
      ELSE {ranged(("C1_C2_intron", "s", "i.src", 'i."start"', 'i."end"'), ("C1_C2_spliced", "s", "i.src", 'j."start"', 'j."end"'))} END AS rows FROM i JOIN j USING (gene_id, module_idx) WHERE j.src = i.src OR j.dst = i.dst""",
    "first": ends("first"),
    "last": ends("last"),
    "multi_exon_spanning": f"""SELECT z.gene_id, z.module_idx, concat_ws('_', c1, c2, s_start, s_end) AS event, NULL::INT AS event_size, {ranged(("C1_C2", "s", "c1", "s_start", "s_end"), ("C1_A", "s", "c1", "p.x[1]", "p.x[2]"), ("C2_C1", "t", "c2", "s_start", "s_end"), ("A_C2", "t", "c2", "q.x[1]", "q.x[2]"))} AS rows FROM ({SPANNING_SQL}) z
      LEFT JOIN ({ANY}) p ON p.gene_id = z.gene_id AND p.module_idx = z.module_idx AND p.src = c1 AND p.dst = nearest LEFT JOIN ({ANY}) q ON q.gene_id = z.gene_id AND q.module_idx = z.module_idx AND q.src = nearest_in AND q.dst = c2""",
    "p_alt5": putative("p_alt5"),
    "p_alt3": putative("p_alt3"),
    "constitutive": f"""SELECT gene_id, module_idx, concat_ws('_', src, dst, "start", "end") AS event, NULL::INT AS event_size, {ranged(("C1_C2", "s", "src", '"start"', '"end"'), ("C2_C1", "t", "dst", '"start"', '"end"'))} AS rows FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, src) AS o, count(*) OVER (PARTITION BY gene_id, dst) AS t FROM e) WHERE o = 1 AND t = 1""",
    **{k: f"""SELECT gene_id, module_idx, concat_ws('_', ref, half, other, half_start, half_end, other_start, other_end) AS event, NULL::INT AS event_size, CASE WHEN is_distal THEN {ranged(("Proximal", "CASE WHEN is_right THEN 's' ELSE 't' END", "ref", "other_start", "other_end"), ("Distal", "CASE WHEN is_right THEN 's' ELSE 't' END", "ref", "half_start", "half_end"))}
      ELSE {ranged(("Proximal", "CASE WHEN is_right THEN 's' ELSE 't' END", "ref", "half_start", "half_end"), ("Distal", "CASE WHEN is_right THEN 's' ELSE 't' END", "ref", "other_start", "other_end"))} END AS rows FROM ({putative_ends_sql()}) WHERE kind = '{k}'""" for k in ("p_first", "p_last")},
    "exitron": f"""SELECT DISTINCT gene_id, module_idx, concat_ws('_', exon, "start", "end") AS event, NULL::INT AS event_size, {ranged(("exitron", "s", "exon", '"start"', '"end"'), ("exitron", "t", "exon", '"start"', '"end"'))} AS rows FROM j JOIN x USING (gene_id) WHERE "start" > e_start AND "end" < e_end""",
    "orphan": f"""SELECT DISTINCT gene_id, module_idx, concat_ws('_', src, dst, "start", "end") AS event, NULL::INT AS event_size, CASE WHEN o > 1 THEN {ranged(("Orphan", "s", "src", '"start"', '"end"'))} ELSE {ranged(("Orphan", "t", "dst", '"start"', '"end"'))} END AS rows
      FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, src) AS o, count(*) OVER (PARTITION BY gene_id, dst) AS t FROM e) k WHERE NOT is_intron AND (o > 1 OR t > 1) AND NOT EXISTS (SELECT 1 FROM x WHERE x.gene_id = k.gene_id AND (k."start" BETWEEN e_start AND e_end OR k."end" BETWEEN e_start AND e_end))""",
}


def rows_query(kind: str) -> None:
    sql = f"""{EDGES_SQL}{ENDS_WITH}{EXONS_SQL if kind in R.NEED_EXONS else ""}{HALF_SQL if kind in R.NEED_HALF else ""}, ev AS ({EVENT_SQL[kind]}), r AS (SELECT gene_id, concat_ws('_', gene_id, module_idx, '{kind}', event) AS event_id, event_size, unnest(rows) AS r FROM ev),
      lv AS (SELECT gene_id, 's' AS side, src AS exon FROM e GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT gene_id, 't', dst FROM e GROUP BY gene_id, dst HAVING count(*) > 1), mk AS (SELECT gene_id, "start", "end", min(strand) AS strand, bool_and(("start" + "end") % 7 = 0) AS de_novo FROM e GROUP BY ALL)
      SELECT event_id, r.junction_name AS junction_name, r.side AS side, CAST(r.r.s AS INT) AS "start", CAST(r.r.e AS INT) AS "end", CASE WHEN strand = '-' THEN mk."end" || '-' || mk."start" ELSE mk."start" || '-' || mk."end" END AS along, CAST(event_size AS INT) AS event_size, de_novo, CASE WHEN lv.exon IS NOT NULL THEN r.gene_id || ':' || lv.side || ':' || lv.exon END AS lsv_id
      FROM r LEFT JOIN mk ON mk.gene_id = r.gene_id AND mk."start" = r.r.s AND mk."end" = r.r.e LEFT JOIN lv ON lv.gene_id = r.gene_id AND lv.side = r.r.side AND lv.exon = r.r.exon"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = edges_of(spark, sf_dir).withColumn("de_novo", (F.col("start") + F.col("end")) % 7 == 0)
        return R.event_rows(e, kind, exons_of(e) if kind in R.NEED_EXONS else None, half=half_exons_of(e) if kind in R.NEED_HALF else None).withColumn("event_size", F.col("event_size").cast("int"))

    QUERIES[f"rows_{kind}"], SQL[f"rows_{kind}"] = run, sql


for _kind in (*R.TYPES, *R.NEED_EXONS, *R.NEED_HALF):
    rows_query(_kind)
