"""Registered queries of the quantification workload, with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..operators import evidence as E
from ..operators import quant as Q
from ..operators import stats as S
from ..sources import driver_views as V
from .build import WITH_SUMMARY, numbered_summary, summary_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


QUANTIFIABLE_SQL = f"""{WITH_SUMMARY}, sizes AS (SELECT grp, count(DISTINCT experiment) AS size FROM summary GROUP BY grp),
  ok AS (SELECT grp, experiment, lsv_id FROM summary GROUP BY ALL HAVING bool_or(reads >= 10 AND npos >= 3)),
  quantifiable AS (SELECT grp, lsv_id, count(*) AS experiments FROM ok GROUP BY ALL),
  good AS (SELECT q.* FROM quantifiable q JOIN sizes USING (grp) WHERE experiments >= greatest(1, least(size, ceil(size * 0.5))))"""
FOLDS_SQL = f"""{QUANTIFIABLE_SQL}, {V.LSV_CONNECTIONS_SQL},
  folded AS (SELECT c.grp, c.lsv_id, junc_idx, r.r AS rep, CAST(sum(CASE WHEN position % 5 <> r.r THEN reads ELSE 0 END) AS DOUBLE) * 1.25 AS x FROM counts c JOIN good USING (grp, lsv_id), (SELECT unnest(range(5)) AS r) r GROUP BY ALL),
  whole AS (SELECT grp, lsv_id, junc_idx, rep, coalesce(x, 0) AS x FROM good JOIN connections USING (lsv_id) CROSS JOIN (SELECT unnest(range(5)) AS rep) LEFT JOIN folded USING (grp, lsv_id, junc_idx, rep)),
  n AS (SELECT *, count(*) OVER (PARTITION BY grp, lsv_id, rep) AS n, sum(x) OVER (PARTITION BY grp, lsv_id, rep) AS total FROM whole)"""


def pooled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates of the quantifiable LSVs, pooled by group."""
    each = summary_of(spark, sf_dir, folds=5)
    return Q.boots_of_folds(Q.in_quantifiable(each, V.groups(spark, sf_dir)), ["grp", "lsv_id", "junc_idx"])


def dense_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled replicates of all connections of the quantifiable LSVs, a row for each group and LSV."""
    return Q.dense(pooled_coverage(spark, sf_dir), V.lsv_connections(spark, sf_dir), ["grp"])


def sample_psi(spark: SparkSession, sf_dir: str, numbers: bool = False) -> DataFrame:
    """grp, experiment, lsv_id, junc_idx, psi: posterior mean of every connection in every experiment in which the LSV
    passes. The splicegraph has what any experiment shows. numbers: lsv_id is a number, whose text V.named writes."""
    summed = numbered_summary(spark, sf_dir) if numbers else summary_of(spark, sf_dir)
    return Q.samples_of(summed).withColumn("psi", F.round("psi", 9))


SAMPLE_SQL = f"""{QUANTIFIABLE_SQL}, {V.LSV_CONNECTIONS_SQL}, every AS (SELECT grp, experiment, lsv_id, junc_idx, coalesce(reads, 0) AS reads, count(*) OVER w AS n, sum(coalesce(reads, 0)) OVER w AS total
    FROM ok JOIN connections USING (lsv_id) LEFT JOIN summary USING (grp, experiment, lsv_id, junc_idx) WINDOW w AS (PARTITION BY experiment, lsv_id)),
  samples AS (SELECT grp, experiment, lsv_id, junc_idx, round((reads + 1.0 / CAST(n AS DOUBLE)) / (total + 1.0), 9) AS psi FROM every)"""


@query(f"{QUANTIFIABLE_SQL} SELECT * FROM good")
def quantifiable_lsvs(spark, sf_dir):
    return V.named(Q.quantifiable(numbered_summary(spark, sf_dir), groups=V.groups(spark, sf_dir)))


@query(f"{QUANTIFIABLE_SQL} SELECT a.lsv_id, a.experiments AS a_experiments, b.experiments AS b_experiments FROM good a JOIN good b ON a.lsv_id = b.lsv_id AND a.grp = 'A' AND b.grp = 'B'")
def both_group_lsvs(spark, sf_dir):
    good = Q.quantifiable(numbered_summary(spark, sf_dir), groups=V.groups(spark, sf_dir))
    of = lambda g: F.max(F.when(F.col("grp") == g, F.col("experiments"))).alias(f"{g.lower()}_experiments")
    return V.named(good.groupBy("lsv_id").agg(of("A"), of("B")).dropna())


@query(f"{FOLDS_SQL} SELECT grp, lsv_id, junc_idx, round(median((x + 1.0 / n) / (total + 1.0)), 6) AS mean_psi FROM n GROUP BY ALL")
def psi_of_groups(spark, sf_dir):
    """Flagship: PSI of every quantifiable LSV of both groups."""
    return rounded(Q.mean_psi(dense_coverage(spark, sf_dir), ["grp"]), "mean_psi")


@query(f"{FOLDS_SQL} SELECT lsv_id, junc_idx, CAST(rep AS INT) AS rep, sum(x) AS x FROM folded GROUP BY ALL")
def pooled_replicates(spark, sf_dir):
    whole = Q.pooled(pooled_coverage(spark, sf_dir), ["lsv_id", "junc_idx"])
    return whole.select("lsv_id", "junc_idx", F.posexplode("boots").alias("rep", "x"))


@query(
    f"""{WITH_SUMMARY}, ok AS (SELECT grp, experiment, lsv_id FROM summary GROUP BY ALL HAVING bool_or(reads >= 20 AND npos >= 10)), best AS (SELECT grp, lsv_id FROM ok GROUP BY ALL HAVING count(*) >= 2),
    s AS (SELECT grp, lsv_id, junc_idx, sum(reads) AS reads FROM summary JOIN best USING (grp, lsv_id) GROUP BY ALL)
    SELECT grp, lsv_id, junc_idx, round(coalesce(reads / CAST(nullif(sum(reads) OVER w, 0) AS DOUBLE), 1.0 / count(*) OVER w), 6) AS psi FROM s WINDOW w AS (PARTITION BY grp, lsv_id)"""
)
def best_set_psi(spark, sf_dir):
    best = Q.in_quantifiable(numbered_summary(spark, sf_dir), V.groups(spark, sf_dir), value=2, min_reads=20, min_pos=10)
    total = best.groupBy("grp", "lsv_id", "junc_idx").agg(F.sum("reads").alias("reads"))
    return V.named(rounded(Q.empirical_psi(total, ["grp", "lsv_id"]).drop("reads"), "psi"))


SUMMARY_SQL = f"{SAMPLE_SQL}, gs AS (SELECT lsv_id, junc_idx, grp, count(psi) AS n, median(psi) AS median_psi, quantile_cont(psi, 0.25) AS q25, quantile_cont(psi, 0.75) AS q75 FROM samples GROUP BY ALL)"


@query(f"{SUMMARY_SQL} SELECT lsv_id, junc_idx, grp, n, round(median_psi, 6) AS median_psi, round(q25, 6) AS q25, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr FROM gs")
def group_medians(spark, sf_dir):
    return V.named(rounded(S.group_summary(sample_psi(spark, sf_dir, numbers=True)), "median_psi", "q25", "q75", "iqr"))


@query(f"{SUMMARY_SQL} SELECT a.lsv_id, a.junc_idx, a.grp AS g1, b.grp AS g2, round(b.median_psi - a.median_psi, 6) AS dpsi FROM gs a JOIN gs b ON a.lsv_id = b.lsv_id AND a.junc_idx = b.junc_idx AND a.grp < b.grp")
def median_dpsi(spark, sf_dir):
    return V.named(rounded(S.group_heat_map(S.group_summary(sample_psi(spark, sf_dir, numbers=True))), "dpsi"))


WELCH_SQL = f"""{SAMPLE_SQL}, m AS (SELECT lsv_id, junc_idx, count(psi) FILTER (grp = 'A') AS n1, count(psi) FILTER (grp = 'B') AS n2, avg(psi) FILTER (grp = 'A') AS m1, avg(psi) FILTER (grp = 'B') AS m2,
  var_samp(psi) FILTER (grp = 'A') AS v1, var_samp(psi) FILTER (grp = 'B') AS v2 FROM samples GROUP BY ALL)"""


@query(
    f"""{WELCH_SQL} SELECT lsv_id, junc_idx, round(CASE WHEN n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END, 5) AS t,
    round(CASE WHEN n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0 THEN (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 / n1 * v1 / n1 / (n1 - 1) + v2 / n2 * v2 / n2 / (n2 - 1)) END, 5) AS dof FROM m"""
)
def welch_statistic(spark, sf_dir):
    return V.named(rounded(S.welch(sample_psi(spark, sf_dir, numbers=True)), "t", "dof", digits=5))


@query(
    f"""{SAMPLE_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY lsv_id, junc_idx ORDER BY psi) + (count(*) OVER (PARTITION BY lsv_id, junc_idx, psi) - 1) / 2.0 AS r FROM samples)
    SELECT lsv_id, junc_idx, count(*) FILTER (grp = 'A') AS n1, count(*) FILTER (grp <> 'A') AS n2, coalesce(sum(r) FILTER (grp = 'A'), 0) - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0 AS u FROM r GROUP BY ALL"""
)
def mann_whitney_u(spark, sf_dir):
    return V.named(S.mann_whitney(sample_psi(spark, sf_dir, numbers=True)))


SPLITS_SQL = f"""{SAMPLE_SQL}, v AS (SELECT lsv_id, junc_idx, psi, count(*) FILTER (grp = 'A') AS c1, count(*) FILTER (grp <> 'A') AS c2 FROM samples GROUP BY ALL),
  t AS (SELECT lsv_id, junc_idx, sum(c1) OVER u AS b1, sum(c2) OVER u AS b2, sum(c1) OVER w AS n1, sum(c2) OVER w AS n2 FROM v WINDOW w AS (PARTITION BY lsv_id, junc_idx), u AS (PARTITION BY lsv_id, junc_idx ORDER BY psi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"{SPLITS_SQL} SELECT lsv_id, junc_idx, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(least(min(least(b1 + n2 - b2, n1 - b1 + b2)), n1, n2) AS BIGINT) AS score FROM t GROUP BY lsv_id, junc_idx, n1, n2")
def tnom_score(spark, sf_dir):
    return V.named(S.tnom(sample_psi(spark, sf_dir, numbers=True)))


@query(
    f"""{SPLITS_SQL}, e AS (SELECT *, CASE WHEN b1 > 0 AND b2 > 0 THEN -(b1 * ln(b1 / CAST(b1 + b2 AS DOUBLE)) + b2 * ln(b2 / CAST(b1 + b2 AS DOUBLE))) ELSE 0 END
      + CASE WHEN n1 > b1 AND n2 > b2 THEN -((n1 - b1) * ln((n1 - b1) / CAST(n1 + n2 - b1 - b2 AS DOUBLE)) + (n2 - b2) * ln((n2 - b2) / CAST(n1 + n2 - b1 - b2 AS DOUBLE))) ELSE 0 END AS s FROM t)
    SELECT lsv_id, junc_idx, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(min(s), 6) AS score FROM e GROUP BY lsv_id, junc_idx, n1, n2"""
)
def info_score(spark, sf_dir):
    return V.named(rounded(S.info_score(sample_psi(spark, sf_dir, numbers=True)), "score"))


# p of Welch's test: the incomplete beta function by its series, on the side where the argument is at most a half.
TTEST_SQL = """st AS (SELECT lsv_id, junc_idx, count(psi) FILTER (grp = 'A') AS n1, count(psi) FILTER (grp = 'B') AS n2, avg(psi) FILTER (grp = 'A') - avg(psi) FILTER (grp = 'B') AS d,
    var_samp(psi) FILTER (grp = 'A') / count(psi) FILTER (grp = 'A') AS e1, var_samp(psi) FILTER (grp = 'B') / count(psi) FILTER (grp = 'B') AS e2 FROM {samples} GROUP BY ALL),
  dof AS (SELECT *, n1 > 1 AND n2 > 1 AND e1 + e2 > 1e-24 AS varies, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS v, d * d / (e1 + e2) AS t2 FROM st),
  side AS (SELECT *, v / (v + t2) > 0.5 AS turned, CASE WHEN v / (v + t2) > 0.5 THEN t2 / (v + t2) ELSE v / (v + t2) END AS z, CASE WHEN v / (v + t2) > 0.5 THEN 0.5 ELSE v / 2 END AS a, CASE WHEN v / (v + t2) > 0.5 THEN v / 2 ELSE 0.5 END AS b FROM dof WHERE varies),
  part AS (SELECT lsv_id, junc_idx, any_value(turned) AS turned, any_value(CASE WHEN z > 0 THEN exp(a * ln(z) + b * ln(1 - z) + lgamma(a + b) - lgamma(a + 1) - lgamma(b)) ELSE 0 END)
    * sum(CASE WHEN z > 0 THEN exp(lgamma(a + 1) + lgamma(a + b + k) - lgamma(a + 1 + k) - lgamma(a + b) + k * ln(z)) ELSE 0 END) AS i FROM side, (SELECT unnest(range(120)) AS k) GROUP BY lsv_id, junc_idx),
  ttest AS (SELECT lsv_id, junc_idx, coalesce(CASE WHEN turned THEN 1 - i ELSE i END, 1.0) AS p FROM dof LEFT JOIN part USING (lsv_id, junc_idx))"""


@query(
    f"""{SUMMARY_SQL}, {TTEST_SQL.format(samples="samples")}, b AS (SELECT a.lsv_id, a.junc_idx, a.q75 - a.q25 AS a_iqr, b.q75 - b.q25 AS b_iqr, b.median_psi - a.median_psi AS dpsi FROM gs a JOIN gs b ON a.lsv_id = b.lsv_id AND a.junc_idx = b.junc_idx AND a.grp = 'A' AND b.grp = 'B')
    SELECT lsv_id, junc_idx, round(p, 6) AS p, round(p, 6) <= 0.05 AND round(abs(dpsi), 6) >= 0.1 AS changing, round(p, 6) >= 0.05 AND round(greatest(a_iqr, b_iqr), 6) <= 0.1 AND round(abs(dpsi), 6) <= 0.05 AS nonchanging FROM b JOIN ttest USING (lsv_id, junc_idx)"""
)
def heterogen_classes(spark, sf_dir):
    """Changing and non-changing connections by Welch's test of their experiments."""
    samples = sample_psi(spark, sf_dir)
    p = S.tests_of_samples(samples.withColumn("psi", F.array("psi")), ["TTEST"]).select("lsv_id", "junc_idx", F.round("p_mean", 6).alias("p"))
    both = rounded(S.two_groups(S.group_summary(samples)), "a_iqr", "b_iqr", "dpsi").join(p, ["lsv_id", "junc_idx"])
    return S.heterogen_nonchanging(S.heterogen_changing(both, dpsi=0.1)).select("lsv_id", "junc_idx", "p", "changing", "nonchanging")


def test_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, junc, bins (39, from integers), prior (39): of every part and connection."""
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("gene"), F.explode(F.array(*map(F.lit, range(4)))).alias("junc"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(38)), lambda i: ((F.col("gene") * 7 + F.col("junc") * 3 + i) % 11 + 1).cast("double"))
    prior = F.transform(F.sequence(F.lit(0), F.lit(38)), lambda i: (F.lit(20) - F.abs(i - 19)).cast("double"))
    return t.withColumn("raw", raw).withColumn("prior", prior).select("gene", "junc", H.normalised(F.col("raw")).alias("bins"), H.normalised(F.col("prior")).alias("prior"))


HISTOGRAM_SQL = """WITH raw AS (SELECT CAST(p_partkey AS INT) AS gene, CAST(j.j AS INT) AS junc, i.i AS i, CAST((p_partkey * 7 + j.j * 3 + i.i) % 11 + 1 AS DOUBLE) AS x, CAST(20 - abs(i.i - 19) AS DOUBLE) AS pr
  FROM part, (SELECT unnest(range(4)) AS j) j, (SELECT unnest(range(39)) AS i) i),
  h AS (SELECT gene, junc, i, x / sum(x) OVER (PARTITION BY gene, junc) AS b, pr / sum(pr) OVER (PARTITION BY gene, junc) AS p, -1.0 + (i + 0.5) * (2.0 / 39) AS c, -1.0 + i * (2.0 / 39) AS lo FROM raw)"""


@query(f"{HISTOGRAM_SQL} SELECT gene, junc, round(sum(b * c), 6) AS mean, round(greatest(0, sum(b * c * c) - sum(b * c) * sum(b * c)), 6) AS variance, round(sqrt(greatest(0, sum(b * c * c) - sum(b * c) * sum(b * c))), 6) AS stdev FROM h GROUP BY ALL")
def histogram_moments(spark, sf_dir):
    b = F.col("bins")
    var = H.variance(b, 39, -1.0, 1.0)
    return rounded(test_histograms(spark, sf_dir).select("gene", "junc", H.expected(b, 39, -1.0, 1.0).alias("mean"), var.alias("variance"), F.sqrt(var).alias("stdev")), "mean", "variance", "stdev")


AREA = "sum(b * greatest(0, least(1, (least(lo + 2.0 / 39, {t}) - greatest(lo, -{t})) / (2.0 / 39))))"


@query(f"{HISTOGRAM_SQL} SELECT gene, junc, round({AREA.format(t=0.05)}, 6) AS non_changing, round(sum(b) - {AREA.format(t=0.2)}, 6) AS changing FROM h GROUP BY ALL")
def threshold_mass(spark, sf_dir):
    b = F.col("bins")
    return rounded(test_histograms(spark, sf_dir).select("gene", "junc", H.share_within(b, 39, 0.05).alias("non_changing"), H.share_outside(b, 39, 0.2).alias("changing")), "non_changing", "changing")


@query(f"""{HISTOGRAM_SQL}, d AS (SELECT *, b / p AS q FROM h), e AS (SELECT *, q / sum(q) OVER (PARTITION BY gene, junc) AS r FROM d) SELECT gene, junc, round(sum(r * c), 6) AS mean, round(sum(r * abs(c)), 6) AS absolute FROM e GROUP BY ALL""")
def prior_removed(spark, sf_dir):
    r = test_histograms(spark, sf_dir).select("gene", "junc", H.without_prior(F.col("bins"), F.col("prior")).alias("r"))
    return rounded(r.select("gene", "junc", H.expected(F.col("r"), 39, -1.0, 1.0).alias("mean"), H.expected_absolute(F.col("r"), 39).alias("absolute")), "mean", "absolute")


TEN = [round(k / 9, 9) for k in range(10)]


@query(f"{HISTOGRAM_SQL}, t AS (SELECT gene, junc, abs(sum(b * c)) AS m, " + ", ".join(f"sum(b) - {AREA.format(t=t)} AS p{k}" for k, t in enumerate(TEN)) + f" FROM h GROUP BY ALL) SELECT gene, round(max(m), 6) AS max_abs_dpsi, " + ", ".join(f"round(max(p{k}), 6) AS p{k}" for k in range(10)) + " FROM t GROUP BY gene")
def dpsi_index(spark, sf_dir):
    b = F.col("bins")
    each = test_histograms(spark, sf_dir).select("gene", F.abs(H.expected(b, 39, -1.0, 1.0)).alias("m"), *(H.share_outside(b, 39, t).alias(f"p{k}") for k, t in enumerate(TEN)))
    return rounded(each.groupBy("gene").agg(F.max("m").alias("max_abs_dpsi"), *(F.max(f"p{k}").alias(f"p{k}") for k in range(10))), "max_abs_dpsi", *(f"p{k}" for k in range(10)))


@query(
    f"""{HISTOGRAM_SQL}, m AS (SELECT gene, junc, round(sum(b * c), 6) AS mean FROM h GROUP BY ALL)
    SELECT gene, junc, mean, CASE WHEN mean < 0 THEN -mean ELSE 0 END AS exclusion, CASE WHEN mean < 0 THEN 0 ELSE mean END AS inclusion, round(1 - mean, 6) AS other FROM m"""
)
def binary_unpacked(spark, sf_dir):
    m = rounded(test_histograms(spark, sf_dir).select("gene", "junc", H.expected(F.col("bins"), 39, -1.0, 1.0).alias("mean")), "mean")
    pair = H.exclusion_inclusion(F.col("mean"))
    return m.select("gene", "junc", "mean", pair[0].alias("exclusion"), pair[1].alias("inclusion"), F.round(H.unpacked_means(F.col("mean"))[1], 6).alias("other"))


@query(
    f"""{WITH_SUMMARY}, r AS (SELECT lsv_id, junc_idx, sum(reads) AS reads FROM summary GROUP BY ALL), w AS (SELECT *, count(*) OVER v AS n, sum(reads) OVER v AS total FROM r WINDOW v AS (PARTITION BY lsv_id))
    SELECT lsv_id, junc_idx, round((reads + 1.0 / n) / (reads + 1.0 / n + (total - reads + (n - 1) * (n - 1) / CAST(n AS DOUBLE))), 6) AS psi, round(reads / CAST(total AS DOUBLE), 6) AS ratio FROM w"""
)
def long_read_psi(spark, sf_dir):
    reads = summary_of(spark, sf_dir).groupBy("lsv_id", "junc_idx").agg(F.sum("reads").alias("reads"))
    return rounded(Q.long_read_psi(reads), "psi", "ratio")


@query(f"""{SAMPLE_SQL}, b AS (SELECT grp, lsv_id, junc_idx, CAST(least(floor(psi * 40), 39) AS INT) AS bin, count(*) AS n FROM samples GROUP BY ALL) SELECT grp, lsv_id, junc_idx, bin, round(n / CAST(sum(n) OVER (PARTITION BY grp, lsv_id, junc_idx) AS DOUBLE), 6) AS share FROM b""")
def sample_histogram(spark, sf_dir):
    return V.named(rounded(Q.histogram_of(sample_psi(spark, sf_dir, numbers=True), ["grp", "lsv_id", "junc_idx"]), "share"))


def experiment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates of all connections of the LSVs that pass in an experiment, a row for each experiment and LSV."""
    keys = ["experiment", "lsv_id", "junc_idx"]
    seen = Q.boots_of_folds(Q.in_passing(summary_of(spark, sf_dir, folds=5)), keys)
    return Q.dense(seen, V.lsv_connections(spark, sf_dir), ["experiment"])


@query()
def bootstrap_replicates(spark, sf_dir):
    keys = ["experiment", "lsv_id", "junc_idx"]
    counts = E.positional_counts(V.read_hits(spark, sf_dir), keys, "position")
    lists = counts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "reads"))), lambda s: s["reads"].cast("int")).alias("counts"))
    return Q.bootstrap(lists, keys)


@query()
def psi_posterior(spark, sf_dir):
    return Q.psi_posterior(dense_coverage(spark, sf_dir), ["grp"])


def quadrature(pieces: int = 4, nodes: int = 16) -> str:
    """A table of places u and weights w: Gauss-Legendre nodes in equal pieces of [0, 1]."""
    t, w = np.polynomial.legendre.leggauss(nodes)
    rows = ((piece + (x + 1) / 2) / pieces for piece in range(pieces) for x in t)
    return "SELECT * FROM (VALUES " + ", ".join(f"({u!r}, {v!r})" for u, v in zip(map(float, rows), [float(x) / 2 / pieces for x in w] * pieces)) + ") q (u, w)"


def masses_sql(table: str, keys: str, bins: int, name: str) -> str:
    """Tables {name}_d and {name}: keys, bin, m, the beta(a, b) masses in equal bins of the rows of `table`, by
    quadrature. In the first and the last bin the 12th root of the distance from the end is the variable: there the
    density has a pole of order 1 - 1 / n, n at most 4."""
    edge = f"power({1 / bins!r}, 1.0 / 12)"
    log = "exp((a - 1) * ln(x) + (b - 1) * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b))"
    return f"""{name}_d AS (SELECT {keys}, bin, u, w, a, b, CASE WHEN bin = 0 THEN power({edge} * u, 12) WHEN bin = {bins - 1} THEN 1 - power({edge} * u, 12) ELSE (bin + u) / {bins} END AS x, CASE WHEN bin IN (0, {bins - 1}) THEN {edge} * 12 * power({edge} * u, 11) ELSE {1 / bins!r} END AS dx
    FROM {table}, (SELECT CAST(unnest(range({bins})) AS INT) AS bin) CROSS JOIN ({quadrature()})),
  {name} AS (SELECT {keys}, bin, sum(w * dx * CASE WHEN bin = {bins - 1} THEN exp((a - 1) * ln(x) + (b - 1) * 12 * ln({edge} * u) + lgamma(a + b) - lgamma(a) - lgamma(b)) ELSE {log} END) AS m FROM {name}_d GROUP BY {keys}, bin)"""


POSTERIOR_SQL = f"{FOLDS_SQL}, ab AS (SELECT grp, lsv_id, junc_idx, rep, x + 1.0 / n AS a, total - x + 1 - 1.0 / n AS b FROM n)"


@query(
    f"""{POSTERIOR_SQL}, {masses_sql("ab", "grp, lsv_id, junc_idx, rep", 40, "mass")}, h AS (SELECT grp, lsv_id, junc_idx, bin, avg(m) AS m FROM mass GROUP BY ALL)
    SELECT grp, lsv_id, junc_idx, round(sum(m * (bin + 0.5) / 40), 5) AS mean, round(sqrt(sum(m * power((bin + 0.5) / 40, 2)) - power(sum(m * (bin + 0.5) / 40), 2)), 5) AS stdev, round(max(m), 5) AS highest FROM h GROUP BY ALL"""
)
def posterior_moments(spark, sf_dir):
    """Mean, standard deviation and highest bin of the posterior histograms."""
    h, b = Q.psi_posterior(dense_coverage(spark, sf_dir), ["grp"]), F.col("bins")
    return rounded(h.select("grp", "lsv_id", "junc_idx", H.expected(b, 40, 0.0, 1.0).alias("mean"), F.sqrt(H.variance(b, 40, 0.0, 1.0)).alias("stdev"), F.array_max(b).alias("highest")), "mean", "stdev", "highest", digits=5)


def change_of_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple]:
    """Differences of PSI of the two groups, and the priors used, fitted to the best sets' LSVs, junctions and introns apart."""
    connections, best = V.lsv_connections(spark, sf_dir), best_set_psi(spark, sf_dir)
    side = lambda df, g: df.filter(F.col("grp") == g).drop("grp")
    priors = Q.priors_of(Q.best_differences(side(best, "A"), side(best, "B"), connections, most=4))
    whole = dense_coverage(spark, sf_dir)
    return Q.delta_psi(side(whole, "A"), side(whole, "B"), *priors), priors


@query()
def delta_psi(spark, sf_dir):
    return change_of_groups(spark, sf_dir)[0]


BEST_SQL = """ok20 AS (SELECT grp, experiment, lsv_id FROM summary GROUP BY ALL HAVING bool_or(reads >= 20 AND npos >= 10)), best AS (SELECT grp, lsv_id FROM ok20 GROUP BY ALL HAVING count(*) >= 2),
  bs AS (SELECT grp, lsv_id, junc_idx, sum(reads) AS reads FROM summary JOIN best USING (grp, lsv_id) GROUP BY ALL),
  bp AS (SELECT grp, lsv_id, junc_idx, round(coalesce(reads / CAST(nullif(sum(reads) OVER w, 0) AS DOUBLE), 1.0 / count(*) OVER w), 6) AS psi FROM bs WINDOW w AS (PARTITION BY grp, lsv_id)),
  kinds AS (SELECT lsv_id, min(junc_idx) AS junc_idx, bool_or(is_intron) AS is_intron FROM connections GROUP BY lsv_id),
  df AS (SELECT is_intron, unnest([y.psi - x.psi, x.psi - y.psi]) AS x FROM kinds k JOIN bp x ON x.grp = 'A' AND x.lsv_id = k.lsv_id AND x.junc_idx = k.junc_idx JOIN bp y ON y.grp = 'B' AND y.lsv_id = k.lsv_id AND y.junc_idx = k.junc_idx)"""
PRIOR_SQL = f"""{BEST_SQL}, mo AS (SELECT is_intron, count(*) AS n, var_samp(x) FILTER (abs(x) <= 0.075) AS v1, var_samp(x) FILTER (abs(x) > 0.075 AND abs(x) <= 0.325) AS v2 FROM df GROUP BY is_intron),
  fit AS (SELECT * FROM mo WHERE n > 100 AND v1 > 0 AND v2 > 0), own AS (SELECT k.is_intron, CASE WHEN NOT EXISTS (SELECT 1 FROM fit WHERE NOT is_intron) THEN NULL ELSE EXISTS (SELECT 1 FROM fit f WHERE f.is_intron = k.is_intron) AND k.is_intron END AS source FROM (SELECT unnest([true, false]) AS is_intron) k),
  shapes AS (SELECT is_intron, c, greatest(0.5 * (0.25 / (v / 4) - 1), 1.0) AS a, greatest(0.5 * (0.25 / (v / 4) - 1), 1.0) AS b FROM (SELECT is_intron, unnest([1, 2]) AS c, unnest([v1, v2]) AS v FROM fit)),
  {masses_sql("shapes", "is_intron, c", 39, "pm")},
  mixed AS (SELECT is_intron, bin, (sum(m) + {1 / 39!r}) / 3 + 1e-12 AS p FROM pm GROUP BY is_intron, bin),
  spike AS (SELECT CAST(unnest(range(39)) AS INT) AS bin), dflt AS (SELECT bin, 0.95 * exp(-0.5 * power((bin - 19) / 20.0 / 0.05, 2)) / sum(exp(-0.5 * power((bin - 19) / 20.0 / 0.05, 2))) OVER () + {0.05 / 39!r} AS p FROM spike),
  prior AS (SELECT o.is_intron, m.bin, p FROM own o JOIN mixed m ON m.is_intron = o.source UNION ALL SELECT o.is_intron, bin, p FROM own o, dflt WHERE o.source IS NULL)"""


CHANGE_SQL = f"""{POSTERIOR_SQL}, {PRIOR_SQL}, {masses_sql("ab", "grp, lsv_id, junc_idx, rep", 20, "mass")},
    lsv AS (SELECT lsv_id, bool_or(is_intron) AS is_intron FROM connections GROUP BY lsv_id),
    j AS (SELECT x.lsv_id, x.junc_idx, x.rep, y.bin - x.bin AS d, x.m * y.m * p AS m FROM mass x JOIN mass y ON x.grp = 'A' AND y.grp = 'B' AND x.lsv_id = y.lsv_id AND x.junc_idx = y.junc_idx AND x.rep = y.rep JOIN lsv ON lsv.lsv_id = x.lsv_id JOIN prior ON prior.is_intron = lsv.is_intron AND prior.bin = y.bin - x.bin + 19),
    z AS (SELECT lsv_id, junc_idx, rep, d, sum(m) AS m FROM j GROUP BY ALL), nz AS (SELECT *, m / sum(m) OVER (PARTITION BY lsv_id, junc_idx, rep) AS s FROM z),
    h AS (SELECT lsv_id, junc_idx, d + 19 AS i, avg(s) AS b, -1.0 + (d + 19) * (2.0 / 39) AS lo FROM nz GROUP BY ALL)"""


@query(
    f"""{CHANGE_SQL},
    mp AS (SELECT grp, lsv_id, junc_idx, median((x + 1.0 / n) / (total + 1.0)) AS psi FROM n GROUP BY ALL),
    q AS (SELECT lsv_id, junc_idx, sum(b * (-1.0 + (i + 0.5) * (2.0 / 39))) AS mean, sum(b) - {AREA.format(t=0.2)} AS p FROM h GROUP BY ALL)
    SELECT q.lsv_id, q.junc_idx, round(x.psi, 5) AS mean_psi_1, round(y.psi, 5) AS mean_psi_2, round(mean, 5) AS mean_dpsi, round(p, 5) AS changing FROM q JOIN mp x ON x.grp = 'A' AND x.lsv_id = q.lsv_id AND x.junc_idx = q.junc_idx JOIN mp y ON y.grp = 'B' AND y.lsv_id = q.lsv_id AND y.junc_idx = q.junc_idx"""
)
def delta_psi_moments(spark, sf_dir):
    """Means of both groups, expected difference and mass beyond 0.2 of the posterior differences."""
    b = F.col("bins")
    found = change_of_groups(spark, sf_dir)[0].select("lsv_id", "junc_idx", "mean_psi_1", "mean_psi_2", H.expected(b, 39, -1.0, 1.0).alias("mean_dpsi"), H.share_outside(b, 39, 0.2).alias("changing"))
    return rounded(found, "mean_psi_1", "mean_psi_2", "mean_dpsi", "changing", digits=5)


@query(
    f"""{CHANGE_SQL}, cp AS (SELECT is_intron, bin AS i, p * (20 - abs(bin - 19)) AS p FROM prior), dv AS (SELECT h.lsv_id, h.junc_idx, h.i, h.lo, h.b / p AS q FROM h JOIN lsv USING (lsv_id) JOIN cp ON cp.is_intron = lsv.is_intron AND cp.i = h.i),
    rm AS (SELECT lsv_id, junc_idx, i, lo, q / sum(q) OVER (PARTITION BY lsv_id, junc_idx) AS b FROM dv), x AS (SELECT lsv_id, junc_idx, abs(sum(b * (-1.0 + (i + 0.5) * (2.0 / 39)))) AS d, {AREA.format(t=0.05)} AS p FROM rm GROUP BY ALL)
    SELECT lsv_id, junc_idx, round(d, 5) AS abs_dpsi, round(p, 5) AS non_changing, round(d, 5) <= 0.05 AS is_nonchanging FROM x"""
)
def delta_psi_without_prior(spark, sf_dir):
    """Absolute expected difference and mass within 0.05 after the prior is taken out, and who doesn't change by that."""
    found, priors = change_of_groups(spark, sf_dir)
    b = F.col("bins")
    bare = Q.without_prior(found, *priors).select("lsv_id", "junc_idx", F.abs(H.expected(b, 39, -1.0, 1.0)).alias("abs_dpsi"), H.share_within(b, 39, 0.05).alias("non_changing"))
    return rounded(bare, "abs_dpsi", "non_changing", digits=5).withColumn("is_nonchanging", F.col("abs_dpsi") <= 0.05)


def with_group(samples: DataFrame) -> DataFrame:
    return samples.withColumn("grp", F.when(F.col("experiment") < 4, "A").otherwise("B"))


@query()
def heterogen_tests(spark, sf_dir):
    return S.tests_of_samples(with_group(Q.psi_samples(experiment_coverage(spark, sf_dir), samples=20)), ["ALL"])


# p of the rank tests by trying all orders of up to 4 and 4 values.
RANK_TESTS_SQL = """orders AS (SELECT n, m, k FROM (SELECT unnest(range(1, 5)) AS n), (SELECT unnest(range(1, 5)) AS m), (SELECT unnest(range(256)) AS k) WHERE k < (1 << (n + m)::INT) AND bit_count(k) = n),
  cut AS (SELECT n, m, k, i, bit_count(k & ((1 << i::INT) - 1)) AS a FROM orders, (SELECT unnest(range(9)) AS i) WHERE i <= n + m),
  every AS (SELECT n, m, k, min(least(a + m - (i - a), n - a + (i - a))) AS t, min(ent(a, i - a) + ent(n - a, m - (i - a))) AS e FROM cut GROUP BY ALL),
  us AS (SELECT n, m, k, sum(CASE WHEN (k >> i::INT) & 1 = 1 AND (k >> j::INT) & 1 = 0 AND j < i AND i < n + m THEN 1 ELSE 0 END) AS u FROM orders, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY ALL),
  r AS (SELECT *, rank() OVER (PARTITION BY lsv_id, junc_idx ORDER BY psi) + (count(*) OVER (PARTITION BY lsv_id, junc_idx, psi) - 1) / 2.0 AS r FROM s0),
  u AS (SELECT lsv_id, junc_idx, count(*) FILTER (grp = 'A') AS n1, count(*) FILTER (grp = 'B') AS n2, coalesce(sum(r) FILTER (grp = 'A'), 0) - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0 AS u FROM r GROUP BY ALL),
  vs AS (SELECT lsv_id, junc_idx, psi, count(*) FILTER (grp = 'A') AS c1, count(*) FILTER (grp = 'B') AS c2 FROM s0 GROUP BY ALL),
  bs2 AS (SELECT lsv_id, junc_idx, sum(c1) OVER o AS a, sum(c2) OVER o AS b, sum(c1) OVER w AS n1, sum(c2) OVER w AS n2 FROM vs WINDOW w AS (PARTITION BY lsv_id, junc_idx), o AS (PARTITION BY lsv_id, junc_idx ORDER BY psi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  sc AS (SELECT lsv_id, junc_idx, n1, n2, least(min(least(a + n2 - b, n1 - a + b)), n1, n2) AS t, min(ent(a, b) + ent(n1 - a, n2 - b)) AS e FROM bs2 GROUP BY lsv_id, junc_idx, n1, n2),
  ranked AS (SELECT lsv_id, junc_idx, 'TNOM' AS stat, CASE WHEN count(k) = 0 THEN 1.0 ELSE count(k) FILTER (every.t <= sc.t) / CAST(count(k) AS DOUBLE) END AS p FROM sc LEFT JOIN every ON n = n1 AND m = n2 GROUP BY lsv_id, junc_idx
    UNION ALL SELECT lsv_id, junc_idx, 'INFOSCORE', CASE WHEN count(k) = 0 THEN 1.0 ELSE count(k) FILTER (every.e <= sc.e + 1e-8) / CAST(count(k) AS DOUBLE) END FROM sc LEFT JOIN every ON n = n1 AND m = n2 GROUP BY lsv_id, junc_idx
    UNION ALL SELECT lsv_id, junc_idx, 'WILCOXON', CASE WHEN count(k) = 0 THEN 1.0 ELSE least(1.0, 2.0 * count(k) FILTER (us.u <= floor(least(u.u, n1 * n2 - u.u))) / count(k)) END FROM u LEFT JOIN us ON n = n1 AND m = n2 GROUP BY lsv_id, junc_idx
    UNION ALL SELECT lsv_id, junc_idx, 'TTEST', p FROM ttest)"""


def entropy_sql(text: str) -> str:
    """text with ent(a, b) written out: a + b times the entropy of the shares."""
    term = lambda m: f"(CASE WHEN ({m[1]}) > 0 AND ({m[2]}) > 0 THEN -(({m[1]}) * ln(({m[1]}) / CAST(({m[1]}) + ({m[2]}) AS DOUBLE)) + ({m[2]}) * ln(({m[2]}) / CAST(({m[1]}) + ({m[2]}) AS DOUBLE))) ELSE 0 END)"
    return re.sub(r"ent\(((?:[^(),]|\([^()]*\))+), ((?:[^(),]|\([^()]*\))+)\)", term, text)


MEAN_SAMPLES_SQL = f"""{QUANTIFIABLE_SQL}, {V.LSV_CONNECTIONS_SQL},
  fe AS (SELECT c.experiment, c.lsv_id, junc_idx, rep, CAST(sum(CASE WHEN position % 5 <> rep THEN reads ELSE 0 END) AS DOUBLE) * 1.25 AS x FROM counts c JOIN ok USING (grp, experiment, lsv_id), (SELECT unnest(range(5)) AS rep) GROUP BY ALL),
  we AS (SELECT grp, experiment, lsv_id, junc_idx, rep, coalesce(x, 0) AS x FROM ok JOIN connections USING (lsv_id) CROSS JOIN (SELECT unnest(range(5)) AS rep) LEFT JOIN fe USING (experiment, lsv_id, junc_idx, rep)),
  ne AS (SELECT *, count(*) OVER (PARTITION BY experiment, lsv_id, rep) AS n, sum(x) OVER (PARTITION BY experiment, lsv_id, rep) AS total FROM we),
  s0 AS (SELECT grp, experiment, lsv_id, junc_idx, median((x + 1.0 / CAST(n AS DOUBLE)) / (total + 1.0)) AS psi FROM ne GROUP BY ALL)"""


@query(f"""{MEAN_SAMPLES_SQL}, {TTEST_SQL.format(samples="s0")}, {entropy_sql(RANK_TESTS_SQL)} SELECT lsv_id, junc_idx, stat, round(p, 6) AS p FROM ranked""")
def heterogen_mean_tests(spark, sf_dir):
    """The four tests of the experiments' posterior means: what heterogen_tests has without draws."""
    samples = Q.mean_samples_of(numbered_summary(spark, sf_dir, folds=5)).withColumn("psi", F.array("psi"))
    tested = S.tests_of_samples(samples, ["ALL"])
    return V.named(rounded(tested.select("lsv_id", "junc_idx", "stat", F.col("p_mean").alias("p")), "p"))


@query()
def sampled_histograms(spark, sf_dir):
    """By group and connection the histogram of draws, as many as keep its standard error under 0.01."""
    samples = Q.psi_samples(experiment_coverage(spark, sf_dir), samples=0, drawn=Q.least_samples(0.01, experiments=4))
    return Q.sampled_histograms(with_group(samples), ["grp", "lsv_id", "junc_idx"])


@query(f"{SUMMARY_SQL}, d AS (SELECT a.lsv_id, max(abs(b.median_psi - a.median_psi)) AS m FROM gs a JOIN gs b ON a.lsv_id = b.lsv_id AND a.junc_idx = b.junc_idx AND a.grp < b.grp GROUP BY ALL) SELECT lsv_id, round(any_value(m), 6) AS max_abs_dpsi, round(max(q75 - q25), 6) AS max_iqr, min(n) AS min_quantified FROM gs LEFT JOIN d USING (lsv_id) GROUP BY lsv_id")
def heterogen_index(spark, sf_dir):
    return V.named(rounded(S.heterogen_index(S.group_summary(sample_psi(spark, sf_dir, numbers=True))), "max_abs_dpsi", "max_iqr"))


def heterogen_list(g: str, c: str, name: str) -> str:
    value = f"CAST(coalesce({g}.{c}, 0) AS VARCHAR)" if c == "n" else f"coalesce(printf('%.4f', CAST(round(CAST(round({g}.{c}, 6) AS DECIMAL(18, 6)), 4) AS DOUBLE)), 'NA')"
    return f"string_agg({value}, ';' ORDER BY k.junc_idx) AS {g}_{name}"


@query(f"{SUMMARY_SQL}, k AS (SELECT DISTINCT lsv_id, junc_idx FROM gs) SELECT k.lsv_id, " + ", ".join(heterogen_list(g, c, n) for g in "ab" for c, n in (("median_psi", "median_psi"), ("q25", "percentile25_psi"), ("q75", "percentile75_psi"), ("n", "num_quantified"))) + " FROM k " + " ".join(f"LEFT JOIN gs {g} ON {g}.lsv_id = k.lsv_id AND {g}.junc_idx = k.junc_idx AND {g}.grp = '{g.upper()}'" for g in "ab") + " GROUP BY k.lsv_id")
def heterogen_rows(spark, sf_dir):
    return V.named(S.heterogen_rows(rounded(S.group_summary(sample_psi(spark, sf_dir, numbers=True)), "median_psi", "q25", "q75"), ["A", "B"]))
