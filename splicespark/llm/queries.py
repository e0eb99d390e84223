"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, lm_score, mixing, quality, secrets, simhash, suffix_dedup, token_alignment, token_counts, url_filter, vector_codes
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.bits_as_text().alias("fingerprint"), "component_id", "n_same")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("found").alias("spans"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), fields=("source", "lang", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return vector_codes.label_errors(coded).select("vec_id", code, "error", "label_error", F.lit(vector_codes.book_digest(book)).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """op11 in SQL: a round is a table of the parts' nearest entries (least distance * entries + index) and one of means."""
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}) USING (r))",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min({distance} * {entries} + e) AS best FROM v JOIN b{k} b USING (p) GROUP BY r, p)")
        if k < rounds:
            steps.append(
                f"""s{k} AS MATERIALIZED (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, best % {entries} AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM a{k} JOIN v USING (r, p)) GROUP BY p, e, i),
  m{k} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e),
  b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
            )
    return ",\n  ".join(steps) + f""",
  coded AS (SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS INT)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS c FROM b{rounds})) AS codebooks_sha256 FROM coded JOIN kept USING (r)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash_links, op3_html_extract, op4_lm_score, op5_secret_scan, op6_string_tiling, op7_url_filter, op8_source_mix, op9_token_counts, op10_quality_rules, op11_vector_codes, op12_token_alignment, op13_language_id)}
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op10_quality_rules": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  p AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
  t AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n FROM p),
  n AS (SELECT r, count(DISTINCT i + k.k) AS n_repeat_words FROM t, (SELECT unnest(range(5)) AS k) k WHERE n > 1 GROUP BY r),
  u AS (SELECT DISTINCT source, text, ls FROM w),
  l AS (SELECT DISTINCT source, text, lower(trim(regexp_replace(unnest(ls), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM u),
  f AS (SELECT source, line FROM l GROUP BY source, line HAVING count(*) > 10),
  x AS (SELECT r, source, unnest(ls) AS line FROM w),
  g AS (SELECT r, sum(len(regexp_extract_all(x.line, '[^\x20\x09-\x0D]+'))) AS lost FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND lower(trim(regexp_replace(x.line, '[\x20\x09-\x0D]+', ' ', 'g'))) = f.line GROUP BY r),
  b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN n USING (r) LEFT JOIN g USING (r))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (lost > 0 AND (n_words - lost < 10 OR n_words - lost < 0.3 * n_words)) AS kept FROM b""",
}
