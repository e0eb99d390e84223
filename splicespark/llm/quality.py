"""Quality rules: in-document counts and cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, narrowed, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5


def words_in_repeats(words: Column) -> Column:
    """Words in windows of REPEAT_WORDS words that are found twice or more.

    The hashes of the windows are sorted with their places only where some are equal; the union of the equal windows'
    places is then one pass.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (REPEAT_WORDS - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(REPEAT_WORDS))))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        places = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT_WORDS).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(REPEAT_WORDS), i - a["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(F.array_sort(places), start, step, lambda a: a["n"])

    zero = F.lit(0).cast("long")
    some = let(let(hashed, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(zero))
    return F.when(F.size(words) >= REPEAT_WORDS, some).otherwise(zero)


def lines_of(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, `_text` (null: empty) and `_lines`, its lines with a word."""
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(*columns, text_of().alias("_text")).withColumn("_lines", lines)


def base_rules(docs: DataFrame, *more: Column | str) -> DataFrame:
    """The base counts and base_failed of each document; more: further expressions over docs' columns and `_lines`."""
    text = text_of("_text")
    rows = lines_of(docs, "*").select("*", words_of(text).alias("_words"))
    counted = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("_words")).alias("n_repeat_words"),
        *more,
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """Of the line in lower case, white space as single spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def judge(docs: DataFrame, limit: int = 10, left_words: int = 10, left_share: float = 0.3, whole: bool = False) -> DataFrame:
    """The base counts, n_frequent_words (words in frequent lines), kept and `text` without frequent lines, by document.

    A host is a `source` (null is a host). A line, normalised and hashed, is frequent on a host when over `limit` of its
    documents have it, however many these are; documents of equal text count once, so that copies, which are for
    deduplication, don't make their own lines frequent. A document is rejected when it fails the base rules, or when
    without its frequent lines it has under `left_words` words or under `left_share` of its words.

    The base counts are of the whole text. What is left of a text keeps its other lines, empty ones too, as they are; a
    text without frequent lines, or null, is as before.

    Null texts count as empty and fail. Null and repeated doc_ids are documents of their own. An empty table gives no
    rows; long texts are counted whole. Other columns are ignored, unless `whole` asks for the row of docs in the struct
    `row`.
    """
    docs = narrowed(docs, "doc_id", "text", "source", whole=whole)
    full = text_of()
    key = F.struct(F.xxhash64(full).alias("a"), F.hash(full).alias("b"), F.length(full).alias("n"))
    parts = lines_of(docs, F.col("source"), key.alias("_key"))
    texts = written(parts.select("source", "_key", F.array_distinct(F.transform("_lines", line_hash)).alias("h")).dropDuplicates(["source", "_key"]))
    lines = texts.select("source", "_key", F.explode("h").alias("h"))
    # Written, so that in the join both sides are shuffled and a line in very many documents can be split.
    often = written(lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col("source").alias("_host"), F.col("h").alias("_h")))
    hits = lines.join(often, lines.source.eqNullSafe(often._host) & (lines.h == often._h))
    listed = written(hits.groupBy(F.col("source").alias("_host"), F.col("_key").alias("_text_key")).agg(F.collect_set("h").alias("_frequent")))

    own = docs.join(listed, docs.source.eqNullSafe(listed._host) & (key == listed._text_key), "left").select(docs["*"], "_frequent")
    hit = lambda x: F.coalesce(F.array_contains("_frequent", line_hash(x)), F.lit(False))
    words = F.aggregate(F.filter("_lines", hit), F.lit(0).cast("long"), lambda a, x: a + F.size(words_of(x)))
    lost = F.when(F.col("_frequent").isNull(), F.lit(0).cast("long")).otherwise(words)
    rest = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & hit(x))), "\n")
    text = F.when(F.col("_frequent").isNull(), F.col("text")).otherwise(F.when(F.col("text").isNotNull(), rest))
    counted = base_rules(own, lost.alias("n_frequent_words"), text.alias("text"), *(["row"] if whole else []))
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (F.col("n_frequent_words") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return counted.withColumn("kept", ~F.col("base_failed") & ~depleted)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns, `text` without frequent lines; see judge() for null, empty and
    long texts, null and repeated doc_ids and the empty table. Documents without a word are rejected."""
    kept = judge(docs, whole=True, **options).filter("kept")
    return kept.select(*(F.col("text") if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns))
