"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import running_sums, text_of, words_of, written

BUCKET_DOCUMENTS = 5_000


def document_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and size, the number of words of the text (null: 0)."""
    return docs.select(*more, "doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """For each source its documents, size, weight and target.

    Sources in code point order, null last, take the weights in turn. They share `share` times the total size by weight;
    a target stops at `most` times the size of its source and the excess goes to the others by weight. With the sources
    in order of cap / weight those at their cap come first, so running sums of caps and weights give the level at once.
    A source without words has target 0.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_documents"), F.sum("size").alias("source_size"))
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most})
    summed = running_sums(weighed, [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()], {"caps": F.col("cap"), "weights": F.col("weight")})
    summed = written(summed)
    total = summed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # What is left, and for which weight, when all sources before this one are at their caps.
    left = F.col("all_size") * share - (F.col("caps") - F.col("cap"))
    rest = F.col("all_weight") - (F.col("weights") - F.col("weight"))
    # One row each: the totals, and where the first source under its cap stands.
    flagged = summed.crossJoin(F.broadcast(total)).withColumn("under", F.col("cap") * rest > F.col("weight") * left)
    level = flagged.filter("under").agg(F.min_by(F.struct(left.alias("left"), rest.alias("rest")), F.col("weights")).alias("first"))
    return flagged.crossJoin(F.broadcast(level)).select(
        "source", "source_documents", "source_size", "weight",
        F.when(F.col("under"), F.col("weight") * F.col("first.left") / F.col("first.rest")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def offset_of(seed: int) -> Column:
    """One number in [0, 1) for each source."""
    return (F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, whole: bool = False) -> DataFrame:
    """Copies that the mix takes of each document: doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is expected target / source_size times. The expected copies are summed up in an order of
    the source's documents, one offset for each source is added, and a document is taken once for each integer that the
    sum passes at it. So every document is taken the floor or the ceiling of its expected copies, never more than `most`
    times. The order is by hash bucket and, in a bucket, by size, so that neighbours are alike and the words taken come
    near the target. Buckets hold about BUCKET_DOCUMENTS documents whatever the source's size: a source's running sum is
    that of its buckets' counts plus the rank in the bucket, and no task gets a whole source.

    Null texts have size 0; a null source is a source, the last. Null and repeated doc_ids are documents of their own;
    equal rows are interchangeable. An empty table gives no rows. Other columns are ignored, unless
    `whole` asks for the row of docs too, in the struct `row`. Reruns agree.
    """
    sizes = written(document_sizes(docs))
    targets = written(source_targets(sizes, weights, share, most))
    buckets = F.ceil(F.col("source_documents") / BUCKET_DOCUMENTS)

    def placed(rows: DataFrame) -> DataFrame:
        named = targets.withColumnRenamed("source", "_of")
        return rows.join(named, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), buckets)).drop("_of", "weight", "source_documents")

    counts = placed(sizes).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), earlier.alias("start"))
    rows = placed(document_sizes(docs, F.expr("struct(*)").alias("row")) if whole else sizes)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "bucket").orderBy(F.desc("size"), "doc_id")))
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank * expected + offset_of(seed))
    copies = upto(F.col("start") + F.col("rank")) - upto(F.col("start") + F.col("rank") - 1)
    found = ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["row"] if whole else []))
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their columns and `copies`, how often each is taken (once at least); a column
    `copies` of docs is replaced. Null and empty texts have size 0 and aren't taken; long texts, null and repeated doc_ids
    are documents like any other, ties go by doc_id and size as in mix(); an empty table gives no rows."""
    taken = mix(docs.drop("copies"), whole=True, **options).filter("copies > 0")
    return taken.select("row.*", "copies")
