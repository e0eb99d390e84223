"""SimHash near-dedup: fingerprints of word shingles, linked by a binary-trie self-join under a Hamming budget."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import narrowed, written
from .graph import components

SEED = 42
GROUP = 50_000  # fingerprints in a trie that one task joins; larger ones are split along the trie
SPLIT_BITS = 8
BLOCK_ROWS = 256  # rows of a component whose shingles are counted together
BAND_ROWS = 32  # texts with one band's sample that are all compared; those of larger sets meet by their rarest shingles


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text in ASCII lower case, repeats included; the whole sequence if it is shorter."""
    import xxhash

    found = (text or "").encode().lower().split()  # splits at ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) > words else (b" ".join(found),)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def sampled(hashes: np.ndarray, bands: int, per: int) -> tuple[np.ndarray, bytes]:
    """For each band the SimHash of `per` shingles, each the least under a hash function of its own; and a byte of each of
    these shingles' hashes: the share of equal bytes of two texts estimates their Jaccard similarity."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, bands * per, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, bands * per, dtype=np.uint64)
    least = np.full(bands * per, np.iinfo(np.uint64).max)
    hashes = np.unique(hashes)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * factor
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15) + offset).min(0))
    bits = np.unpackbits(least.astype(">u8").view(np.uint8).reshape(bands, per, 8), axis=2).sum(1)
    return np.packbits(bits * 2 > per, axis=1).view(">u8")[:, 0].astype(np.int64), least.astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, key: str, words: int, bands: int = 0, per: int = 0) -> DataFrame:
    """key, fp (the 64 bits as a long; 0 without words) and, for bands > 0, `bands` and `sketch`: see sampled(), and
    `digest` of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(np.array([majority(h) for h in each], np.uint64).view(np.int64))]
            if bands:
                found = [sampled(h, bands, per) if len(h) else ((), b"") for h in each]
                digests = [hashlib.blake2b(np.unique(h).tobytes(), digest_size=16).digest() for h in each]
                columns += [pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [key, "fp", "bands", "sketch", "digest"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp long" + ", bands array<long>, sketch binary, digest binary" * bool(bands))


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of values within `budget` bits, for each of the ranges of sorted, distinct 64-bit values.

    A range is the root of a binary trie; a node is the range of the values with its prefix. Pairs of nodes go down
    together, bit by bit, from (root, root): equal bits keep the pair's sum of differing bits, unequal ones add one, and
    pairs over the budget end. All pairs of one depth are one step.
    """
    a0, a1, b0, b1, bits = starts, ends, starts, ends, np.zeros(len(starts), np.int8)
    for depth in range(64):
        ones = np.concatenate(([0], np.cumsum(values >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int64)))
        cut_a, cut_b = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0  # the two nodes differ, so both crossings count
        sides = [(a0, cut_a, b0, cut_b, bits), (cut_a, a1, cut_b, b1, bits), (a0, cut_a, cut_b, b1, bits + 1), tuple(x[other] for x in (cut_a, a1, b0, cut_b, bits + 1))]
        a0, a1, b0, b1, bits = (np.concatenate(x) for x in zip(*sides))
        live = (a0 < a1) & (b0 < b1) & (bits <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, bits = (x[live] for x in (a0, a1, b0, b1, bits))
    return a0, b0


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs connect it with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined_tries(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each group of a partition, as fp and the first fp of its connected set there."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    group, shift = whole["group"].to_numpy(), whole["shift"].to_numpy().astype(np.uint64)
    turned = whole["turned"].to_numpy().view(np.uint64)
    order = np.lexsort((turned, shift, group))
    group, shift, turned = group[order], shift[order], turned[order]
    starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (shift[1:] != shift[:-1]))))
    ends = np.append(starts[1:], len(group))
    fp = (turned >> shift | turned << (np.uint64(64) - shift & np.uint64(63))).view(np.int64)
    chunk = np.searchsorted(ends, np.arange(0, ends[-1], 4 * GROUP))  # whole groups, about 4 * GROUP values at once
    for i, j in zip(chunk, np.append(chunk[1:], len(starts))):
        if i < j:
            lo, hi = starts[i], ends[j - 1]
            a, b = trie_pairs(turned[lo:hi], starts[i:j] - lo, ends[i:j] - lo, budget)
            label = stars(hi - lo, a, b)
            own = np.flatnonzero(label != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(fp[lo + own]), pa.array(fp[lo + label[own]])], ["a", "b"])


def mask(bits: int) -> int:
    """The top bits of 64, as a signed long."""
    value = ((1 << bits) - 1) << (64 - bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def near_fingerprints(distinct: DataFrame, budget: int) -> DataFrame:
    """Edges a, b that connect distinct fingerprints (column fp) within `budget` differing bits.

    Two such fingerprints agree in one of budget + 1 blocks of bits. Each fingerprint is turned so that a block comes
    first and joins the trie of those with this block, once for each block. A trie with over GROUP fingerprints is split:
    node pairs some bits further down, up to the budget apart, are groups of their own, until all are small or the bits
    end. Tasks give stars instead of all pairs, which connect the same fingerprints.
    """
    blocks = budget + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def turned(k: int) -> Column:
        s = edges[k]
        return F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")

    each = F.explode(F.array(*(F.struct(F.lit(edges[k]).alias("shift"), turned(k).alias("turned"), turned(k).bitwiseAND(F.lit(mask(edges[k + 1] - edges[k]))).alias("p"), F.lit(edges[k + 1] - edges[k]).alias("depth")) for k in range(blocks))))
    groups = written(distinct.select(each.alias("x")).select("x.*").withColumn("q", F.col("p")))
    node = ["shift", "p", "q", "depth"]
    pair = lambda d: d.withColumns({"p": F.least("p", "q"), "q": F.greatest("p", "q")})
    done = []
    while True:
        sizes = groups.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        groups = written(groups.join(sizes, node))
        done.append(groups.filter((F.col("n") <= GROUP) | (F.col("depth") >= 64)))
        large = groups.filter((F.col("n") > GROUP) & (F.col("depth") < 64))
        if large.isEmpty():
            break
        masks = F.array(*(F.lit(m).cast("long") for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget))
        step = F.least(F.lit(SPLIT_BITS), 64 - F.col("depth"))
        depth = F.col("depth") + step
        left = lambda value, bits: F.call_function("shiftleft", value, bits.cast("int"))
        one, ones = F.lit(1).cast("long"), F.lit(-1).cast("long")
        inside = F.when(depth < 64, left(ones, 64 - depth)).otherwise(ones)
        mine = F.col("turned").bitwiseAND(left(ones, 64 - F.col("depth")))
        there = F.when(mine == F.col("p"), F.col("q")).otherwise(F.col("p"))
        kept = F.filter(masks, lambda m: (m < left(one, step)) & (F.bit_count(m) + F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= budget))
        moved = large.select("shift", "turned", inside.alias("inside"), mine.alias("mine"), there.alias("there"), depth.alias("below"), F.explode(kept).alias("m"))
        child = F.col("turned").bitwiseAND(F.col("inside"))
        far = F.col("there").bitwiseOR(child.bitwiseXOR(F.col("mine")).bitwiseXOR(left(F.col("m"), 64 - F.col("below"))))
        groups = written(pair(moved.select("shift", "turned", child.alias("p"), far.alias("q"), F.col("below").alias("depth"))))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    keyed = found.select(F.xxhash64(*node).alias("group"), "shift", "turned").repartition("group")
    return keyed.mapInArrow(lambda batches: joined_tries(batches, budget), "a long, b long")


def linked(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) and n_same (documents of this fingerprint).

    Documents of equal fingerprints are one node; nodes within `budget` bits are linked. A null or empty text has
    fingerprint 0 and links like any other. Repeated doc_ids are documents of their own; a null doc_id is nobody's
    smallest unless all are null. Other columns are ignored; an empty table gives no rows.
    """
    marked = written(fingerprints(docs, "doc_id", words))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")))
    labels = components(near_fingerprints(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    whole = nodes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    known = whole.join(smallest, "component").select("fp", "n_same", "component_id")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id", "n_same")


def alike(edges: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The edges a, b whose texts' sketches (_row, sketch) are equal in `least` of their bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)) if batch.num_rows else (np.zeros((0, 1)),) * 2
            near = pa.array((one == two).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    end = lambda side: sketches.select(F.col("_row").alias(side), F.col("sketch").alias(f"s{side}"))
    return edges.join(end("a"), "a").join(end("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, rows: DataFrame, key: Column, words: int) -> DataFrame:
    """_row and `set`, the distinct shingles' hashes, of the rows (_row, doc_id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_row", "set"])

    wanted = rows.select("_row", F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    texts = docs.select("doc_id", "text", key.alias("_k")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")))
    found = texts.select("_row", "text").mapInArrow(run, "_row long, set array<long>")
    return written(found.groupBy("_row").agg(F.first("set").alias("set")))


def in_blocks(sets: DataFrame) -> DataFrame:
    """sets with salt: with component it names a block of about BLOCK_ROWS rows of one component at most."""
    sizes = written(sets.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")))
    return sets.join(sizes, "component").select("_row", "component", "set", F.pmod(F.xxhash64("_row"), F.col("blocks")).alias("salt"))


def rarest_shingles(blocked: DataFrame) -> DataFrame:
    """_row, component, n, h, place: of each set of n shingles the first n - ceil(4n / 5) + 1, rarest first, that another set
    has too; place counts from 1. blocked: of in_blocks().

    Rows of a component are alike, so a block has few distinct shingles for its rows; these, with their counts in the block,
    are what is shuffled, to be added up and to come back, and of the sets only the first shingles are rows.
    """

    def distinct(key: tuple, block: pa.Table) -> pa.Table:
        shingles, n = np.unique(block["set"].combine_chunks().flatten().to_numpy(), return_counts=True)
        return pa.table({"component": np.full(len(n), key[0].as_py()), "salt": np.full(len(n), key[1].as_py()), "h": shingles, "n": n})

    def first(block: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["h"].to_numpy(), kind="stable")
        shingles, count = known["h"].to_numpy()[order], known["c"].to_numpy()[order]
        rows: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
        for row, component, own in zip(block["_row"].to_pylist(), block["component"].to_pylist(), block["set"]):
            h = own.values.to_numpy()
            at = np.minimum(np.searchsorted(shingles, h), max(0, len(shingles) - 1))
            c = np.where(shingles[at] == h, count[at], 1) if len(shingles) else np.ones(len(h), np.int64)
            by = np.lexsort((h, c))[: len(h) - (4 * len(h) + 4) // 5 + 1]
            place = np.flatnonzero(c[by] > 1)
            rows.append([np.full(len(place), row), np.full(len(place), component), np.full(len(place), len(h)), h[by][place], place + 1])
        return pa.table(dict(zip(("_row", "component", "n", "h", "place"), map(np.concatenate, zip(*rows)))))

    by_block = blocked.groupBy("component", "salt")
    partial = written(by_block.applyInArrow(distinct, "component long, salt long, h long, n long"))
    counts = written(partial.groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1"))
    known = partial.join(counts, "h").select("component", "salt", "h", "c")
    return by_block.cogroup(known.groupBy("component", "salt")).applyInArrow(first, "_row long, component long, n long, h long, place long")


def rarest_meet(sets: DataFrame) -> DataFrame:
    """Pairs a, b of the rows of sets with every pair of Jaccard similarity 0.8 or more among them that isn't in one
    `component` already.

    With the shingles of all in one order, rarest first, such a pair shares one of the first n - ceil(4n / 5) + 1 of the
    larger set and one of the first m - ceil(8m / 9) + 1 of the smaller. A passage in many texts comes last in this order.
    """
    first = written(rarest_shingles(written(in_blocks(sets))))
    mixed = first.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("h")
    first = first.join(mixed, "h")
    large = first.select(F.col("_row").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), "h")
    small = first.filter("place <= n - (8 * n + 8) div 9 + 1").select(F.col("_row").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), "h")
    return large.join(small, "h").filter("ca <> cb and (nb < na or nb = na and b < a) and 5 * nb >= 4 * na").select("a", "b").distinct()


def similar(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges a, b whose sets' Jaccard similarity is 0.8 or more."""
    end = lambda side: sets.select(F.col("_row").alias(side), F.col("set").alias(f"s{side}"))
    both = edges.join(end("a"), "a").join(end("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.filter(5 * F.col("both") >= 4 * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def bits_as_text(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, words: int = 5, budget: int = 2, bands: int = 32, per: int = 8, least: float = 0.5) -> DataFrame:
    """The documents, less those that have a near copy with a smaller doc_id (null last): one of each group stays.

    Near copies have a Jaccard similarity of 0.8 or more of their sets of five-word shingles; groups are the connected
    components of such pairs. Texts of equal sets are one node. Candidates are nodes within `budget` bits of the
    fingerprints of whole texts, and nodes that share one of `bands` fingerprints of `per` min-wise sampled shingles: a
    pair of similarity s shares one with probability 1 - (1 - s ** per) ** bands, which is 0.997 at 0.8. In bands of over
    BAND_ROWS nodes each is compared with the first; bands whose nodes these links leave in several components go to
    rarest_meet(), which misses no pair. Candidates whose sketches agree in under `least` are far from 0.8; the sets of
    the others are compared. Repeated rows are copies; null and empty texts are copies of each other and of texts without
    words; long texts are compared whole; an empty table stays empty.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    named = docs.select(F.struct("doc_id", key.alias("key")).alias("_id"), "text")
    marked = written(fingerprints(named, "_id", words, bands, per).select("_id.*", "fp", "bands", "sketch", "digest").withColumn("_row", F.monotonically_increasing_id()))
    firsts = written(marked.groupBy("digest").agg(F.min("_row").alias("first")))
    edges = marked.join(firsts, "digest").select(F.col("_row").alias("a"), F.col("first").alias("b"))
    alone = written(marked.join(firsts.select(F.col("first").alias("_row")), "_row", "left_semi").filter(F.size("bands") > 0))
    nodes = written(alone.groupBy("fp").agg(F.min("_row").alias("first")))
    close = near_fingerprints(nodes.select("fp"), budget)
    ends = lambda side: nodes.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))
    met = close.join(ends("a"), "a").join(ends("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    met = met.unionByName(alone.join(nodes, "fp").select(F.col("_row").alias("a"), F.col("first").alias("b")))
    banded = alone.select("_row", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    banded = written(banded.join(shared, ["band", "value"]))
    few = banded.filter(F.col("n") <= BAND_ROWS).groupBy("band", "value").agg(F.collect_list("_row").alias("rows"))
    pairs = few.select("rows", F.explode("rows").alias("a")).select("a", F.explode(F.filter("rows", lambda x: x < F.col("a"))).alias("b"))
    met = met.unionByName(pairs)
    many = banded.filter(F.col("n") > BAND_ROWS)
    star = many.groupBy("band", "value").agg(F.min("_row").alias("b"))
    met = met.unionByName(many.join(star, ["band", "value"]).select(F.col("_row").alias("a"), "b"))
    identity = alone.select("_row", "doc_id", "key")

    def verified(met: DataFrame) -> DataFrame:
        met = met.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        near = written(alike(met, alone.select("_row", "sketch"), least))
        wanted = near.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
        return written(similar(near, shingle_sets(docs, identity.join(wanted, "_row"), key, words)))

    links = verified(met)
    known = written(components(links).withColumnRenamed("node", "_row"))
    labelled = written(many.join(known, "_row", "left").select("band", "value", "_row", F.coalesce("component", "_row").alias("component")))
    apart = labelled.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", "value")
    rows = written(labelled.join(apart, ["band", "value"]).select("_row").distinct())
    if not rows.isEmpty():
        sets = shingle_sets(docs, identity.join(rows, "_row"), key, words).join(known, "_row", "left")
        links = links.unionByName(verified(rarest_meet(sets.withColumn("component", F.coalesce("component", "_row")))))
    edges = edges.unionByName(links)
    labels = components(edges.filter("a <> b").distinct())
    grouped = written(marked.select("_row", "doc_id", "key").join(labels, F.col("_row") == F.col("node")))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("_row").alias("_row"))
    stay = grouped.groupBy("component").agg(F.min(order).alias("o")).select("o._row")
    gone = grouped.join(stay, "_row", "left_anti").groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_gone"))
    # Rows of equal doc_id and text are copies: as many of them go as the table says, which is all but one at least.
    # The table grows with the input, so it is never broadcast: the plan is the same at every size.
    gone = written(gone).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key"))
    keyed = narrowed(docs, "doc_id", "text", whole=True).select("row", "doc_id", key.alias("_k"))
    repeated = marked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return keyed.join(gone, same, "left_anti").select("row.*")
    rank = F.row_number().over(W.partitionBy("doc_id", "_k").orderBy("_k"))
    return keyed.join(gone, same, "left").withColumn("_rank", rank).filter("_rank > coalesce(_gone, 0)").select("row.*")
