"""Suffix-array dedup: bytes of strings that occurred before, found by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import text_of, written

LENGTH = 100  # bytes of a repeated string
GRAM = 28  # bytes of an anchor
SPAN = LENGTH - GRAM + 1  # grams in a string; the least of them is its anchor
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
PLACE = 24  # low bits of an anchor's key that hold its place
SEGMENT = 1 << 23  # bytes of a text that are hashed at once; PLACE bits hold a place in it
CHUNK = 1 << 20  # bytes of contexts that are refined at once
HOT = 20_000  # contexts of an anchor from which on its strings are compared by themselves


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def doubled(h: np.ndarray, n: int, m: int, other: np.ndarray) -> np.ndarray:
    """Hashes of n + m bytes from those of n and, after them, of m bytes."""
    k = len(other) - n
    return h[:k] * power(m) + other[n:] if k > 0 else h[:0]


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each GRAM and each LENGTH bytes, as those of two strings in a row."""
    word = data.astype(np.uint64)
    h = word[:-3] | word[1:-2] << np.uint64(8) | word[2:-1] << np.uint64(16) | word[3:] << np.uint64(24)
    h = (h + np.uint64(1)) * FACTOR
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h4 = h ^ h >> np.uint64(29)
    h8 = doubled(h4, 4, 4, h4)
    h16 = doubled(h8, 8, 8, h8)
    h24 = doubled(h16, 16, 8, h8)
    gram = doubled(h24, 24, 4, h4)
    h32 = doubled(h16, 16, 16, h16)
    h64 = doubled(h32, 32, 32, h32)
    h96 = doubled(h64, 64, 32, h32)
    return gram, doubled(h96, 96, 4, h4)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(27)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's gram hash, context hash, place, and the first and last of the strings whose anchor it is.

    A string's anchor is the gram in it with the least hash (of equal ones the first), so equal strings have equal anchors
    at the same place in them. Strings of one anchor are neighbours; their union is its context. The first and the last
    string cover it, so their hashes and places identify it.
    """
    gram, whole = hashes(data)
    gram = finish(gram)
    low = np.uint64((1 << PLACE) - 1)
    least = gram & ~low | np.arange(len(gram), dtype=np.uint64)
    n = 1
    while 2 * n <= SPAN:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if SPAN > n:
        least = np.minimum(least[: len(least) - (SPAN - n)], least[SPAN - n :])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    context = finish(whole[first] + np.uint64(0x632BE59BD9B4E019) * whole[last]) + ((place - first) * 128 + (last - first)).astype(np.uint64)
    return gram[place], finish(context), place, first, last


def segments(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that share LENGTH - 1 bytes, so that each string is in one."""
    for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        yield at, data[at : at + SEGMENT + LENGTH - 1]


def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place and how far before it its first and last string begin, in one number that sorts by place."""
    return place << 14 | (place - first) << 7 | (place - last)


def strings_of(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last string's start of packed anchors."""
    place = pos >> 14
    return place - (pos >> 7 & 127), place - (pos & 127)


def parts_of(batch: pa.RecordBatch, most: int = 1 << 24) -> Iterator[tuple[list, list, list[bytes]]]:
    """The documents of a batch (doc, tie, text), some of them at a time, up to about `most` bytes."""
    docs, ties, texts, total = [], [], [], 0
    for doc, tie, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
        data = text.encode("utf-8", "surrogatepass")
        docs.append(doc), ties.append(tie), texts.append(data)
        total += len(data)
        if total > most:
            yield docs, ties, texts
            docs, ties, texts, total = [], [], [], 0
    if docs:
        yield docs, ties, texts


def batch_anchors(docs: list, ties: list, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The anchors of some documents, in order of gram, context, document and place, and which are the first of theirs."""
    found, owners = [], []
    for k, text in enumerate(texts):
        for at, part in segments(np.frombuffer(text, np.uint8)):
            if len(part) >= LENGTH:
                gram, context, place, first, last = anchors(part)
                found.append((gram, context, packed(at + place, at + first, at + last)))
                owners.append(np.full(len(gram), k))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    gram, context, pos = (np.concatenate(x) for x in zip(*found))
    owner = np.concatenate(owners)
    doc, tie = np.array(docs, np.int64)[owner], np.array(ties, np.int64)[owner]
    order = np.lexsort((pos, tie, doc, context, gram))
    gram, context, doc, tie, pos = (x[order] for x in (gram, context, doc, tie, pos))
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])))
    return gram.view(np.int64), context.view(np.int64), doc, tie, pos, new


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each gram and context the first anchor of a batch, and the other ones, repeats already, as ranges of bytes by
    document. Both come from one pass, so that they are of the same batches."""
    for batch in batches:
        for part in parts_of(batch):
            h, ctx, doc, tie, pos, new = batch_anchors(*part)
            first = [pa.array(c[new]) for c in (h, ctx, doc, tie, pos)]
            none = pa.nulls(int(new.sum()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*first, none, none], MARKED)
            # A repeated row of a document is that document: its anchors aren't after themselves.
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            own = ~new & ((doc != doc[head]) | (tie != tie[head]) | (pos != pos[head]))
            ranges = by_document(doc[own], tie[own], *strings_of(pos[own]))
            blank = pa.nulls(ranges.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, ranges["doc"], ranges["tie"], blank, ranges["starts"], ranges["ends"]], MARKED)


MARKED = ["h", "ctx", "doc", "tie", "pos", "starts", "ends"]


def by_document(doc: np.ndarray, tie: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Ranges of bytes that strings from `first` to `last` cover, merged and listed by document."""
    order = np.lexsort((first, tie, doc))
    doc, tie, start, end = doc[order], tie[order], first[order], last[order] + LENGTH
    if len(doc):
        head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
        group = np.cumsum(head)
        far = np.int64(1) << 40
        reach = np.maximum.accumulate(group * far + end) - group * far  # the furthest end so far in the document
        cut = head | np.concatenate(([True], start[1:] > reach[:-1]))
        at = np.flatnonzero(cut)
        start, end = start[at], reach[np.append(at[1:], len(reach)) - 1]
        first_of = np.flatnonzero(head[at])
        doc, tie = doc[at][first_of], tie[at][first_of]
        offsets = np.append(first_of, len(at))
    else:
        offsets = np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (start, end)]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), *lists], ["doc", "tie", "starts", "ends"])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each anchor's strings, for anchors whose gram has other contexts too."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, tie, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass")
            for x in found:
                place = x["pos"] >> 14
                first, last = place - (x["pos"] >> 7 & 127), place - (x["pos"] & 127)
                for column, value in zip(rows, (x["h"], x["hot"], doc, tie, first, data[first : last + LENGTH])):
                    column.append(value)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["h", "hot", "doc", "tie", "first", "data"])


def refined(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Buckets of the strings of LENGTH bytes that begin at each place: a number for each different string.

    data: bytes; inside: how many bytes from each place are in its context. First come buckets of 8 bytes. A bucket of n
    bytes is refined to 2 n by sorting on the bucket that stands n bytes later; the new buckets take the place of the old
    ones and refine the next pass, at last at the distance that makes LENGTH. Only places whose bucket has others are
    sorted on; one alone stays alone. New buckets aren't used within their own pass: a bucket of over LENGTH bytes would
    tell strings of LENGTH equal bytes apart.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.flatnonzero(inside >= 8).astype(np.int32)
    gram = np.zeros(len(at), np.uint64)
    for k in range(8):
        gram = gram << np.uint64(8) | padded[at + k]
    bucket = np.full(len(data), -1, np.int32)
    bucket[at] = np.unique(gram, return_inverse=True)[1]
    del gram
    length = 8
    while length < LENGTH:
        by = min(length, LENGTH - length)
        at = np.flatnonzero((inside >= length + by) & (bucket >= 0)).astype(np.int32)
        at = at[np.bincount(bucket[at], minlength=1)[bucket[at]] > 1]
        pairs = bucket[at].astype(np.int64) * len(data) + bucket[at + by]
        bucket = renumbered(bucket, at, np.unique(pairs, return_inverse=True)[1] if len(at) else at)
        length += by
    return bucket


def renumbered(bucket: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The new buckets: `numbers` at the places `at`, one of its own for each other place that has a bucket, else -1."""
    alone = bucket >= 0
    alone[at] = False
    found = np.full(len(bucket), -1, np.int32)
    found[at] = numbers
    found[alone] = np.arange(alone.sum()) + (int(numbers.max()) + 1 if len(numbers) else 0)
    return found


def repeats_of(chunk: pa.Table) -> pa.RecordBatch:
    """Ranges of the strings that stand in an earlier context (or earlier in it) of the chunk too."""
    doc, tie, first = (chunk[k].to_numpy() for k in ("doc", "tie", "first"))
    texts = chunk["data"].to_pylist()
    order = np.lexsort((first, tie, doc))
    doc, tie, first = doc[order], tie[order], first[order]
    sizes = np.array([len(texts[k]) for k in order])
    data = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = refined(data, ends[owner] - np.arange(len(data)))
    at = np.flatnonzero(ends[owner] - np.arange(len(data)) >= LENGTH)
    _, head, which = np.unique(bucket[at], return_index=True, return_inverse=True)
    own = at[head[which] != np.arange(len(at))]  # places are in order of document and start
    start = first[owner[own]] + own - (ends - sizes)[owner[own]]
    return by_document(doc[owner[own]], tie[owner[own]], start, start)


def refine_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; grams' groups are refined whole, some at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.nbytes for b in waiting) > CHUNK:
            whole = pa.Table.from_batches(waiting)
            h = whole["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on
            if cut:
                yield from in_chunks(whole.slice(0, cut))
                waiting = whole.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield from in_chunks(pa.Table.from_batches(waiting))


def in_chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h = rows["h"].to_numpy()
    at, step = 0, max(1, CHUNK // 160)
    while at < len(h):
        end = len(h) if at + step >= len(h) else max(int(np.searchsorted(h, h[at + step], "left")), int(np.searchsorted(h, h[at], "right")))
        yield repeats_of(rows.slice(at, end - at))
        at = end


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results from texts and their ranges."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for text, starts, ends in zip(*(c.to_pylist() for c in batch.columns[1:])):
            data = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for s, e in sorted(zip(starts or (), ends or ())):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
            for column, value in zip(rows, (len(data), len(data) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


KEY = ["doc", "tie"]
RANGES = "doc long, tie long, starts array<long>, ends array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie, text, doc_id: doc orders the documents, tie those of equal or null doc_id."""
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    unique = ids.filter("n > 1 or doc_id is null").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.xxhash64(text_of())
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), tie.alias("tie"), text_of().alias("text"), "doc_id")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans ([start, end) of the removed runs), kept (bytes) and kept_sha256.

    A byte goes when a string of LENGTH bytes that covers it also starts earlier, in a document before this one or earlier
    in this one. Strings are sampled by anchors (see anchors()), which equal strings share, so only the anchors are
    shuffled. 1. Of anchors with equal gram and context all but the first are repeats: by batch, before the shuffle, then
    over all. 2. The first ones of grams with several contexts are compared string by string: their contexts are brought
    together by gram and refined (see refined()). Where a gram has over HOT contexts, its strings are grouped one by one
    instead, so that no task gets them all.

    Null texts are empty; texts under LENGTH bytes keep all. Of equal or null doc_ids (null comes first) the text's hash
    decides which is before; rows equal in both are one document, whose result is repeated. Other columns are ignored; an
    empty table gives no rows.
    """
    texts = keyed(docs)
    own = texts.select("doc", "tie", "text")
    seen = written(own.mapInArrow(marked, "h long, ctx long, doc long, tie long, pos long, starts array<long>, ends array<long>"))
    found = seen.filter("h is not null").drop("starts", "ends").repartition("h")
    anchor = F.struct("doc", "tie", "pos")
    same, gram = W.partitionBy("h", "ctx"), W.partitionBy("h")
    ranked = found.withColumns({"first": F.min(anchor).over(same), "low": F.min("ctx").over(gram), "high": F.max("ctx").over(gram), "n": F.count(F.lit(1)).over(gram)})
    later = F.col("first") != anchor
    flagged = ranked.filter(later | (F.col("low") != F.col("high"))).select("doc", "tie", "pos", F.when(~later, F.col("h")).alias("h"), (~later & (F.col("n") > HOT)).alias("hot"))
    flagged = written(flagged)

    placed = own.repartition(*KEY)
    open_anchors = flagged.filter("h is not null").groupBy(*KEY).agg(F.collect_list(F.struct("pos", "h", "hot")).alias("found"))
    strings = placed.join(open_anchors, KEY).select("doc", "tie", "text", "found").mapInArrow(contexts, "h long, hot boolean, doc long, tie long, first long, data binary")
    strings = written(strings)
    compared = strings.filter("not hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(refine_groups, RANGES)
    each = strings.filter("hot").select("doc", "tie", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("data") - (LENGTH - 1)), lambda i: F.expr("data").substr(i, F.lit(LENGTH)))).alias("k", "data"), "first")
    each = each.select("data", "doc", "tie", (F.col("first") + F.col("k")).alias("start"))
    least = each.groupBy("data").agg(F.min(F.struct("doc", "tie", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = each.join(least, "data").filter(F.col("least") != F.struct("doc", "tie", "start"))
    one = lambda d, s, e: d.select("doc", "tie", F.array(s).alias("starts"), F.array(e).alias("ends"))
    place = F.shiftright("pos", 14)
    plain = one(flagged.filter("h is null"), place - F.shiftright("pos", 7).bitwiseAND(127), place - F.col("pos").bitwiseAND(127) + LENGTH)
    ranges = plain.unionByName(seen.filter("h is null").select(*KEY, "starts", "ends")).unionByName(compared).unionByName(one(hot, F.col("start"), F.col("start") + LENGTH))
    listed = ranges.groupBy(*KEY).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = texts.join(listed, KEY, "left").select("doc_id", "text", "starts", "ends")
    return whole.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string")
