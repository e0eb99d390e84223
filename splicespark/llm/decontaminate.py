"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

BASE = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"\w+")
BLOCK_BYTES = 16 << 20  # of benchmark text that is broadcast at once


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Running Karp-Rabin: the hash of each window of `length` ids, from one pass of running hashes (mod 2 ** 64)."""
    if len(ids) < length:
        return np.empty(0, np.uint64)
    found = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        found = found * BASE + (ids[k : k + len(found)].astype(np.uint64) + np.uint64(1))
    return found ^ found >> np.uint64(29)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length): the longest common run of tokens not yet marked, again and again.

    Seeds are equal windows of `least` tokens; seeds in a row on one diagonal are a maximal match. The longest match is
    marked first (of equal ones the first in the item, then in the doc). A match that marked tokens cut is put back as its
    unmarked pieces of `least` tokens or more, so what is marked next is again the longest one left.
    """
    a, b = window_hashes(doc, least), window_hashes(item, least)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    at_doc = np.repeat(np.arange(len(a)), n)
    at_item = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(at_doc) else at_doc
    same = np.ones(len(at_doc), bool)
    for k in range(least):
        same &= doc[at_doc + k] == item[at_item + k]
    at_doc, at_item = at_doc[same], at_item[same]
    by = np.lexsort((at_doc, at_doc - at_item))
    at_doc, at_item = at_doc[by], at_item[by]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at_doc) != 1) | (np.diff(at_doc - at_item) != 0)))) if len(at_doc) else at_doc
    length = np.diff(np.append(first, len(at_doc))) + least - 1
    heap = [(-int(n), int(at_item[i]), int(at_doc[i])) for i, n in zip(first, length)]
    heapq.heapify(heap)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found = []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = free_doc[i : i - n] & free_item[j : j - n]
        if free.all():
            free_doc[i : i - n] = free_item[j : j - n] = False
            found.append((i, j, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (int(s - e), j + int(s), i + int(s)))
    return found


class Block:
    """Some items of the benchmark, as ids of their tokens, and where each of their seeds stands."""

    def __init__(self, items: list[tuple], least: int):
        self.least, self.names = least, [name for name, _ in items]
        texts = [tokens_of(text) for _, text in items]
        self.ids = {t: k for k, t in enumerate(dict.fromkeys(t for text in texts for t in text))}
        self.items = [np.array([self.ids[t] for t in text], np.int64) for text in texts]
        # An item shorter than a seed is one seed of its own length.
        self.lengths = sorted({min(least, len(x)) for x in self.items if len(x)})
        self.seeds = {}
        for n in self.lengths:
            own = [(h, k, j) for k, x in enumerate(self.items) if len(x) and min(least, len(x)) == n for j, h in enumerate(window_hashes(x, n))]
            hashes = np.array([h for h, _, _ in own], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.seeds[n] = (hashes[order], np.array([(k, j) for _, k, j in own], np.int64)[order])

    def search(self, text: str | None, share: float) -> Iterator[tuple[int, int, int]]:
        """Items of which tiles cover `share` or more of the tokens: item's place, tokens covered, number of tiles."""
        get = self.ids.get
        doc = np.array([get(t, -1) for t in tokens_of(text)], np.int64)
        for n, (hashes, places) in self.seeds.items():
            own = window_hashes(doc, n)
            at = np.searchsorted(hashes, own)
            hit = own[(hashes[np.minimum(at, len(hashes) - 1)] == own)]
            if not len(hit):
                continue
            hit = np.unique(hit)
            lo, hi = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
            near = places[np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)])]
            for k in np.unique(near[:, 0]):
                item = self.items[k]
                could = np.zeros(len(item), bool)  # no tile reaches beyond the shared seeds
                for j in near[near[:, 0] == k, 1]:
                    could[j : j + n] = True
                if could.sum() >= share * len(item):
                    found = tiles(doc, item, n)
                    covered = sum(x[2] for x in found)
                    if covered >= share * len(item):
                        yield int(k), covered, len(found)


def blocks_of(benchmark: DataFrame, least: int) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_BYTES of text at most, each read to the driver when it is its turn."""
    items = written(benchmark.select("item_id", text_of().alias("text")))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        yield Block([(x.item_id, x.text) for x in rows.toLocalIterator()], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), coverage (the greatest) and tiles (of all matched items) for each document.

    An item is in a document when tiles cover `share` or more of its tokens, runs of letters and digits in lower case. The
    benchmark is broadcast in blocks of bounded size; every document is searched once for each block, whatever their
    number, and its row goes from block to block. A null or empty text matches nothing, nor does an item without tokens.
    Null and repeated doc_ids are documents of their own; repeated items are found once each. Other columns are ignored;
    with an empty benchmark no document is contaminated.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    found = docs.select("doc_id", "text", none.alias("item_ids"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("tiles"))
    for block in blocks_of(benchmark, least):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                ids, coverage, tiles_ = (batch.column(k).to_pylist() for k in (2, 3, 4))
                for i, text in enumerate(batch.column(1)):
                    for k, covered, n in own.search(text.as_py(), share):
                        ids[i] = [*ids[i], own.names[k]]
                        coverage[i] = max(coverage[i], covered / len(own.items[k]))
                        tiles_[i] += n
                columns = [batch.column(0), batch.column(1), pa.array(ids, batch.schema.field(2).type), pa.array(coverage, pa.float64()), pa.array(tiles_, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "item_ids", "coverage", "tiles"])

        found = found.mapInArrow(run, f"doc_id {doc_kind}, text string, item_ids array<{kind}>, coverage double, tiles long")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.sort_array("item_ids").alias("item_ids"), "coverage", "tiles")


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """The documents that no benchmark item contaminates, with their columns. Null and empty texts are clean; long texts are
    searched whole; repeated rows stay or go together; an empty table or benchmark changes nothing."""
    at = docs.columns.index("text")
    for block in blocks_of(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(sent.value.search(text.as_py(), share), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
