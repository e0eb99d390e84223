"""Cross-tokenizer alignment: two tokenizations of every text, cut where tokens of both end, and which tokens end together."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20  # bytes of text that are aligned at a time; a longer text is a chunk of its own
ROW = 100  # bytes that a text's figures count for, so that empty texts fill chunks too
RUN, SHORT = 8192, 32  # words that the first and the second tokenizer encode together
SPACE = "▁"  # stands for a space in the second vocabulary


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest in
    order from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Both tokenizers; `bytes` and `sizes` of their entries; `names`: texts of entries with what follows them in a digest.

    The first vocabulary's merges are in the order of its ids, so its entries' ids are the ranks that an encoder of ranks
    takes; special tokens aren't among them, so that their strings are ordinary text.
    """

    def __init__(self, first: str, second: str):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(first, encoding="utf-8") as file:
            model = json.load(file)
        special, table = {t["content"] for t in model["added_tokens"] if t["special"]}, byte_table()
        ranks = {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=second)
        n_a, self.n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        found_a = [b""] * n_a
        for token, i in ranks.items():
            found_a[i] = token
        pieces = self.b.id_to_piece(list(range(self.n_b)))
        found_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = tuple(pa.array(x, pa.large_binary()) for x in (found_a, found_b))
        self.sizes = tuple(np.array([len(x) for x in found], np.int64) for found in (found_a, found_b))
        self.names = pa.array([f"{i}{c}" for i in range(n_a) for c in ",|"] + [f"{i}{c}" for i in range(self.n_b) for c in (",", ";", "")], pa.large_string())
        self.after_a = 2 * n_a
        self.blank = self.b.piece_to_id(SPACE)

    def first(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def second(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that begin with a space, which the tokenizer adds."""
        return [np.array(x or [self.blank], np.int32) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def encoded(self, words: pa.LargeStringArray) -> tuple[np.ndarray, list[pa.LargeListArray]]:
        """The ids of each word, which begins with a space, in both vocabularies, and the place of each word in these.

        Words after which another can stand without changing any token are encoded together, a run at a time, and cut
        where their bytes end; the others, and those with the second vocabulary's sign for a space, one by one.
        """
        bounds, data = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
        alone = ~solid(data, bounds[1:]) | pc.match_substring(words, SPACE).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(~alone), np.flatnonzero(alone)))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        plain, rest = words.filter(pa.array(~alone)), words.filter(pa.array(alone)).to_pylist()
        at, text = np.frombuffer(plain.buffers()[1], np.int64)[: len(plain) + 1], memoryview(plain.buffers()[2] or b"")
        ids, counts = ([], []), ([], [])
        for begin in range(0, len(plain), RUN):
            cuts = at[begin : begin + RUN + 1]
            steps = [*cuts[:-1:SHORT].tolist(), int(cuts[-1])]
            runs = [str(text[x:y], "utf-8") for x, y in zip(steps[:-1], steps[1:])]
            ends = cuts[1:] - cuts[0]
            for k, found in enumerate((self.first("".join(runs)), np.concatenate(self.second(runs)))):
                upto = np.cumsum(self.sizes[k][found])
                last = np.searchsorted(upto, ends)
                if upto[-1] != ends[-1] or (upto[last] != ends).any():
                    own = plain.slice(begin, RUN).to_pylist()
                    each = [self.first(w) for w in own] if k == 0 else self.second(own)
                    found, last = np.concatenate(each), np.cumsum([len(e) for e in each]) - 1
                ids[k].append(found)
                counts[k].append(np.diff(last, prepend=-1))
        for k, each in enumerate(([self.first(w) for w in rest], self.second(rest))):
            ids[k].extend(each)
            counts[k].append(np.array([len(e) for e in each], np.int64))
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return place, [pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(whole(n, np.int64))))), pa.array(whole(i, np.int32))) for i, n in zip(ids, counts)]


@lru_cache(maxsize=1)
def vocabulary(first: str, second: str) -> Vocabulary:
    return Vocabulary(first, second)


def solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place surely isn't white space: ASCII, or one of U+00C0 to U+07FF."""
    before, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    return ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))


def word_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing their tokens: before a space after anything that surely isn't white space.
    data: the UTF-8 bytes of texts that each begin with a space, at `starts`. Tokens of the first vocabulary don't cross
    from other characters into white space, pieces of the second have spaces at their beginning only."""
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    cut[at[solid(data, at)]] = True
    return np.flatnonzero(cut[:-1])


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given sizes."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def align(texts: pa.Array, words: Vocabulary) -> dict:
    """For each text n_a, n_b, n_links and digest, and for all texts in order the `pairs` (a id * size of B + b id) linked.

    Lists of ids are flattened with their parent texts; running sums of token sizes, less the sum at the text's beginning,
    are the ends; tokens of both sides that end together come from a hash join on text and end, which are one number.
    Each such end cuts a group.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
    bounds = np.frombuffer(spaced.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    starts = word_starts(data, bounds[:-1])
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1])), pa.py_buffer(data)).dictionary_encode()
    parent = np.searchsorted(bounds, starts, "right") - 1
    sides, n = [], len(texts)
    fits = np.diff(bounds) > 1
    place, lists = words.encoded(parts.dictionary)
    index = pa.array(place[parts.indices.to_numpy()])
    for known, entries, sizes in zip(lists, words.bytes, words.sizes):
        own = known.take(index)
        ids = own.flatten().to_numpy()
        doc = np.repeat(parent, np.diff(own.offsets.to_numpy()))
        count = np.bincount(doc, minlength=n)
        found = entries.take(pa.array(ids))
        joined = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        length = summed(sizes[ids], count)
        at = np.concatenate(([0], np.cumsum(length)))
        for d in np.flatnonzero(fits):
            fits[d] = length[d] == bounds[d + 1] - bounds[d] and np.array_equal(joined[at[d] : at[d + 1]], data[bounds[d] : bounds[d + 1]])
        sides.append((ids, doc, sizes))
    tables, kept = [], []
    for ids, doc, sizes in sides:
        own = fits[doc]
        ids, doc = ids[own], doc[own]
        ends = np.cumsum(sizes[ids])
        count = np.bincount(doc, minlength=n)
        base = np.concatenate(([0], ends))[np.cumsum(count) - count]
        tables.append(pa.table({"document_end": doc << 40 | ends - base[doc], "at": np.arange(len(ids))}))
        kept.append((ids, count))
    met = tables[0].join(tables[1], "document_end", join_type="inner", right_suffix="_b", use_threads=False)
    (a, n_a), (b, n_b) = kept
    partner = np.full(len(a), -1)
    partner[met["at"].to_numpy()] = met["at_b"].to_numpy()
    last_a = np.flatnonzero(partner >= 0)
    last_b = partner[last_a]
    links = np.bincount(tables[0]["document_end"].to_numpy()[last_a] >> 40, minlength=n)
    return {"n_a": n_a, "n_b": n_b, "n_links": links, "digest": digests(a, b, last_a, last_b, n_a, n_b, words), "pairs": a[last_a].astype(np.int64) * words.n_b + b[last_b]}


def digests(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, words: Vocabulary) -> list[str]:
    """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`. last_a, last_b: the last tokens of each group."""
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a] = 1
    ends_b[last_b] = 1
    upto = np.cumsum(n_b)
    ends_b[(upto - 1)[n_b > 0]] = 2
    group_a = np.cumsum(ends_a > 0) - (ends_a > 0)
    group_b = np.cumsum(ends_b > 0) - (ends_b > 0)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = 2 * a.astype(np.int64) + ends_a
    order[np.arange(len(b)) + np.concatenate(([0], last_a + 1))[group_b + 1]] = words.after_a + 3 * b.astype(np.int64) + ends_b
    text = words.names.take(pa.array(order))
    data, at = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], np.int64)
    cuts = at[np.concatenate(([0], np.cumsum(n_a + n_b)))]
    return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])]


def chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `most` bytes of text, and of figures, together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        if y > x:
            yield batch.slice(x, y - x)


def one_list(values: pa.Array | np.ndarray) -> pa.ListArray:
    """A column of one row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def aligned_chunks(docs: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """A row for each chunk of texts: its texts' keys and figures in order; `codes`, all links in order as places in
    `pairs`, the chunk's distinct pairs, with how often each is linked in `counts`. Written, since chunks are numbered by
    task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, number = vocabulary(first, second), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in chunks(batch, CHUNK):
                got = align(some.column(1), words)
                pairs = pa.array(got["pairs"])
                partial = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).combine_chunks()
                distinct, counts = (partial[c].combine_chunks() if isinstance(partial[c], pa.ChunkedArray) else partial[c] for c in ("pair", "pair_count"))
                codes = pc.index_in(pairs, value_set=distinct)
                columns = [pa.array([task << 32 | number], pa.int64()), one_list(some.column(0)), *(one_list(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_links")), one_list(pa.array(got["digest"], pa.string())), one_list(codes), one_list(distinct), one_list(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "keys", "n_a", "n_b", "n_links", "digests", "codes", "pairs", "counts"])
                number += 1
            pa.default_memory_pool().release_unused()  # a worker that waits holds the vocabularies only

    return written(docs.select(key, text).mapInArrow(run, f"chunk long, keys array<{kind}>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>, codes array<int>, pairs array<long>, counts array<long>"), large=True)


def partial_counts(done: DataFrame) -> DataFrame:
    """chunk, place, pair, n: the counts of each chunk."""
    each = done.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    return each.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def totals(partial: DataFrame, size: int) -> DataFrame:
    """pair, count, best: chunks' counts added up; best where no pair of the same second token has more. The maxima are at
    most as many as the second vocabulary has entries, which bounds what is broadcast."""
    counted = written(partial.groupBy("pair").agg(F.sum("n").alias("count")))
    most = counted.groupBy((F.col("pair") % size).alias("b")).agg(F.max("count").alias("most"))
    return counted.join(F.broadcast(most), F.col("pair") % size == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum (all long), groups_sha256 of every document.

    A text is encoded, with a space before it, by a byte-level BPE (first, a file of the tokenizers library) and a BPE with byte fallback (second, which adds
    the space itself); strings of special tokens are plain text. Offsets where tokens of both end cut them into groups;
    every such pair of tokens is a link. A pair of ids counts its links over all documents; count_sum adds these counts up
    over a document's links and n_best counts the links whose count is the highest of their second token's, ties included.

    Null and empty texts, and texts whose tokens' bytes aren't the text's in either vocabulary, have no tokens: zeros and
    an empty digest. Repeated and null keys are documents of their own; other columns are ignored; an empty table gives no
    rows. Texts are aligned in chunks; of a chunk only its distinct pairs are shuffled, to the corpus counts and back, where
    they follow their chunk in order, so that a task holds one chunk and no lists are collected.
    """
    done = aligned_chunks(docs, key, text, first, second)
    partial, kind = partial_counts(done), docs.schema[key].dataType.simpleString()
    found = totals(partial, vocabulary(first, second).n_b)
    whole = F.struct("keys", "n_a", "n_b", "n_links", "digests", "codes")
    known = partial.join(found, "pair").select("chunk", "place", "count", "best", F.lit(None).cast(done.select(whole.alias("x")).schema["x"].dataType).alias("whole"))
    heads = done.select("chunk", F.lit(-1).alias("place"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), whole.alias("whole"))
    rows = heads.unionByName(known).repartition("chunk").sortWithinPartitions("chunk", "place")

    def scored(head: dict[str, pa.Array], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The texts of a chunk. parts: the counts of its pairs, in order of their places."""
        sizes, code = head["n_links"].to_numpy(), head["codes"].to_numpy()
        columns = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in (3, 2)]
        sums = [pa.array(summed(x[code], sizes)) for x in columns]
        links = head["n_links"]
        return pa.RecordBatch.from_arrays([head["keys"], head["n_a"], head["n_b"], links, links, *sums, head["digests"]], [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            at = np.flatnonzero(batch.column(1).to_numpy() < 0).tolist()
            for x, y in zip([-1, *at], [*at, batch.num_rows]):
                if x >= 0:
                    if head is not None:
                        yield scored(head, parts)
                    row = batch.column(4)
                    head, parts = {f.name: row.field(i)[x].values for i, f in enumerate(row.type)}, []
                if y > x + 1:
                    parts.append(batch.slice(x + 1, y - x - 1).select([0, 1, 2, 3]))
            del batch
            pa.default_memory_pool().release_unused()
        if head is not None:
            yield scored(head, parts)

    return rows.mapInArrow(run, f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """a, b, count, best: how often tokens of both vocabularies end together, over all documents."""
    size = vocabulary(first, second).n_b
    found = totals(partial_counts(aligned_chunks(docs, key, text, first, second)), size)
    return found.select(F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "count", "best")
