"""Token counts of fields and sections: whole documents are encoded once, tokens go to sections by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = "\n\n"  # after each field but the last; belongs to the field before it
RULES = ("start", "end", "most")


@lru_cache(maxsize=1)
def encoding(path: str):
    """The encoding and the number of bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (inclusive) of each token; a token that is a part of a character spans all of it."""
    coder, sizes = encoding(path)
    ends = np.cumsum(sizes[np.array(coder.encode_ordinary(text), np.int64)])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; sections begin at `starts` (sorted, from 0) and run up to the next.

    start: the section of the token's first character; end: of its last one; most: the one with most of its characters,
    of equal ones the first.
    """
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    if rule == "start":
        return a
    if rule == "end":
        return b
    found = a.copy()
    bounds = np.append(starts, np.iinfo(np.int64).max)
    for t in np.flatnonzero(a != b):
        own = range(a[t], b[t] + 1)
        found[t] = max(own, key=lambda s: (min(last[t] + 1, bounds[s + 1]) - max(first[t], bounds[s]), -s))
    return found


def sections_of(text: str) -> list[int]:
    """Where the lines of a text begin; a line keeps its line feed."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def count(docs: DataFrame, fields: tuple[str, ...] = ("text",), sectioned: tuple[str, ...] = ("text",), rule: str = "most", vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """key, field, section, start, n_chars, n_tokens, n_shared: a row for each section of each field of each document.

    A document is its fields with SEPARATOR between them, encoded as one text. A field in `sectioned` has its lines as
    sections, any other one section. A token that lies across a boundary goes to one section by `rule` and so the counts
    of a document's sections add up to its tokens; n_shared counts the tokens of a section that lie across a boundary.
    start is the section's first character in its field and n_chars its length, less the separator.

    A null field is empty; an empty field is one section without characters, which gets no token but its separator's.
    Repeated and null keys are documents of their own; other columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts: list[Column] = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)]
    names = ["field", "section", "start", "n_chars", "n_tokens", "n_shared"]

    def one(texts: list[str]) -> list[np.ndarray]:
        field, section, start, chars, place, at = [], [], [], [], [], 0
        for k, text in enumerate(texts):
            begin = sections_of(text) if fields[k] in sectioned else [0]
            field += [k] * len(begin)
            section += range(len(begin))
            start += begin
            chars += list(np.diff([*begin, len(text)]))
            place += [at + x for x in begin]
            at += len(text) + (len(SEPARATOR) if k + 1 < len(texts) else 0)
        whole = SEPARATOR.join(texts)
        if not whole:
            zero = np.zeros(len(field), np.int64)
            return [np.array(x, np.int64) for x in (field, section, start, chars)] + [zero, zero]
        first, last = token_spans(whole, vocabulary)
        starts = np.array(place, np.int64)
        own = allocate(first, last, starts, rule)
        across = np.searchsorted(starts, first, "right") != np.searchsorted(starts, last, "right")
        return [*(np.array(x, np.int64) for x in (field, section, start, chars)), np.bincount(own, minlength=len(starts)), np.bincount(own[across], minlength=len(starts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = np.array(fields)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            found = [one(list(texts)) for texts in zip(*columns)]
            if found:
                joined = [np.concatenate(x) for x in zip(*found)]
                rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(label[joined[0]]), *map(pa.array, joined[1:])], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, *parts).mapInArrow(run, f"{key} {kind}, field string, section long, start long, n_chars long, n_tokens long, n_shared long")
