"""Token alignment against whole texts encoded one by one, with groups and links by Python sets."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from splicespark.llm import token_alignment as T
from splicespark.llm.common import written
from splicespark.llm.queries import QUERIES

ODD = [
    None, "", " ", "  ", "x", "x ", "x  ", " x", "\n", "\n  x", "a \n  b\n \n c", "a  b", "a　  b   c", "é è\t ê", "Ünïcödé wörds ß", "日本語 テキスト  と space", "🙂 🙂  👩‍👩‍👧 x",
    "a<s>b</s> <unk> <|endoftext|> <pad>", "▁x", "a ▁ b", "a\0b \0 c", "don't we'll I'd", "3.14 1,000  2e5", "ﬁ ﬂ ​ x", "a" * 5000, "ab cd " * 3000, "\r\n \r\n", "tail\t", "é ́ x", "﻿bom x", "- -- --- ---- x",
]


class Plain:
    """Both tokenizers as their libraries load them."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(T.FIRST), SentencePieceProcessor(model_file=T.SECOND)
        self.a.encode_special_tokens = True


@pytest.fixture(scope="module")
def words():
    return Plain()


def brute(texts, words):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of each text."""
    table = T.byte_table()
    of_a = lambda i: bytes(table[c] for c in words.a.id_to_token(i))
    of_b = lambda i: bytes([int(words.b.id_to_piece(i)[3:5], 16)]) if words.b.is_byte(i) else words.b.id_to_piece(i).replace("▁", " ").encode()
    found, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = words.a.encode(" " + (text or ""), add_special_tokens=False).ids, words.b.encode(text or "")
        if not text or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            found.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((of_a, a), (of_b, b))]
        place = [{e: k for k, e in enumerate(x)} for x in ends]
        met, groups, at = [], [], [0, 0]
        for e in sorted(place[0].keys() & place[1].keys()):
            to = [p[e] + 1 for p in place]
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            met.append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        found.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(met)
    count = Counter(x for m in links for x in m)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(*f[:3], len(m), sum(count[x] == most[x[1]] for x in m), sum(count[x] for x in m), f[3]) for f, m in zip(found, links)], count


def test_cut_texts_have_the_tokens_of_whole_texts(words):
    rng = np.random.default_rng(3)
    parts = ["a", "word", "été", "ß", "日", "🙂", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "'s", "12", "...", "<s>", "́", "\r\n", "×", "߿"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(3000)] + [t or "" for t in ODD]
    spaced = [(" " + t).encode() for t in texts]
    bounds = np.cumsum([0, *map(len, spaced)])
    data = np.frombuffer(b"".join(spaced), np.uint8)
    starts = T.word_starts(data, bounds[:-1])
    pieces = [data[x:y].tobytes().decode() for x, y in zip(starts, [*starts[1:], len(data)])]
    assert len(pieces) > 2 * len(texts)
    place, lists = T.vocabulary(T.FIRST, T.SECOND).encoded(pa.array(pieces, pa.large_string()))
    a, b = (x.take(pa.array(place)) for x in lists)
    first = np.searchsorted(starts, bounds)
    for k, t in enumerate(texts):
        own = slice(first[k], first[k + 1])
        assert a[own].flatten().to_pylist() == words.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        if t and "▁" not in t:
            assert b[own].flatten().to_pylist() == words.b.encode(t), repr(t)


@pytest.mark.parametrize("chunk", [T.CHUNK, 300])
def test_alignment(spark, words, monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    texts = ODD + ODD[:10] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(None if k == 7 else k // 2, t, "n", k, "c") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, chunk long, codes string").repartition(3)
    right, count = brute(texts, words)
    got = T.align_documents(docs).collect()
    of = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(of, got)) == sorted((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, right))
    if chunk == T.CHUNK:
        pairs = T.pair_counts(docs).collect()
        assert {(p.a, p.b): p["count"] for p in pairs} == dict(count)
        assert {p.b for p in pairs if p.best} == {p.b for p in pairs}


def test_vocabularies(words):
    assert sorted(T.byte_table().values()) == list(range(256))
    assert T.vocabulary(T.FIRST, T.SECOND).bytes[0][words.a.token_to_id("Ġword")].as_py() == b" word"
    pieces = [words.b.id_to_piece(i) for i in range(words.b.get_piece_size())]
    assert not any("▁" in p.lstrip("▁") for p in pieces)  # or texts couldn't be cut before spaces


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.align_documents(empty).count() == 0 and T.pair_counts(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in T.align_documents(nothing).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert T.align(pa.array([], pa.string()), T.vocabulary(T.FIRST, T.SECOND))["pairs"].tolist() == []


def test_query(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    right, _ = brute([d.text for d in docs], words)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: x for d, x in zip(docs, right)}


def test_a_task_holds_one_chunk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = T.align_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    empty = pa.record_batch([pa.array(range(100_000)), pa.array([""] * 100_000)], ["doc_id", "text"])
    assert max(c.num_rows for c in T.chunks(empty, T.CHUNK)) <= T.CHUNK // T.ROW + 1


def test_large_rows_are_written_few_at_a_time(spark):
    rows = spark.range(0, 24, 1, 1).selectExpr("id", "transform(sequence(1, 100000), x -> xxhash64(id, x)) AS x")
    files = written(rows, large=True).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in files]
    assert sum(groups) > len(files)
