import hashlib
import random

import numpy as np
import pytest

from splicespark.llm import suffix_dedup as S


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int(((np.diff(np.concatenate(([0], gone.astype(int))))) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in S.dedup(docs).collect()}


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 300))) for _ in range(12)]
    rows = []
    for k in range(60):
        kind = rng.random()
        text = rng.choice(base)
        if kind < 0.3:
            a = text.split()
            for _ in range(rng.randint(1, 4)):
                a[rng.randrange(len(a))] = rng.choice(words)
            text = " ".join(a)
        elif kind < 0.5:
            other = rng.choice(base)
            cut, at = rng.randrange(len(other)), rng.randrange(len(text))
            text = text[:at] + other[cut:] + text[at:]
        elif kind < 0.6:
            text = "a" * rng.randint(90, 450) + text
        elif kind < 0.65:
            text = "ab" * 120
        rows.append((k, text))
    return rows + [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101)]


@pytest.mark.parametrize("hot", [2_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = texts(hot)
    assert found(spark, rows) == brute(rows)


def test_segments_of_long_texts(monkeypatch, spark):
    rows = texts(5)
    data = np.frombuffer((" ".join(t for _, t in rows if t)).encode(), np.uint8)
    monkeypatch.setattr(S, "SEGMENT", 512)
    starts = [range(at + f, at + l + 1) for at, part in S.segments(data) for _, _, p, f, l in [S.anchors(part)] for f, l in zip(f, l)]
    assert sorted(x for r in starts for x in r) == list(range(len(data) - 99))


def test_repeated_and_null_ids(spark):
    text = "".join(map(chr, range(200, 500)))
    got = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    out = sorted((x.doc_id or 0, x.n_removed) for x in S.dedup(got).collect())
    assert out == [(0, 0), (1, 600), (1, 600), (2, 600)]


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, tie int, h string, pos long")
    assert S.dedup(docs).count() == 0


@pytest.mark.parametrize("rows_in_batch", [1, 2, 5])
def test_batches_dont_matter(spark, rows_in_batch):
    rows = texts(7) + [(200 + k, "the same long text " * 12) for k in range(5)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_scans_that_differ_lose_nothing(spark):
    """Rows come in another order, and so in other batches, in every scan."""
    from pyspark.sql import functions as F

    text = "".join(random.Random(4).choices("abcdefghij ", k=300))
    docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string")
    shuffled = docs.repartition(6, F.rand())
    assert sorted(x.n_removed for x in S.dedup(shuffled).collect()) == [0] + [len(text)] * 39


def test_clashing_columns(spark):
    text = "y" * 150
    docs = spark.createDataFrame([(k, text, k, "h", k, [k], "e") for k in range(3)], "doc_id long, text string, tie int, h string, pos long, starts array<int>, ctx string")
    assert sorted(x.n_removed for x in S.dedup(docs).collect()) == [149, 150, 150]
