"""The byte network: gradients by differences, windows over whole texts, held-out accuracy, odd tables."""

import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicespark.llm import language_id as L
from splicespark.llm.queries import QUERIES

SMALL = L.Shape(window=24, embed=3, filters=((2, 2), (3, 3)), sample=400, rounds=4, block=7)


def test_gradients():
    net = L.Network.start(SMALL, ["a", "b", "c"], np.zeros(3))
    for k, v in net.weights.items():
        net.weights[k] = v.astype(np.float64)
    rng = np.random.default_rng(2)
    x = rng.integers(1, 200, (9, 24)).astype(np.uint8)
    x[:4, 15:] = 0
    y, weight = rng.integers(0, 3, 9), rng.random(9) + 0.5
    net.patches = lambda w, n=net: np.stack([np.concatenate((n.weights["table"][w], np.zeros((len(w), 2, 3))), 1)[:, p : p + 3].reshape(len(w), -1) for p in range(24)], 1)  # in doubles
    loss = lambda: float((-L.log_softmax(np.maximum(net.pooled(x)[0], 0) @ net.weights["out"] + net.weights["out0"])[np.arange(9), y] * weight).mean())
    found = net.gradients(x, y, weight, SMALL.mask())
    mask = SMALL.mask()
    for k, g in found.items():
        for at in rng.permutation(g.size)[:25]:
            place = np.unravel_index(at, g.shape)
            if k == "conv" and not mask[place] or k == "table" and not place[0]:
                assert g[place] == 0
                continue
            w, e = net.weights[k], 1e-5
            old = w[place]
            w[place] = old + e
            up = loss()
            w[place] = old - e
            down = loss()
            w[place] = old
            assert abs((up - down) / (2 * e) - g[place]) < 1e-5, k


def test_patches_are_what_the_bytes_say():
    net = L.Network.start(SMALL, ["a"], np.zeros(1))
    x = np.arange(1, 49, dtype=np.uint8).reshape(2, 24)
    seen, table = net.patches(x), net.weights["table"]
    for n in range(2):
        for p in range(24):
            want = [table[x[n, p + k]] if p + k < 24 else np.zeros(3) for k in range(3)]
            assert np.allclose(seen[n, p], np.concatenate(want))


def test_windows_cover_whole_texts():
    net = L.Network.start(SMALL, ["a", "b"], np.log([0.7, 0.3]))
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(65, 123, n).astype(np.uint8)) for n in (1, 2, 3, 21, 22, 23, 24, 25, 43, 44, 45, 46, 47, 500)]
    got = net.predict(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for t, g in zip(texts, got):
        windows = [t[at : at + 24] for at in range(0, max(1, len(t) - 2), 22)]
        x = np.stack([np.frombuffer(w.ljust(24, b"\0"), np.uint8) for w in windows])
        covered = {at + k for at, w in zip(range(0, max(1, len(t) - 2), 22), windows) for k in range(len(w))}
        assert covered == set(range(len(t)))
        value = net.log_shares(L.CLASSES[x]).mean(0) + np.log([0.7, 0.3])
        assert np.allclose(g, np.exp(L.log_softmax(value)), atol=1e-5)


def test_held_out_accuracy_and_what_it_learns_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    right = {r.doc_id: r for r in docs.collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(right) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([right[r.doc_id].lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # neither the languages of held-out documents nor the partitions matter
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z")).repartition(5)
    again = {r.doc_id: r for r in L.identify(other).collect()}
    assert all(again[r.doc_id].lang_pred == r.lang_pred and abs(again[r.doc_id].score - r.score) < 1e-4 for r in got)


@pytest.mark.parametrize("sample", [8, 400])
def test_the_sample_is_bounded_and_shared(spark, sample):
    rows = [(k, f"text number {k} of " + "words " * (k % 50), "en" if k % 10 else "fr") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known, found = L.training_windows(docs, "doc_id", "text", "lang", replace(SMALL, sample=sample))
    assert [k for k, _ in known] == ["en", "fr"] and 2 <= len(found) <= sample and {x for x, _ in found} == {"en", "fr"}
    assert found == L.training_windows(docs.repartition(7), "doc_id", "text", "lang", replace(SMALL, sample=sample))[1]


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, held_out string, score string, key string, spread string"
    base = [(1, None), (2, ""), (3, "123 --- \n"), (4, "das ist der Text " * 4000), (4, "das ist der Text"), (None, "the text of it"), (6, "é"), (7, "\0 x"), (9, "the and of it " * 5), (12, "der die das und " * 5)]
    rows = [(i, t, None if k % 4 == 3 else "de" if t and "d" in t[:2] else "en", "h", "s", "k", "p") for k, (i, t) in enumerate(base)]
    docs = spark.createDataFrame(rows, schema)
    got = L.identify(docs, shape=SMALL).collect()
    assert len(got) == len(base) and {r.lang_pred for r in got} <= {"de", "en", "und"}
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred != "und"
        else:
            assert not r.held_out
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    blank = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}


def test_query(spark):
    rows = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.001").collect()
    assert rows[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.9
