"""The pipeline against a brute-force version on planted documents."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from splicespark.llm import mixing


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [" ".join(make(25)) for _ in range(6)]
    docs = []
    for k in range(60):
        words = make(rng.randint(60, 300))
        docs.append(" ".join(words))
        if k % 5 == 0:
            docs += [" ".join(words)] * 2  # exact copies
        if k % 7 == 0 and len(words) > 150:
            near = list(words)
            near[50] = "other"  # about five of over 150 shingles
            docs.append(" ".join(near))
        if k % 11 == 0:
            docs.append(" ".join(words[:40]) + " fresh " + items[k % 6] + " " + " ".join(make(60)))
        if k % 13 == 0:
            docs.append(" ".join(make(50)) + f' token = "{rng.getrandbits(160):040x} " ' + " ".join(make(50)))
    docs += ["too short", "", None, "again and again and " * 30]
    rng.shuffle(docs)
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(docs)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def brute(rows, items):
    def quality(text):
        w = (text or "").split()
        many = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + j for i in range(len(w) - 4) if many[tuple(w[i : i + 5])] > 1 for j in range(5)}
        return len(w) >= 10 and 100 * len(inside) <= 20 * len(w)

    stages = [[r for r in rows if quality(r[1])]]
    sets = [shingles(r[1]) for r in stages[0]]
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[i] = parent[j]
                break
    stages.append([r for k, r in enumerate(stages[0]) if parent[k] == k])
    clean = lambda t: not any(i in t for i in items)
    stages.append([r for r in stages[1] if clean(r[1])])
    stages.append([(r[0], re.sub(r'token = "[0-9a-f]{40}', "[SECRET]", r[1]), *r[2:]) for r in stages[2]])
    return stages


def test_each_stage(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = brute(rows, items)
    assert [len(x) for x in expected[:3]] == sorted((len(x) for x in expected[:3]), reverse=True) and len(expected[0]) > len(expected[1]) > len(expected[2])
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:4], expected):
        found = stage(spark, docs, folder)
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted((x.doc_id, x.text) for x in found.collect()) == sorted((r[0], r[1]) for r in wanted), name
        docs = spark.createDataFrame(found.collect(), docs.schema)
    assert any("[SECRET]" in r[1] for r in expected[3])


def test_run(spark, tables):
    folder, rows, items = tables
    kept = {r[0]: r for r in brute(rows, items)[3]}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id for x in found} <= set(kept) and all(x.text == kept[x.doc_id][1] and 1 <= x.copies <= 2 for x in found)
    again = mixing.mix(spark.createDataFrame(list(kept.values()), "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {(x.doc_id, x.copies) for x in again if x.copies} == {(x.doc_id, x.copies) for x in found}
    size, taken = defaultdict(int), defaultdict(int)
    for x in again:
        size[x.source], taken[x.source] = x.source_size, taken[x.source] + x.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)


def test_stages_take_empty_tables(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
