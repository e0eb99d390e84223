"""Incremental ingest: state by connection, batches of their own files, replays and duplicates."""

import os
import shutil

from splicespark.streaming import ingest

SCHEMA = "grp string, experiment int, lsv_id string, junc_idx int, reads long, npos long"


def experiment(k):
    return [("A", k, "l", 0, 3 + k, 2), ("B", k, "l", 0, 1, 1)] + [("A", k, f"x{i}", i % 3, i % 7, 2) for i in range(40)]


def sent(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, files=1):
    query = ingest.start(ingest.count_stream(spark, str(tmp_path / "in"), SCHEMA, files), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    return query


def evidence(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_add_to_the_state(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), []
    for k in range(3):
        sent(spark, folder, experiment(k))
        rows += experiment(k)
        query = run(spark, tmp_path)
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(experiment(k))  # the batch's own files only
        assert evidence(ingest.current(spark, str(tmp_path / "ck"))) == evidence(ingest.group_evidence(spark.createDataFrame(rows, SCHEMA)))
    assert ("A", "l", 0, 12, 3) in evidence(ingest.current(spark, str(tmp_path / "ck")))
    changed = spark.read.parquet(str(tmp_path / "out")).filter("batch = 2")
    assert evidence(changed.drop("batch")) == evidence(ingest.current(spark, str(tmp_path / "ck")))  # every connection changed
    # a batch that touches one connection writes that one
    sent(spark, folder, [("B", 9, "l", 0, 5, 2)])
    run(spark, tmp_path)
    last = spark.read.parquet(str(tmp_path / "out")).filter("batch = 3")
    assert evidence(last.drop("batch")) == [("B", "l", 0, 8, 1)]


def test_what_is_sent_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(2):
        sent(spark, folder, experiment(k))
    run(spark, tmp_path, files=10)
    before = evidence(ingest.current(spark, str(tmp_path / "ck")))
    sent(spark, folder, experiment(1) * 2 + [("A", 1, "m", 0, 9, 3)] * 2)
    run(spark, tmp_path)
    assert evidence(ingest.current(spark, str(tmp_path / "ck"))) == sorted([*before, ("A", "m", 0, 9, 1)])


def test_a_batch_that_is_repeated(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(2):
        sent(spark, folder, experiment(k))
        run(spark, tmp_path)
    whole, out = evidence(ingest.current(spark, str(tmp_path / "ck"))), evidence(spark.read.parquet(str(tmp_path / "out")))
    # as after a failure: the batch's files are planned and it has written a part of its rows, but it hasn't ended
    os.remove(tmp_path / "ck" / "commits" / "1")
    if (tmp_path / "ck" / "commits" / ".1.crc").exists():
        os.remove(tmp_path / "ck" / "commits" / ".1.crc")
    shutil.rmtree(tmp_path / "out" / "batch=1")
    run(spark, tmp_path)
    assert evidence(ingest.current(spark, str(tmp_path / "ck"))) == whole
    assert evidence(spark.read.parquet(str(tmp_path / "out"))) == out
