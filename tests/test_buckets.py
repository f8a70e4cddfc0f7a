"""Bucketed stores, batches and resumed runs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from codelattice.sources import buckets
from codelattice.streaming import incremental

SCHEMA = "entity_id string, type string, created_at int, weight int, props map<string, string>"


def rows(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def test_merge_rules_and_touched_buckets(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "edges"), SCHEMA, buckets=50)
    first = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("CALLS").alias("type"), F.lit(1).alias("created_at"), F.lit(5).alias("weight"), F.create_map(F.lit("a"), F.lit("1")).alias("props"))
    assert buckets.merge_edges(store, first) == {"created": 1000, "matched": 0, "buckets": 50}
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.path}/bucket=*/*.parquet")}
    found = buckets.merge_edges(store, rows(spark, ("e7", "CALLS", 9, 9, {"b": "2"}), ("new", "CALLS", 9, 9, None), ("e7", "CALLS", 9, 9, {"b": "2"})))
    assert (found["created"], found["matched"]) == (1, 1) and found["buckets"] <= 2
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.path}/bucket=*/*.parquet")}
    assert sum(after.get(f) == m for f, m in before.items()) >= len(before) - 2
    got = {r.entity_id: r for r in store.read().collect()}
    assert len(got) == 1001 and got["e7"].weight == 5 and got["e7"].created_at == 1 and got["e7"].props == {"a": "1", "b": "2"} and got["new"].weight == 9
    assert [r.entity_id for r in store.lookup(["e7", "none"]).collect()] == ["e7"]
    assert "bucket" in store.lookup(["e7"])._jdf.queryExecution().executedPlan().toString()
    assert store.delete(rows(spark, ("e7", None, None, None, None), ("none", None, None, None, None)))["deleted"] == 1
    assert store.read().count() == 1000
    one = buckets.BucketStore(spark, str(tmp_path / "one"), SCHEMA, buckets=3)
    one.merge(rows(spark, ("x", "T", 1, 1, None)))
    assert one.delete(rows(spark, ("x", None, None, None, None))) == {"deleted": 1, "buckets": 1} and one.read().count() == 0
    assert one.merge(rows(spark).limit(0)) == {"created": 0, "matched": 0, "buckets": 0}


def test_failed_batches_are_told_and_others_stay(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "nodes"), SCHEMA, buckets=8)
    data = [(f"n{i}", "T", i % 4, 1, None) for i in range(40)] + [(None, "T", 2, 1, None)]
    told = buckets.store_batches(rows(spark, *data), 4, lambda df, _: store.merge(df), by="created_at").orderBy("batch").collect()
    assert [(r.batch, r.rows, r.created, r.status) for r in told] == [(0, 10, 10, "stored"), (1, 10, 10, "stored"), (2, 11, 0, "failed"), (3, 10, 10, "stored")]
    assert told[2].error and store.read().count() == 30
    again = buckets.store_batches(rows(spark, *data[:-1]), 4, lambda df, _: store.merge(df), by="created_at").orderBy("batch").collect()
    assert [(r.created, r.matched) for r in again] == [(0, 10), (0, 10), (10, 0), (0, 10)] and store.read().count() == 40


def test_killed_stream_resumes_by_the_ledger(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for i in range(6):
        spark.createDataFrame([(f"f{i}.java", f"class A{i} {{ }}")], "path string, text string").coalesce(1).write.mode("append").parquet(source)
    store = buckets.BucketStore(spark, str(tmp_path / "out"), "entity_id string, text string", buckets=4)
    ledger = buckets.Ledger(spark, str(tmp_path / "ledger"))

    def parse(files):
        return files.select(F.col("path").alias("entity_id"), F.upper("text").alias("text"))

    def save(df, number):
        store.merge(df, props=None)
        seen.append((number, sorted(r.entity_id for r in df.collect())))
        if len(seen) == 2:
            raise RuntimeError("killed after saving")

    def run(checkpoint):
        stream = incremental.stream_files(spark, source, "path string, text string", per_batch=2)
        return incremental.ingest(stream, buckets.resumable(ledger, "r1", parse, save), str(tmp_path / checkpoint)).awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run("c1")
    assert ledger.state().first().phase == "failed" and ledger.done("r1").count() == 2
    run("c2")  # a new checkpoint sees every file again; the ledger alone knows what is done
    ledger.mark("r1", "completed")
    assert sorted(r.path for r in ledger.done("r1").collect()) == [f"f{i}.java" for i in range(6)]
    assert {r.entity_id: r.text for r in store.read().collect()} == {f"f{i}.java": f"CLASS A{i} {{ }}" for i in range(6)}
    first, repeated = seen[0][1], seen[1][1]
    assert not any(p in batch for _, batch in seen[2:] for p in first) and sorted(p for _, b in seen[2:] for p in b) == sorted({f"f{i}.java" for i in range(6)} - set(first)) and repeated
    assert tuple(ledger.state().first()) == ("r1", 6, ledger.state().first().batches, "completed")
