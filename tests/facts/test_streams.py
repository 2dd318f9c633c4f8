"""The page stream's memory of what it has seen, and tables kept by key: late pages, repeats, restarts, batches that run again."""

import datetime as dt
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.sources import buckets, store
from factloom.streaming import ingest as stream

T0 = dt.datetime(2026, 1, 1)
PAGE = "url string, content string, content_type string, fetched_at timestamp"


def arrive(spark, at, n, *pages):
    rows = spark.createDataFrame([(f"https://a.b/{u}", c, "text/html", when) for u, c, when in pages], PAGE)
    store.as_artifacts(rows).coalesce(1).write.parquet(f"{at}/raw/{n}")


def take(spark, at):
    source = spark.readStream.schema(stream.RAW_ARTIFACT).option("recursiveFileLookup", "true").parquet(f"{at}/raw")
    run = stream.once(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    return sorted((r.url[-1], r.content, r.fetched_at) for r in spark.read.parquet(f"{at}/out").collect())


def test_pages_of_any_age_once(spark, tmp_path):
    old = T0 - dt.timedelta(days=730)
    arrive(spark, tmp_path, 0, ("x", "one", T0), ("x", "one", T0 - dt.timedelta(1)), ("y", "two", T0))
    first = [("x", "one", T0 - dt.timedelta(1)), ("y", "two", T0)]  # of a batch's repeats the earliest
    assert take(spark, tmp_path) == first
    # restarted from its checkpoint: a page two years late is kept, repeats are dropped
    arrive(spark, tmp_path, 1, ("z", "three", old), ("x", "one", T0 + dt.timedelta(days=400)), ("y", "two", old))
    assert take(spark, tmp_path) == sorted([*first, ("z", "three", old)])
    arrive(spark, tmp_path, 2, ("z", "three", T0))
    assert take(spark, tmp_path) == sorted([*first, ("z", "three", old)])


ROW = "k string, kind int, v string"


def sums(path):
    return {str(x.relative_to(path).parent): hashlib.sha256(x.read_bytes()).hexdigest() for x in Path(path).rglob("part-*.parquet")}


def rows_of(spark, path):
    return sorted((tuple(r) for r in buckets.table(spark, path, ROW).collect()), key=repr)


def test_a_table_kept_by_key(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ["k", "kind"]
    put = lambda n, *rows: buckets.replace(spark.createDataFrame(list(rows), ROW).repartition(3), path, keys, n, 8)
    assert rows_of(spark, path) == []
    many = [(f"k{i}", i % 2, "old") for i in range(200)]
    put(0, *many, (None, None, "none"))
    assert rows_of(spark, path) == sorted([*many, (None, None, "none")], key=repr)
    put(1, ("k3", 1, "new"), ("k3", 1, "second"), (None, None, "other"))
    want = sorted([x for x in many if x[0] != "k3"] + [("k3", 1, "new"), ("k3", 1, "second"), (None, None, "other")], key=repr)
    assert rows_of(spark, path) == want
    touched = {x for x in sums(f"{path}/data") if x.startswith("batch=1")}
    assert 1 <= len(touched) <= 2  # the other buckets were neither read nor written
    # a batch that runs again, also after half of it was written, leaves equal files
    before = sums(f"{path}/data")
    put(1, (None, None, "other"), ("k3", 1, "second"), ("k3", 1, "new"))
    assert sums(f"{path}/data") == before and rows_of(spark, path) == want
    put(2)
    assert rows_of(spark, path) == want and buckets.batches(spark, path) == [0, 1]
    spark.createDataFrame([("k9", 9, "lost")], ROW).write.parquet(f"{path}/data/batch=3/bucket=0")  # no version names it
    assert rows_of(spark, path) == want
    assert buckets.vacuum(spark, path, keep=1) == len(touched) and rows_of(spark, path) == want


def test_chunks_are_replaced_in_their_buckets(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"p{i % 40}", "fact", f"body {i}") for i in range(80)], "chunk_id string, product_id string, kind string, body string")
    path = f"{tmp_path}/chunks"
    retrieval.store_chunks(chunks, path, 0)
    retrieval.store_chunks(chunks.where("product_id = 'p3'").limit(1).withColumn("body", F.lit("new")), path, 1)
    got = buckets.table(spark, path, chunks.schema)
    assert got.count() == 79 and [r.body for r in got.where("product_id = 'p3'").collect()] == ["new"]
    assert len({x for x in sums(f"{path}/data") if x.startswith("batch=1")}) == 1


def test_the_fact_log_runs_again(spark, tmp_path):
    schema = "fact_id string, change long, value string"
    path = f"{tmp_path}/log"
    for n, rows in enumerate([[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 3, "w")]]):
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2):
            buckets.replace(stream.last_changes(batch), path, ["fact_id"], n)
    kept = stream.last_changes(spark.createDataFrame([], schema)).schema
    assert sorted(tuple(r) for r in stream.fact_log(spark, path, kept).collect()) == [("a", "w"), ("b", "z")]
