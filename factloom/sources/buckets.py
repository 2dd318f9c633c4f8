"""A table that is kept by key: rows are dealt to hash buckets, and a change rewrites the buckets that it touches, no others.

    path/data/batch=7/bucket=3/   the rows of bucket 3 since batch 7
    path/versions/batch=7/        which batch holds each bucket, as of batch 7: a row a bucket

A reader takes each bucket from the batch that the newest version names, so it never folds a history. A version is
written after its data and in one file, so a batch that stops half way changes nothing; one that runs again starts from
the version before it and leaves the same rows in the same order. Writers are one at a time, as micro-batches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
BUCKET, BATCH = "bucket", "batch"


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that have a version, ascending."""
    files, at = _folder(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    names = [x.getPath() for x in files.listStatus(at)]
    done = [x.getName() for x in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.removeprefix("batch=")) for x in done)


def version(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket -> batch that holds it: BUCKETS entries at most."""
    known = [n for n in batches(spark, path) if before is None or n < before]
    if not known:
        return {}
    rows = spark.read.schema(f"{BUCKET} int, held_by bigint").parquet(f"{path}/versions/batch={known[-1]}")
    return {r[0]: r[1] for r in rows.collect()}


def _paths(path: str, held: dict[int, int]) -> list[str]:
    return [f"{path}/data/batch={n}/bucket={k}" for k, n in sorted(held.items())]


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of its newest version."""
    held = version(spark, path)
    return spark.read.schema(schema).parquet(*_paths(path, held)) if held else spark.createDataFrame([], schema)


def replace(new: DataFrame, path: str, keys: list[str], batch: int, buckets: int = BUCKETS) -> None:
    """Rows of the table whose keys occur in `new` give way to new's rows; the others stay.

    Only touched buckets are read and written. Null keys are keys like any others. The number of buckets is a choice for
    the life of a table.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    held = version(spark, path, before=batch)
    rows = new.withColumn(BUCKET, bucket(keys, buckets))
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    if not touched:
        return
    old = {k: held[k] for k in touched if k in held}
    if old:
        stored = spark.read.schema(new.schema).parquet(*_paths(path, old)).withColumn(BUCKET, bucket(keys, buckets))
        gone = new.select(*(F.col(k).alias("_" + k) for k in keys)).distinct().withColumn("_bucket", bucket(["_" + k for k in keys], buckets))
        same = F.col(BUCKET) == F.col("_bucket")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col("_" + k))
        rows = stored.join(gone, same, "left_anti").unionByName(rows)
    rest = [c for c in new.columns if c not in keys]
    dealt = rows.repartition(len(touched), BUCKET).sortWithinPartitions(BUCKET, *keys, *(F.to_json(F.struct(c)) for c in rest))
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/batch={batch}")
    now = held | dict.fromkeys(touched, batch)
    spark.createDataFrame(sorted(now.items()), f"{BUCKET} int, held_by bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what none of the newest `keep` versions holds; the number of folders deleted."""
    path = path.rstrip("/")
    known = batches(spark, path)
    held = {(n, k) for b in known[-keep:] for k, n in version(spark, path, before=b + 1).items()}
    files, at = _folder(spark, f"{path}/data")
    gone = 0
    for batch in files.listStatus(at) if files.exists(at) else []:
        n = int(batch.getPath().getName().removeprefix("batch="))
        if n > max(known, default=-1):
            continue  # not finished yet
        for x in files.listStatus(batch.getPath()):
            name = x.getPath().getName()
            if name.startswith("bucket=") and (n, int(name.removeprefix("bucket="))) not in held:
                gone += files.delete(x.getPath(), True)
    for b in known[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/batch={b}"), True)
    return gone
