"""The raw store, written intermediate tables, benchmark cases and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.functions.urls import host
from factloom.schemas import RAW_ARTIFACT


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the folder that `spark.checkpoint.dir` names; a local one only where that is unset and all runs in one JVM."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def artifact_id(url, digest):
    return F.concat(F.lit("raw/"), host(url), F.lit("/"), digest)


def as_artifacts(pages: DataFrame) -> DataFrame:
    """pages (url, content, content_type, fetched_at) as raw artifacts, with content hash and id."""
    rows = pages.withColumn("content_hash", F.sha2("content", 256))
    rows = rows.withColumn("raw_artifact_id", artifact_id(F.col("url"), F.col("content_hash")))
    have = set(rows.columns)
    fields = [f.strip().split(" ") for f in RAW_ARTIFACT.split(",")]
    return rows.select(*(F.col(n) if n in have else F.lit("static_http" if n == "render_mode" else None).cast(t).alias(n) for n, t in fields))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[str, str]], at) -> DataFrame:
    """Artifacts of urls (url), by an injected fetch(url) -> (content, content type); one that raises gives no row."""

    def run(frames):
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, *fetch(url)))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["url", "content", "content_type"])

    return as_artifacts(urls.select("url").mapInPandas(run, "url string, content string, content_type string").withColumn("fetched_at", at))


def new_artifacts(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """What to append: each id once (the earliest fetch), unless it is stored. The first write of an id wins for body and row."""
    first = Window.partitionBy("raw_artifact_id").orderBy("fetched_at", "url")
    rows = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows if stored is None else rows.join(stored.select("raw_artifact_id"), "raw_artifact_id", "left_anti")


def by_content(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(content_hash, key, n): the least key of the rows of each content, and how many there are."""
    return rows.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("n"))


def put(batch: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    new_artifacts(batch, stored).write.mode("append").parquet(path)


def get(spark: SparkSession, path: str, raw_artifact_id: str) -> DataFrame:
    return spark.read.schema(RAW_ARTIFACT).parquet(path).where(F.col("raw_artifact_id") == raw_artifact_id)


def existing(ids: DataFrame, stored: DataFrame) -> DataFrame:
    return ids.join(stored.select("raw_artifact_id"), "raw_artifact_id", "left_semi")


def latest(artifacts: DataFrame) -> DataFrame:
    """The last fetch of each canonical URL (ties: the greater id)."""
    last = Window.partitionBy("canonical_url").orderBy(F.desc("fetched_at"), F.desc("raw_artifact_id"))
    return artifacts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark cases under root/vendor/category/slug: (artifacts with case_id, expected values). source.html comes before source.json."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    rows = files.select(
        F.element_at(parts, -4).alias("vendor"), F.element_at(parts, -3).alias("category"), F.element_at(parts, -2).alias("slug"),
        F.element_at(parts, -1).alias("file"), F.col("content").cast("string").alias("content"),
    )
    rows = rows.withColumn("case_id", F.concat_ws("/", "vendor", "category", "slug"))
    expected = rows.where("file = 'expected.json'")
    values = F.from_json(F.get_json_object("content", "$.expected"), "map<string,variant>")
    want = expected.select("case_id", "vendor", "category", F.explode(values).alias("attribute_key", "value"))
    is_number = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")  # by its JSON type: the text "5.3" stays text
    num, text = F.try_variant_get("value", "$", "double"), F.try_variant_get("value", "$", "string")
    want = want.select("case_id", "vendor", "category", "attribute_key", F.when(is_number, num).alias("want_num"), F.when(~is_number, text).alias("want_text"))
    sources = rows.where("file IN ('source.html', 'source.json')").groupBy("case_id").agg(F.min_by(F.struct("file", "content"), "file").alias("s"))
    meta = expected.select("case_id", F.get_json_object("content", "$.content_type").alias("told"), F.get_json_object("content", "$.product.source_url").alias("url"))
    kind = F.coalesce("told", F.when(F.col("s.file") == "source.json", "application/json").otherwise("text/html"))
    pages = sources.join(meta, "case_id").select(
        "case_id", F.col("case_id").alias("raw_artifact_id"), F.coalesce("url", F.concat(F.lit("https://benchmark.local/"), "case_id")).alias("url"),
        F.lit(None).cast("string").alias("canonical_url"), F.col("s.content").alias("content"), kind.alias("content_type"),
        F.timestamp_seconds(F.lit(0)).alias("fetched_at"),
    )
    return pages, want


def write_report(card: DataFrame, path: str) -> None:
    """The scorecard as JSON lines."""
    card.write.mode("overwrite").json(path)
