"""Review queues: items that people decide on, and what the system learns from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factloom.functions.text import entity_id
from factloom.operators.normalize import QUEUES

LIMIT = 50


def enqueue(stored: DataFrame | None, new: DataFrame, order: list[str]) -> DataFrame:
    """The new items to append: of each (queue, dedup) the first by `order`, unless an open one is stored. Items without dedup all stay."""
    first = Window.partitionBy("queue", "dedup").orderBy(*order)
    rows = new.withColumn("_n", F.when(F.col("dedup").isNotNull(), F.row_number().over(first)).otherwise(1)).where("_n = 1").drop("_n")
    if stored is not None:
        rows = rows.join(stored.where("status = 'open'").select("queue", "dedup").distinct(), ["queue", "dedup"], "left_anti")
    return rows.withColumn("item_id", entity_id("hitl", *(F.col(c) for c in ("queue", "dedup", *order)))).withColumn("status", F.lit("open"))


def open_items(items: DataFrame, queue: str, limit: int = LIMIT) -> DataFrame:
    if queue not in QUEUES:
        raise ValueError(f"unknown queue {queue!r}")
    return items.where((F.col("queue") == queue) & (F.col("status") == "open")).orderBy("priority", "created_at", "item_id").limit(limit)


def item(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("item_id") == item_id)


def open_counts(items: DataFrame) -> DataFrame:
    """Open items of every queue, none included."""
    names = items.sparkSession.createDataFrame([(q,) for q in QUEUES], "queue string")
    counts = items.where("status = 'open'").groupBy("queue").agg(F.count("*").alias("n_open"))
    return names.join(counts, "queue", "left").select("queue", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open"))


def resolve(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """items with open ones resolved by resolutions (item_id, status, resolved_by, resolution, resolved_at); the first for an item counts."""
    first = Window.partitionBy("item_id").orderBy("resolved_at", "resolved_by", "resolution")
    once = resolutions.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("item_id", F.struct("status", "resolved_by", "resolution", "resolved_at").alias("_r"))
    rows = items.join(once, "item_id", "left")
    now = (F.col("status") == "open") & F.col("_r").isNotNull()
    for c in ("resolved_by", "resolution", "resolved_at"):
        rows = rows.withColumn(c, F.when(now, F.col(f"_r.{c}")).otherwise(F.col(c) if c in items.columns else F.lit(None)))
    return rows.withColumn("status", F.when(now, F.col("_r.status")).otherwise(F.col("status"))).drop("_r")


def learned(items: DataFrame) -> DataFrame:
    """Mappings that resolved items of the mapping queue confirm: those that name both the raw and the canonical attribute."""
    path = "array<string>"
    rows = items.where("queue = 'attribute_mapping' AND status = 'resolved'")
    rows = rows.select(
        F.get_json_object("payload", "$.raw_attribute").alias("raw_attribute"), F.coalesce(F.get_json_object("payload", "$.language"), F.lit("")).alias("language"), F.array().cast(path).alias("category_path"),
        F.get_json_object("resolution", "$.attribute_key").alias("attribute_key"), F.col("resolved_by").alias("confirmed_by"), F.col("resolved_at").alias("confirmed_at"),
    )
    return rows.where("raw_attribute <> '' AND attribute_key <> ''")
