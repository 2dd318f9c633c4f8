"""Normalisation of candidates to canonical facts, and the routing of those that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import normalized_label, strip
from factloom.functions.units import quantity

# The review queue for each reason of failure.
REVIEW = {"unmapped": "attribute_mapping", "unparseable": "value_anomaly", "out_of_constraints": "value_anomaly"}
QUEUES = ["attribute_mapping", "low_confidence_fact", "disputed_fact", "entity_resolution", "value_anomaly"]


def within(value: Column, low: Column, high: Column) -> Column:
    """Both bounds belong to the range; a missing one doesn't bind."""
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))


def normalized(candidates: DataFrame, onto: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates with attribute_key, data_type, value_num or value_text, canonical_unit, original_value and `reason`.

    reason: ok, unmapped, unparseable or out_of_constraints. The label dictionary and the ontology are joined by
    equality. The ontology and its own labels are broadcast, so candidates stay where their page was read; a dictionary
    with learned labels, of which there may be any number, is broadcast only if Spark finds it small.
    """
    rows = candidates.withColumn("_label", normalized_label(F.col("raw_attribute")))
    keys = dictionary.select(F.col("label").alias("_label"), "attribute_key")
    known = onto.select("attribute_key", "data_type", "canonical_unit", "min_value", "max_value", "ontology_version")
    rows = rows.join(keys, "_label", "left").join(F.broadcast(known), "attribute_key", "left")
    measured = (F.col("data_type") == "quantity") & F.col("canonical_unit").isNotNull()
    rows = rows.withColumn("_value", F.when(measured, quantity(F.col("raw_value"), F.col("raw_unit"), F.col("canonical_unit"))))
    reason = (
        F.when(F.col("data_type").isNull(), "unmapped")
        .when(~measured, "ok")
        .when(F.col("_value").isNull(), "unparseable")
        .when(~within(F.col("_value"), F.col("min_value"), F.col("max_value")), "out_of_constraints")
        .otherwise("ok")
    )
    original = F.when(F.col("raw_unit") != "", F.concat_ws(" ", "raw_value", "raw_unit")).otherwise(F.col("raw_value"))
    rows = rows.withColumn("reason", reason).withColumn("original_value", original)
    fine = F.col("reason") == "ok"
    return (
        rows.withColumn("value_num", F.when(fine & measured, F.col("_value")))
        .withColumn("value_text", F.when(fine & ~measured, strip(F.col("raw_value"))))
        .withColumn("canonical_unit", F.when(fine & measured, F.col("canonical_unit")))
        .drop("_label", "_value", "min_value", "max_value")
    )


def review_items(failed: DataFrame, created_at: Column) -> DataFrame:
    """Queue items for candidates whose reason isn't ok. Equal problems share `dedup`: the attribute, or attribute and value."""
    reason = F.col("reason")
    queue = F.element_at(F.create_map(*(F.lit(x) for pair in REVIEW.items() for x in pair)), reason)
    dedup = F.when(reason == "unmapped", F.col("raw_attribute")).otherwise(F.concat_ws(":", "raw_attribute", "raw_value"))
    rows = failed.where(reason != "ok").withColumn("queue", queue).withColumn("dedup", dedup)
    payload = F.to_json(F.struct(
        "raw_attribute", "raw_value", "raw_unit", "reason", F.col("provenance.source_url").alias("source_url"),
        F.col("provenance.source_span").alias("source_span"),
    ))
    return rows.select("queue", payload.alias("payload"), "dedup", F.lit(100).alias("priority"), created_at.alias("created_at"), "tier_pos", "place", "raw_artifact_id")


def enriched(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Product references (raw_artifact_id, gtin, mpn, ...) filled from the ids that pages name; the caller's values and earlier candidates come first."""
    at = F.struct("tier_pos", "place")
    first = candidates.groupBy("raw_artifact_id").agg(
        *(F.min_by(F.col("detected_ids")[k], F.when(F.map_contains_key("detected_ids", k), at)).alias(f"found_{k}") for k in ("gtin", "mpn")),
    )
    rows = refs.join(first.hint("merge"), "raw_artifact_id", "left")  # as many rows as pages, whatever their estimated size
    for k in ("gtin", "mpn"):
        rows = rows.withColumn(k, F.coalesce(F.when(F.col(k) != "", F.col(k)), F.col(f"found_{k}")))
    return rows.drop("found_gtin", "found_mpn")
