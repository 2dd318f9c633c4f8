"""From pages to facts: extraction, resolution of products, normalisation, versions and review items, as one lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import entity_id
from factloom.operators import extract, facts, normalize, ontology, quality, resolve, review


@dataclass(frozen=True)
class Ingested:
    observations: DataFrame
    versions: DataFrame
    products: DataFrame
    review_items: DataFrame
    counts: DataFrame


def observed(normalized: DataFrame, valid_from: Column) -> DataFrame:
    """Normalised candidates as observations. `seq` is the order of page, tier and place in the page, so a rerun replays alike."""
    fine = normalized.where("reason = 'ok' AND product_id IS NOT NULL")
    seq = F.struct("page_seq", "tier_pos", "place").alias("seq")
    p = F.col("provenance")
    return fine.select(
        "product_id", "attribute_key", seq, entity_id("fct", F.col("product_id"), F.col("attribute_key"), F.col("page_seq"), F.col("tier_pos"), F.col("place")).alias("fact_id"),
        "value_num", "value_text", "canonical_unit", p["source_type"].alias("source_type"), p["source_url"].alias("source_url"), p["source_span"].alias("source_span"), p["fetched_at"].alias("fetched_at"),
        "confidence", "data_type", "ontology_version", "original_value", valid_from.alias("valid_from"),
    )


def ingest(artifacts: DataFrame, refs: DataFrame, valid_from: Column, learned: DataFrame | None = None) -> Ingested:
    """artifacts: raw pages with page_seq; refs: (raw_artifact_id, seq, product_id or null, gtin, mpn, brand, model, source_url).

    One shuffle by product key for resolution, and one by (product, attribute) for the versions.
    """
    spark = artifacts.sparkSession
    found = extract.extract(artifacts)
    named = resolve.resolve_or_create(normalize.enriched(refs, found))
    onto = ontology.ontology(spark)
    rows = normalize.normalized(found, onto, ontology.with_learned(ontology.labels(onto), learned))
    rows = rows.join(
        named.select("raw_artifact_id", F.col("resolved").alias("product_id")), "raw_artifact_id",
    ).join(artifacts.select("raw_artifact_id", "page_seq"), "raw_artifact_id")
    obs = observed(rows, valid_from)
    items = review.enqueue(None, normalize.review_items(rows, valid_from), ["raw_artifact_id", "tier_pos", "place"])
    queued = items.groupBy("raw_artifact_id").agg(F.count("*").alias("hitl_enqueued"))
    counts = quality.ingest_counts(rows).join(queued, "raw_artifact_id", "left").na.fill(0, ["hitl_enqueued"])
    return Ingested(obs, facts.versions(obs), resolve.products_of(named), items, counts)
