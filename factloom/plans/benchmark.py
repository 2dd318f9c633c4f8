"""Extraction scored against expected values: from pages, or from a folder of cases, to outcomes, scorecard and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import extract, normalize, ontology, quality
from factloom.sources import store


@dataclass(frozen=True)
class Evaluated:
    outcomes: DataFrame
    card: DataFrame
    tiers: DataFrame


def canonical(pages: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """The facts of pages, of which raw_artifact_id names the case: case_id, attribute_key, values, tier and place."""
    onto = ontology.ontology(pages.sparkSession)
    rows = normalize.normalized(extract.extract(pages), onto, ontology.with_learned(ontology.labels(onto), learned)).where("reason = 'ok'")
    return rows.select(
        F.col("raw_artifact_id").alias("case_id"), "attribute_key", "value_num", "value_text", F.col("provenance.extraction_tier").alias("tier"), "tier_pos",
        "place",
    )


def evaluate(pages: DataFrame, expected: DataFrame) -> Evaluated:
    """pages by case, and expected (case_id, vendor, category, attribute_key, want_num, want_text)."""
    rows = quality.outcomes(expected, canonical(pages))
    return Evaluated(rows, quality.scorecard(rows), quality.tier_counts(rows))


def evaluate_root(spark: SparkSession, root: str) -> Evaluated:
    """All cases under root/vendor/category/slug."""
    return evaluate(*store.cases(spark, root))
