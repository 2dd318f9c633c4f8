"""Questions to the current facts: filters over several attributes, and comparison of products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import float_text

LIMIT = 100
ORDERED = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}


@dataclass(frozen=True)
class Constraint:
    attribute_key: str
    op: str  # eq, ne, lt, lte, gt, gte
    value: float | str


def value_text(num: Column = None, text: Column = None) -> Column:
    """A value as text: texts as they are, numbers with a decimal point."""
    return F.coalesce(F.col("value_text") if text is None else text, float_text(F.col("value_num") if num is None else num))


def holds(c: Constraint) -> Column:
    """Does a fact meet the constraint? Order compares numbers only; equality compares numbers with numbers, and texts with the value's text."""
    own = F.col("attribute_key") == c.attribute_key
    if c.op in ORDERED:
        return own & F.coalesce(getattr(F.col("value_num"), ORDERED[c.op])(float(c.value)), F.lit(False))
    if c.op not in ("eq", "ne"):
        raise ValueError(f"unknown operator {c.op!r}")
    number = isinstance(c.value, int | float) and not isinstance(c.value, bool)
    same = (F.col("value_num") == float(c.value)) if number else (value_text() == c.value)
    same = F.coalesce(same, F.lit(False))
    return own & (same if c.op == "eq" else ~same)


def filter_products(facts: DataFrame, constraints: list[Constraint], limit: int | None = LIMIT) -> DataFrame:
    """Ids of the products that meet every constraint, the first `limit` by id, or all without one. No constraints, no products.

    One pass: only facts of the attributes named are read, and each product's are reduced to one flag a constraint
    before the shuffle. A product without the attribute doesn't meet `ne` either.
    """
    if not constraints:
        return facts.select("product_id").limit(0)
    named = facts.where(F.col("attribute_key").isin(sorted({c.attribute_key for c in constraints})))
    flags = named.groupBy("product_id").agg(*(F.bool_or(holds(c)).alias(f"c{i}") for i, c in enumerate(constraints)))
    for i in range(len(constraints)):
        flags = flags.where(f"c{i}")
    found = flags.select("product_id")
    return found if limit is None else found.orderBy("product_id").limit(limit)


def compare(facts: DataFrame, product_ids: list[str], attribute_keys: list[str]) -> DataFrame:
    """One row for each product asked for, in that order, with a map of the attributes it has. Of several facts the last by id wins."""
    spark = facts.sparkSession
    asked = spark.createDataFrame([(p, i) for i, p in enumerate(product_ids)], "product_id string, ordinal int")
    own = facts.where(F.col("product_id").isin(product_ids) & F.col("attribute_key").isin(attribute_keys))
    cell = F.struct(value_text().alias("value"), F.col("canonical_unit").alias("unit"), F.col("disputed"))
    last = own.groupBy("product_id", "attribute_key").agg(F.max_by(cell, "fact_id").alias("cell"))
    maps = last.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute_key", "cell")))).alias("cells"))
    empty = F.create_map().cast("map<string, struct<value: string, unit: string, disputed: boolean>>")
    return asked.join(maps, "product_id", "left").select("ordinal", "product_id", F.coalesce("cells", empty).alias("cells")).orderBy("ordinal")
