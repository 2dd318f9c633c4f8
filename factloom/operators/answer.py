"""Questions about products, answered in batches: from facts, from chunks, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import normalized_label
from factloom.operators.query import value_text
from factloom.operators.resolve import resolve
from factloom.operators.search import search

TOP = 3


def asked_attributes(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """(question_id, attribute_key) for questions that name a label: the longest one, of equally long ones the first attribute's.

    Runs of as many words of the question as the longest label has are joined with the labels by equality, so no question
    meets every label. The labels are broadcast, as they are few; of the questions, which look small before their words
    are taken apart, nothing is.
    """
    most = labels.agg(F.max(F.size(F.split("label", " ")))).first()[0] or 1
    words = F.split(normalized_label(F.col("text")), " ")
    runs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(most)),
        lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, n), " ")),
    ))
    phrases = questions.select("question_id", words.alias("_w")).select("question_id", F.explode(F.array_distinct(runs)).alias("label"))
    best = F.max_by("attribute_key", F.struct(F.length("label"), -F.col("ordinal"))).alias("attribute_key")
    return phrases.join(F.broadcast(labels), "label").groupBy("question_id").agg(best)


def fact_answer() -> Column:
    """`label: value unit (as reported: ...). Source: url, as of date.`, with a note if sources disagree."""
    unit = F.when(F.col("canonical_unit") != "", F.concat(F.lit(" "), "canonical_unit")).otherwise("")
    value = F.concat(value_text(), unit)
    told = F.when((F.col("original_value") != "") & (F.col("original_value") != value), F.concat(value, F.lit(" (as reported: "), "original_value", F.lit(")"))).otherwise(value)
    head = F.concat(F.replace("attribute_key", F.lit("_"), F.lit(" ")), F.lit(": "), told)
    cited = F.concat(F.lit(" Source: "), "source_url", F.lit(", as of "), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("."))
    return F.concat(head, F.when(F.col("disputed"), " (sources disagree; see citation).").otherwise("."), cited)


# What is said where nothing is known.
NO_ATTRIBUTE = "Could not tell which attribute is being asked about. Please name a known attribute (e.g. weight, IP rating, battery life)."
NO_PRODUCT = "Could not resolve the product. Provide product_id, GTIN, MPN, or brand + model."


def about(questions: DataFrame, products: DataFrame) -> DataFrame:
    """questions with product_id: their own, or else the product that their gtin, mpn and brand, or brand and model name."""
    names = [k for k in ("gtin", "mpn", "brand", "model") if k not in questions.columns]
    rows = questions.withColumns({k: F.lit(None).cast("string") for k in names})
    own = F.when(F.col("product_id") != "", F.col("product_id")) if "product_id" in questions.columns else F.lit(None).cast("string")
    found = resolve(rows.withColumn("_own", own).drop("product_id"), products)
    return found.withColumn("product_id", F.coalesce("_own", "product_id")).drop("_own")


def answer(questions: DataFrame, labels: DataFrame, facts: DataFrame, chunk_rows: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """questions (question_id, text, product_id or null, brand or null) -> found, route, answer and citation.

    With products, a question without a product_id is about the product that its gtin, mpn, brand and model resolve to.
    An exact fact comes first; then, if there are chunks, the best one; then an honest refusal. Only questions without
    an exact fact are searched for. Questions and facts meet in sorted joins, since either side may be large whatever its
    estimated size; questions without a product are dealt by their own id.
    """
    if products is not None:
        questions = about(questions, products)
    f = facts.select("product_id", "attribute_key", "value_num", "value_text", "canonical_unit", "original_value", "disputed", "source_url", "source_span", "fetched_at")
    rows = questions.join(asked_attributes(questions, labels).hint("merge"), "question_id", "left")
    rows = rows.withColumn("_dealt", F.coalesce("product_id", F.col("question_id").cast("string")))
    rows = rows.join(f.withColumn("_dealt", F.col("product_id")).hint("merge"), ["_dealt", "product_id", "attribute_key"], "left").drop("_dealt")
    exact = F.col("fetched_at").isNotNull()
    if chunk_rows is not None:
        open_ = rows.where(~exact).select("question_id", "text", "brand")
        hits = search(chunk_rows, open_, TOP).where("rank = 1").select("question_id", "chunk_id")
        best = hits.join(
            chunk_rows.select("chunk_id", F.col("product_id").alias("c_product"), F.col("body").alias("c_body"), F.col("source_url").alias("c_url"), F.col("fetched_at").alias("c_at")),
            "chunk_id",
        ).drop("chunk_id")
        rows = rows.join(best, "question_id", "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("c_product", "string"), ("c_body", "string"), ("c_url", "string"), ("c_at", "timestamp"))))
    near = F.col("c_body").isNotNull()
    route = F.when(exact, "exact_lookup").when(near, "hybrid").when(F.col("attribute_key").isNull(), "ambiguous").otherwise("refused")
    said = (
        F.when(exact, fact_answer()).when(near, F.concat(F.lit("Based on the product's stored data:\n"), "c_body")).when(F.col("attribute_key").isNull(), NO_ATTRIBUTE)
        .when(F.col("product_id").isNull(), NO_PRODUCT).otherwise(F.concat(F.lit("No data for '"), "attribute_key", F.lit("' on this product.")))
    )
    cited = F.when(exact, F.struct("source_url", "source_span", "fetched_at")).when(
        near, F.struct(F.coalesce("c_url", F.lit("")).alias("source_url"), F.col("c_body").alias("source_span"), F.col("c_at").alias("fetched_at")),
    )
    return rows.select(
        "question_id", (exact | near).alias("found"), route.alias("route"), said.alias("answer"),
        F.when(~exact & near, F.col("c_product")).otherwise(F.col("product_id")).alias("product_id"), "attribute_key",
        F.when(exact, F.col("value_num")).alias("value_num"), F.when(exact, F.col("value_text")).alias("value_text"),
        F.when(exact, F.col("canonical_unit")).alias("canonical_unit"), F.coalesce(F.when(exact, F.col("disputed")), F.lit(False)).alias("disputed"),
        cited.alias("citation"),
    )


def route_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("route").agg(F.count("*").alias("n"))
