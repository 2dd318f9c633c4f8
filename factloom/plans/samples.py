"""The reference tables as inputs of the fact operators: pages made of parts, observations and review items made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import json_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page(rows: DataFrame, content, kind: str) -> DataFrame:
    return rows.select(
        F.col("p_partkey").cast("string").alias("raw_artifact_id"), F.concat(
            F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string"),
        ).alias("url"), F.lit(None).cast("string").alias("canonical_url"),
        content.alias("content"), F.lit(kind).alias("content_type"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched_at"), F.col("p_partkey").alias("page_seq"),
    )


def spec_pages(part: DataFrame, content=None) -> DataFrame:
    html = content if content is not None else F.format_string(
        "<html><body><table><tr><th>Weight</th><td>%d kg</td></tr><tr><th> Material </th><td>%s</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"
        "<dl><dt>Colour</dt><dd>%s</dd><dt>Cores</dt><dd>%d</dd><dt>Unheard of</dt><dd>x</dd></dl></body></html>",
        "p_size", "p_name", "p_brand", "p_size",
    )
    return _page(part, html, "text/html")


def jsonld_pages(part: DataFrame) -> DataFrame:
    body = F.concat(
        F.lit('{"@context":"https://schema.org","@type":["Thing","Product"],"name":'), json_text(F.col("p_name")), F.lit(',"brand":{"name":'), json_text(F.col("p_brand")),
        F.lit('},"mpn":"M'), F.col("p_partkey").cast("string"), F.lit('","material":'), json_text(F.col("p_type")), F.lit(',"weight":{"value":'), F.col("p_size").cast("string"),
        F.lit(',"unitText":"kg"},"offers":[{"price":"'), F.format_string("%.2f", "p_retailprice"), F.lit('","priceCurrency":"USD"}],"additionalProperty":[{"name":"Cores","value":'), F.col("p_size").cast("string"), F.lit("}]}"),
    )
    return _page(part, F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>")), "text/html")


def graph_pages(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    first = F.concat(F.lit('{"@type":"Product","mpn":"M'), key, F.lit('","color":'), json_text(F.col("p_brand")), F.lit("}"))
    second = F.concat(F.lit('{"@type":"Product","mpn":"N'), key, F.lit('","material":'), json_text(F.col("p_type")), F.lit("}"))
    body = F.concat(F.lit('[[[[[[{"@graph":[{"@type":"Thing"},'), first, F.lit(',{"@graph":[['), second, F.lit("]]}]}]]]]]]"))
    block = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit('</script><script type="application/ld+json">{"@type":</script>'))
    return _page(part, block, "text/html")


def shop_pages(part: DataFrame) -> DataFrame:
    body = F.concat(
        F.lit('{"product":{"vendor":'), json_text(F.col("p_brand")), F.lit(',"variants":[{"sku":"S'), F.col("p_partkey").cast("string"), F.lit('","barcode":"'), F.col("p_partkey").cast("string"),
        F.lit('","price":"'), F.format_string("%.2f", "p_retailprice"), F.lit('","grams":'), (F.col("p_size") * 100).cast("string"), F.lit('}],"options":[{"name":"Material","values":['), json_text(F.col("p_type")),
        F.lit(']},{"name":"Size","values":["S","M"]}]}}'),
    )
    return _page(part, body, "application/json")


def part_facts(part: DataFrame) -> DataFrame:
    """Current facts of parts: weight in grams, and material."""
    key = F.concat(F.lit("prd_"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    base = part.select(key.alias("product_id"), "p_partkey", "p_size", "p_type", "p_brand")
    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    both = F.array(
        F.struct(
            F.lit("net_weight").alias("attribute_key"), (F.col("p_size") * 100).cast("double").alias("value_num"), none_text.alias("value_text"),
            F.lit("g").alias("canonical_unit"), F.concat((F.col("p_size") * 100).cast("string"), F.lit(" g")).alias("original_value"),
        ),
        F.struct(
            F.lit("material").alias("attribute_key"), none_num.alias("value_num"), F.col("p_type").alias("value_text"), none_text.alias("canonical_unit"),
            F.col("p_type").alias("original_value"),
        ),
    )
    rows = base.select("product_id", "p_partkey", "p_brand", F.explode(both).alias("f")).select("product_id", "p_partkey", "p_brand", "f.*")
    url = F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string"))
    return rows.where(~((F.col("attribute_key") == "material") & (F.col("p_partkey") % 7 == 0))).select(
        "product_id", F.concat("product_id", F.lit("-"), "attribute_key").alias("fact_id"), "attribute_key", "value_num", "value_text", "canonical_unit", "original_value", (F.col("p_partkey") % 5 == 0).alias("disputed"),
        url.alias("source_url"), F.col("original_value").alias("source_span"), F.timestamp_seconds(1_700_000_000 + (F.col("p_partkey") % 10) * 86400).alias("fetched_at"), F.lit(0.9).alias("confidence"),
    )


def part_products(part: DataFrame) -> DataFrame:
    key = F.concat(F.lit("prd_"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    return part.select(
        key.alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), F.split("p_type", " ").alias("category_path"),
        F.when(
            F.col("p_partkey") % 3 == 0, F.concat(F.lit("G"), (F.col("p_partkey") % 500).cast("string")),
        ).alias("gtin"), F.when(F.col("p_partkey") % 3 != 1, F.concat(F.lit("M"), (F.col("p_partkey") % 300).cast("string"))).alias("mpn"),
    )


def event_observations(events: DataFrame) -> DataFrame:
    """Events as observations of the attribute event_type of product user_id."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("json_ld", "dom", "feed", "dom", "other"))), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    return events.select(
        F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("attribute_key"), n.alias("seq"), n.cast("string").alias("fact_id"), F.pmod(n * 7 + F.floor("value").cast("long"), F.lit(3)).cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_text"), F.when(n % 4 == 0, "kg").otherwise("g").alias("canonical_unit"), kind.alias("source_type"), F.concat(F.lit("u"), F.pmod(n * 13, F.lit(4)).cast("string")).alias("source_url"),
        F.concat(F.lit("s"), F.pmod(n, F.lit(2)).cast("string")).alias("source_span"), F.date_trunc("day", "ts").alias("fetched_at"), (F.pmod(n, F.lit(3)) / 2.0).alias("confidence"),
    )
