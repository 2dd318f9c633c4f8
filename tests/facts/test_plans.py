"""Plans of steps whose inputs look smaller than they are: what is broadcast, and where pages are parsed."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import answer, extract, normalize, ontology, quality, resolve, retrieval
from factloom.plans import samples


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def part(spark):
    n = F.col("id")
    return spark.range(1, 41, numPartitions=1).select(
        n.alias("p_partkey"), F.concat(F.lit("name "), n).alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("SMALL TIN").alias("p_type"), (n % 50).cast("int").alias("p_size"), (n / 7).alias("p_retailprice"),
    )


@pytest.fixture()
def questions(part):
    n = F.col("p_partkey")
    known = F.when(n % 2 == 0, F.concat(F.lit("prd_"), F.lpad(n.cast("string"), 12, "0")))
    return part.select(n.alias("question_id"), F.lit("What is the net weight?").alias("text"), known.alias("product_id"), F.lit(None).cast("string").alias("brand"))


def test_questions_are_not_broadcast(spark, questions):
    rows = answer.asked_attributes(questions, ontology.labels(ontology.ontology(spark)))
    assert "BuildLeft" not in physical(rows) and physical(rows).count("BroadcastExchange") == 1
    assert {r.attribute_key for r in rows.collect()} == {"net_weight"} and rows.count() == 40


def test_facts_and_answers_are_not_broadcast(spark, part, questions):
    rows = answer.answer(questions, ontology.labels(ontology.ontology(spark)), samples.part_facts(part))
    assert physical(rows).count("BroadcastExchange") == 1  # the labels
    assert {r.question_id: r.route for r in rows.collect()} == {i: "refused" if i % 2 else "exact_lookup" for i in range(1, 41)}


def test_chunks_join_once_without_broadcast(part):
    rows = retrieval.chunks(samples.part_products(part).select("product_id", "brand", "model", "category_path"), samples.part_facts(part))
    assert "BroadcastExchange" not in physical(rows) and optimized(rows).count("Join Inner") == 1
    late = samples.part_facts(part.limit(1)).withColumn("fetched_at", F.when(F.col("attribute_key") == "net_weight", F.col("fetched_at"))).withColumn("source_url", F.col("attribute_key"))
    (row,) = retrieval.chunks(samples.part_products(part).select("product_id", "brand", "model", "category_path"), late).collect()
    assert row.source_url == "net_weight"  # a fact without a time isn't the latest


@pytest.mark.parametrize("kind", ["shop", "jsonld", "spec"])
def test_pages_are_dealt_before_they_are_read(spark, part, kind):
    rows = {
        "shop": lambda: extract.shop_json(samples.shop_pages(part)), "jsonld": lambda: extract.jsonld(samples.jsonld_pages(part)), "spec": lambda: extract.spec_tables(samples.spec_pages(part)),
    }[kind]()
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "parse" not in optimized(rows).split("RepartitionByExpression")[1].lower()


def test_members_of_a_node_are_read_in_one_parse(part):
    """JSON-LD members come from one parse of their node, not one each: 19 members of a node were 19 parses."""
    rows = extract.jsonld(samples.jsonld_pages(part))
    assert optimized(rows).count("get_json_object(node") == 0 and optimized(rows).count("json_tuple(node") == 1
    found = {(r.raw_attribute, r.raw_value, r.raw_unit) for r in rows.where("raw_artifact_id = '7'").collect()}
    assert found == {("material", "SMALL TIN", None), ("weight", "7", "kg"), ("price", "1.00", "USD"), ("Cores", "7", None)}


def test_kinds_of_a_node_are_read_once(part):
    """The kind of a JSON-LD member was read again at each of its uses (80 times), and objects of other types were written, parsed and split as well."""
    rows = extract.jsonld(samples.graph_pages(part))
    assert optimized(rows).lower().count("schemaofvariant(") <= len(extract.MEMBERS) + 5
    found = {(r.raw_artifact_id, r.raw_attribute, r.raw_value, r.detected_ids["mpn"]) for r in rows.collect()}
    assert found == {(str(i), *x) for i in range(1, 41) for x in (("color", "Brand#11", f"M{i}"), ("material", "SMALL TIN", f"N{i}"))}


def test_members_of_a_shop_page_are_read_once(part):
    """A variant's members and a product's were parsed out at each use: 30 parses in the plan, 21 kinds."""
    rows = extract.shop_json(samples.shop_pages(part))
    assert optimized(rows).count("json_tuple(") == 2 and optimized(rows).count("get_json_object(") <= 12
    assert optimized(rows).lower().count("schemaofvariant(") <= 9
    found = {(r.raw_attribute, r.raw_value, r.raw_unit, r.detected_ids["sku"]) for r in rows.where("raw_artifact_id = '7'").collect()}
    assert found == {("weight", "700", "g", "S7"), ("price", "1.00", None, "S7"), ("Material", "SMALL TIN", None, "S7")}


def test_ids_of_a_page_are_read_once(part):
    refs = part.select(F.col("p_partkey").cast("string").alias("raw_artifact_id"), F.lit("").alias("gtin"), F.lit(None).cast("string").alias("mpn"))
    rows = normalize.enriched(refs, extract.shop_json(samples.shop_pages(part)))
    assert "BroadcastExchange" not in physical(rows) and optimized(rows).lower().count("parsejson") <= 4
    assert all(r.gtin == r.raw_artifact_id and r.mpn is None for r in rows.collect())


def test_candidates_stay_where_their_page_was_read(spark, part):
    onto = ontology.ontology(spark)
    found = extract.spec_tables(samples.spec_pages(part))
    rows = quality.ingest_counts(normalize.normalized(found, onto, ontology.with_learned(ontology.labels(onto), None)))
    assert physical(rows).count("BroadcastHashJoin") == 2 and "hashpartitioning(_label" not in physical(rows)
    assert {tuple(r)[1:] for r in rows.collect()} == {(5, 4, 1, 1)}


def test_outcomes_are_not_broadcast(spark, part):
    expected = part.select(F.col("p_partkey").cast("string").alias("case_id"), F.lit("v").alias("vendor"), F.lit("c").alias("category"), F.lit("cores").alias("attribute_key"), F.col("p_size").cast("double").alias("want_num"), F.lit(None).cast("string").alias("want_text"))
    facts = expected.select("case_id", "attribute_key", F.col("want_num").alias("value_num"), F.col("want_text").alias("value_text"), F.lit(3).alias("tier"), F.lit(0).alias("tier_pos"), F.lit(0).alias("place"))
    rows = quality.outcomes(expected, facts)
    assert "BroadcastExchange" not in physical(rows)
    assert {r.status for r in rows.collect()} == {"correct"}


def test_references_are_not_broadcast(part):
    refs = samples.part_products(part).select(F.monotonically_increasing_id().alias("seq"), F.lit(None).cast("string").alias("product_id"), "gtin", "mpn", "brand", "model")
    rows = resolve.resolve_or_create(refs)
    assert "BroadcastExchange" not in physical(rows)
    assert rows.select("resolved").distinct().count() == 40  # no two share a key
