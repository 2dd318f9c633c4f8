"""Answers that resolve their product, labels of any length, evaluation from a folder, drops of coverage."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import answer, ontology, quality, review
from factloom.plans import benchmark

T0 = dt.datetime(2026, 1, 1)
PRODUCTS = [("p1", "Acme", "One", "111", "M1"), ("p2", "Acme", "Two", "222", "M2"), ("p3", "Other", "Two", None, "M2")]
FACTS = "product_id string, attribute_key string, value_num double, value_text string, canonical_unit string, original_value string, disputed boolean, source_url string, source_span string, fetched_at timestamp"
ASKED = "question_id int, text string, product_id string, gtin string, mpn string, brand string, model string"


@pytest.fixture
def known(spark):
    products = spark.createDataFrame(PRODUCTS, "product_id string, brand string, model string, gtin string, mpn string")
    rows = [(p, "net_weight", w, None, "g", f"{w} g", False, "https://x", "s", T0) for p, w in (("p1", 1.0), ("p2", 2.0), ("p3", 3.0))]
    return ontology.labels(ontology.ontology(spark)), spark.createDataFrame(rows, FACTS), products


def test_a_question_names_its_product(spark, known):
    labels, facts, products = known
    text = "what is the weight?"
    asked = [
        (1, text, "p1", "222", None, None, None), (2, text, None, "222", None, None, None), (3, text, "", None, "M2", "Other", None), (4, text, None, None, None, "Acme", "TWO"),
        (5, text, None, "999", "M2", "Acme", None), (6, text, None, None, "M2", None, None), (7, "is it nice", None, "111", None, None, None), (8, "the colour?", None, "111", None, None, None),
    ]
    got = {r.question_id: (r.route, r.product_id, r.value_num) for r in answer.answer(spark.createDataFrame(asked, ASKED), labels, facts, products=products).collect()}
    assert got == {
        1: ("exact_lookup", "p1", 1.0), 2: ("exact_lookup", "p2", 2.0), 3: ("exact_lookup", "p3", 3.0), 4: ("exact_lookup", "p2", 2.0),
        5: ("exact_lookup", "p2", 2.0), 6: ("refused", None, None), 7: ("ambiguous", "p1", None), 8: ("refused", "p1", None),
    }


def test_labels_of_any_length(spark):
    words = " ".join(f"w{i}" for i in range(15))
    labels = spark.createDataFrame([(words, "long", 0), ("w3 w4", "short", 1)], "label string, attribute_key string, ordinal int")
    asked = spark.createDataFrame([(1, f"tell me the {words}, please"), (2, "W3-w4!"), (3, "")], "question_id int, text string")
    assert {r.question_id: r.attribute_key for r in answer.asked_attributes(asked, labels).collect()} == {1: "long", 2: "short"}
    assert answer.asked_attributes(asked, labels.limit(0)).count() == 0


def test_evaluate_root(spark, tmp_path):
    """Two cases of three tiers: what is expected is found, wrong or missing, and counted by group and tier."""
    html = '<script type="application/ld+json">{"@type":"Product","color":"Red"}</script><table><tr><td>Weight</td><td>2 kg</td></tr><tr><td>Material</td><td>Steel</td></tr><tr><td>Weight</td><td>5 kg</td></tr></table>'
    shop = json.dumps({"product": {"variants": [{"grams": 300}], "options": [{"name": "Material", "values": ["Wood"]}]}})
    for name, source, text, want in (("a/x/one", "source.html", html, {"color": "Red", "net_weight": 2000, "material": "Iron", "ip_rating": "IP67"}), ("b/x/two", "source.json", shop, {"net_weight": 300, "material": "Wood"})):
        at = tmp_path / name
        at.mkdir(parents=True)
        (at / source).write_text(text)
        (at / "expected.json").write_text(json.dumps({"expected": want, "product": {}}))
    found = benchmark.evaluate_root(spark, str(tmp_path))
    assert {(r.case_id, r.attribute_key): (r.status, r.tier) for r in found.outcomes.collect()} == {
        ("a/x/one", "color"): ("correct", 1), ("a/x/one", "net_weight"): ("correct", 3), ("a/x/one", "material"): ("wrong", 3), ("a/x/one", "ip_rating"): ("missing", None),
        ("b/x/two", "net_weight"): ("correct", 2), ("b/x/two", "material"): ("correct", 2),
    }
    card = {(r.vendor, r.category): (r.n_cases, r.n_expected, r.accuracy, r.coverage) for r in found.card.collect()}
    assert card[(None, None)] == (2, 6, 0.8, 0.8333) and card[("b", "x")] == (1, 2, 1.0, 1.0) and len(card) == 6
    assert {r.tier: r.n for r in found.tiers.collect()} == {1: 1, 2: 2, 3: 2}


def test_coverage_drops(spark):
    days = {"a": [10, 4, 4, 0, 1], "b": [5, 5, 3]}
    rows = [(k, T0 + dt.timedelta(days=i)) for k, ns in days.items() for i, n in enumerate(ns) for _ in range(n)]
    got = quality.coverage_drops(spark.createDataFrame(rows, "d string, at timestamp"), "d", "at")
    assert {(r.domain, r.day.day, r.n, r.before) for r in got.collect()} == {("a", 2, 4, 10), ("a", 5, 1, 4)}


def test_resolving_keeps_what_was_decided_before(spark):
    items = spark.createDataFrame([("i1", "q", "open", None, None, None), ("i2", "q", "resolved", "x", "old", T0)], "item_id string, queue string, status string, resolved_by string, resolution string, resolved_at timestamp")
    decided = spark.createDataFrame([("i1", "resolved", "y", "new", T0), ("i2", "dismissed", "y", "new", T0)], "item_id string, status string, resolved_by string, resolution string, resolved_at timestamp")
    got = {r.item_id: (r.status, r.resolved_by, r.resolution) for r in review.resolve(items, decided).collect()}
    assert got == {"i1": ("resolved", "y", "new"), "i2": ("resolved", "x", "old")}
    assert {r.item_id: r.resolution for r in review.resolve(items.drop("resolution"), decided).where(F.col("resolution").isNotNull()).collect()} == {"i1": "new"}
