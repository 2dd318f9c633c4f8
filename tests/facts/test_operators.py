"""Extraction, normalisation, versions, resolution, questions and review, on small fixtures of our own."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import answer, extract, facts, normalize, ontology, quality, query, resolve, retrieval, review, search
from factloom.plans import ingest
from factloom.sources import store
from factloom.streaming import ingest as stream

T0 = dt.datetime(2024, 5, 1, 12)
PAGE = "raw_artifact_id string, url string, canonical_url string, content string, content_type string, fetched_at timestamp, page_seq bigint"


def pages(spark, *contents, kind="text/html"):
    return spark.createDataFrame([(f"p{i}", f"https://shop.example/{i}", None, x, kind, T0, i) for i, x in enumerate(contents)], PAGE)


def found(candidates):
    rows = candidates.orderBy("raw_artifact_id", "tier_pos", "place").collect()
    return [(r.raw_attribute, r.raw_value, r.raw_unit) for r in rows]


def jsonld(data):
    return f'<html><script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script></html>'


PRODUCT = {
    "@type": "Product", "brand": {"name": "Nordwind"}, "sku": 17, "mpn": "NW-1", "gtin8": "222", "gtin13": "111", "color": "Blue", "material": " ", "size": 4, "weight": {"value": 2.50, "unitText": "kg"}, "width": "12 cm", "depth": True,
    "offers": [{"price": "19.90", "priceCurrency": "EUR"}, {"price": "5"}],
    "additionalProperty": [{"name": "Cores", "value": 8}, {"name": "", "value": 1}, {"name": "IP rating", "value": "IP67", "unitCode": ""}, {"name": "Odd", "value": True}, "x"],
}


def test_jsonld(spark):
    got = extract.jsonld(pages(spark, jsonld(PRODUCT)))
    assert found(got) == [("color", "Blue", None), ("weight", "2.5", "kg"), ("width", "12 cm", None), ("price", "19.90", "EUR"), ("Cores", "8", None), ("IP rating", "IP67", "")]
    first = got.where("raw_attribute = 'color'").first()
    assert first.detected_ids == {"sku": "17", "mpn": "NW-1", "gtin": "111", "brand": "Nordwind"} and first.confidence == 0.95
    assert first.provenance.source_span == '{"color": "Blue"}' and first.provenance.source_url == "https://shop.example/0" and first.evidence.json_path == "$.color"


def test_jsonld_nodes(spark):
    a, b, c = ({"@type": "Product", "color": x} for x in "abc")
    graph = {"@context": "x", "@graph": [a, {"@type": ["Offer", "Product"], "color": "d"}, {"@type": "Thing", "color": "no"}]}
    got = extract.jsonld(pages(spark, jsonld([a, b, [c]]), jsonld(graph), jsonld("{broken"), "<p>none</p>", "", jsonld({"@type": "Products", "color": "no"})))
    assert found(got) == [("color", "c", None), ("color", "b", None), ("color", "a", None), ("color", "d", None), ("color", "a", None)]


def test_shop_json(spark):
    product = {"vendor": "Acme", "variants": [{"sku": "S1", "barcode": 42, "price": 10, "grams": 2300}, {"sku": "S2"}], "options": [{"name": "Color", "values": ["Red"]}, {"name": "Size", "values": ["S", "M"]}, {"name": "N", "values": [1]}]}
    bare = {"variants": [{"grams": 0, "weight": 1.5, "weight_unit": "kg", "price": "3.00"}]}
    got = extract.shop_json(pages(spark, json.dumps({"product": product}), json.dumps(bare), '{"other": 1}', "<html>", "[1]", "", kind="application/json"))
    assert found(got) == [("weight", "2300", "g"), ("price", "10", None), ("Color", "Red", None), ("weight", "1.5", "kg"), ("price", "3.00", None)]
    assert got.where("raw_attribute = 'Color'").first().detected_ids == {"brand": "Acme", "sku": "S1", "gtin": "42"}


def test_spec_tables(spark):
    html = (
        "<table><tr><th>Net &amp; weight</th><td> 2.3\n kg </td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>Empty</td><td></td></tr><tr><td>Colour</td><td><b>Deep</b> red</td></tr></table>"
        f"<dl><dt>RAM</dt><dd>16 GB</dd><dd>more</dd><dt>Long</dt><dd>{'x' * 121}</dd></dl>"
    )
    got = extract.spec_tables(pages(spark, html, "<p>none</p>", None))
    assert found(got) == [("Net & weight", "2.3", "kg"), ("Colour", "Deep red", None), ("RAM", "16", "GB")]
    assert got.first().confidence == 0.6 and got.first().provenance.source_span == "Net & weight: 2.3 kg"


def test_model_facts_are_grounded(spark):
    def model(text, keys):
        return [{"attribute": keys[0], "value": "2 kg", "source_span": "weighs  2 kg", "confidence": 0.99}, {"attribute": keys[0], "value": "3 kg", "source_span": "weighs 3 kg"}, {"attribute": keys[0], "value": "5", "source_span": "weighs 2 kg"}]

    got = extract.by_model(pages(spark, "<p>It weighs 2 kg today</p>"), model, ["net_weight"]).collect()
    assert [(r.raw_value, r.confidence) for r in got] == [("2 kg", 0.85)]


def test_tiers_by_content_type(spark):
    both = pages(spark, jsonld(PRODUCT)).unionByName(pages(spark, json.dumps({"product": {"variants": [{"price": "1"}]}}), kind="application/json"))
    assert {r.extraction_tier for r in extract.extract(both).select("provenance.extraction_tier").collect()} == {1, 2}


def normal(spark, rows, learned=None):
    onto = ontology.ontology(spark)
    df = spark.createDataFrame([(a, v, u, {"source_url": "x"}, i) for i, (a, v, u) in enumerate(rows)], "raw_attribute string, raw_value string, raw_unit string, provenance struct<source_url: string>, n int")
    return {r.n: r for r in normalize.normalized(df, onto, ontology.with_learned(ontology.labels(onto), learned)).collect()}


def test_ontology(spark):
    onto = ontology.ontology(spark)
    labels = ontology.labels(onto)
    assert onto.count() == 31 and labels.count() == labels.select("label").distinct().count() == 171


def test_normalize(spark):
    got = normal(spark, [("Weight", "2,3", "kg"), ("вага", "900 g", None), ("Mystery", "1", None), ("Weight", "heavy", None), ("weight", "900", "kg"), ("COLOUR", " Red ", None), ("RAM", "1", "TB"), ("Cores", "20 cores", None), ("weight", "1", "cm"), ("Net weight", "500", "kg")])
    assert [got[i].reason for i in range(10)] == ["ok", "ok", "unmapped", "unparseable", "out_of_constraints", "ok", "ok", "ok", "unparseable", "ok"]
    assert (got[0].attribute_key, got[0].value_num, got[0].canonical_unit, got[0].original_value) == ("net_weight", 2300.0, "g", "2,3 kg")
    assert (got[5].value_text, got[5].value_num, got[5].canonical_unit) == ("Red", None, None) and got[6].value_num == 1024.0 and got[7].value_num == 20.0


def test_learned_mappings_come_first(spark):
    learned = spark.createDataFrame([("Mystery", "en", [], "color", T0), ("mystery!", "uk", [], "material", T0 + dt.timedelta(1)), ("Weight", "en", [], "nowhere", T0)], "raw_attribute string, language string, category_path array<string>, attribute_key string, confirmed_at timestamp")
    got = normal(spark, [("Mystery", "x", None), ("weight", "1", None)], learned)
    assert got[0].attribute_key == "material" and got[1].reason == "unmapped"
    again = learned.unionByName(learned.withColumn("confirmed_at", F.expr("confirmed_at + interval 1 day")).withColumn("attribute_key", F.lit("z")))
    assert {r.attribute_key for r in ontology.learn_mappings(again).collect()} == {"z"}
    assert ontology.mapping(learned, "Mystery", "en", []).count() == 1


OBS = "product_id string, attribute_key string, seq bigint, fact_id string, value_num double, value_text string, canonical_unit string, source_type string, source_url string, source_span string, fetched_at timestamp, confidence double"


def obs(n, value, kind, url, at=0, confidence=0.9, key="k", span=None):
    return ("p", key, n, f"f{n}", value, None, "g", kind, url, span or str(value), T0 + dt.timedelta(hours=at), confidence)


def replay(rows):
    """The definition, on lists."""
    log, now = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        key, cur = r[:2], now.get(r[:2])
        if cur is None:
            log[r[3]], now[key] = [True, False, None], r
            continue
        if (cur[4], cur[6], cur[8], cur[9]) == (r[4], r[6], r[8], r[9]):
            continue
        if cur[8] == r[8]:
            log[cur[3]][0], log[cur[3]][2] = False, r[3]
            log[r[3]], now[key] = [True, False, None], r
            continue
        a, b = (facts.AUTHORITY.get(x[7], 5) for x in (cur, r))
        wins = b < a if a != b else r[10] > cur[10] if r[10] != cur[10] else r[11] >= cur[11]
        d = a == b and (cur[4], cur[6]) != (r[4], r[6])
        log[r[3]] = [wins, d, None]
        log[cur[3]][:2] = [not wins, d]
        if wins:
            now[key] = r
    return {k: tuple(v) for k, v in log.items()}


def state(df):
    return {r.fact_id: (r.effective, r.disputed, r.superseded_by) for r in df.collect()}


def test_versions_by_hand(spark):
    rows = [obs(1, 2400.0, "dom", "a"), obs(2, 2300.0, "json_ld", "b"), obs(3, 2350.0, "json_ld", "c", at=1), obs(4, 2360.0, "json_ld", "c", at=2), obs(5, 2360.0, "json_ld", "c", at=9)]
    got = state(facts.versions(spark.createDataFrame(rows, OBS)))
    assert got == {"f1": (False, False, None), "f2": (False, True, None), "f3": (False, True, "f4"), "f4": (True, False, None)}


@pytest.fixture(scope="module")
def history():
    random.seed(6)
    return [obs(n, float(random.randint(1, 3)), random.choice(["dom", "json_ld", "feed", "?"]), random.choice("abc"), random.randint(0, 3), random.choice([0.5, 0.9]), random.choice("xyz"), random.choice("st")) for n in range(400)]


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_versions_at_random(spark, history, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert state(facts.versions(spark.createDataFrame(history, OBS).repartition(7))) == replay(history)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert facts.versions(spark.createDataFrame([], OBS)).count() == 0


def test_stream_equals_batch(spark, history, tmp_path):
    for k in range(3):
        spark.createDataFrame(history[k * 150 : (k + 1) * 150], OBS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream.versions(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = stream.last_changes(spark.read.parquet(f"{tmp_path}/out"))
    assert state(got) == replay(history)


def test_upsert_sink(spark, history, tmp_path):
    for k in range(3):
        spark.createDataFrame(history[k * 150 : (k + 1) * 150], OBS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream.upsert(stream.versions(source), f"{tmp_path}/log", f"{tmp_path}/c")
    assert run.awaitTermination(120)
    schema = stream.last_changes(stream.versions(spark.createDataFrame([], OBS))).schema
    assert state(stream.fact_log(spark, f"{tmp_path}/log", schema)) == replay(history)


def test_as_of(spark):
    rows = [("f1", T0, "f2"), ("f2", T0 + dt.timedelta(5), None), ("f3", T0 + dt.timedelta(1), None)]
    log = spark.createDataFrame(rows, "fact_id string, valid_from timestamp, superseded_by string")
    assert {r.fact_id for r in facts.as_of(log, F.lit(T0 + dt.timedelta(2))).collect()} == {"f1", "f3"}


FACTS = "product_id string, fact_id string, attribute_key string, value_num double, value_text string, canonical_unit string, original_value string, disputed boolean, source_url string, source_span string, fetched_at timestamp"


@pytest.fixture(scope="module")
def current(spark):
    rows = [("a", 250.0, "IP67"), ("b", 900.0, "IP54"), ("c", 300.0, None)]
    out = []
    for p, weight, rating in rows:
        out.append((p, p + "1", "net_weight", weight, None, "g", f"{weight / 1000} kg", p == "b", f"https://x/{p}", "w", T0))
        if rating:
            out.append((p, p + "2", "ip_rating", None, rating, None, rating, False, f"https://y/{p}", "r", T0 + dt.timedelta(1)))
    return spark.createDataFrame(out, FACTS)


@pytest.mark.parametrize(
    "constraints, want",
    [([("net_weight", "lt", 500)], "ac"), ([("net_weight", "lt", 500), ("ip_rating", "eq", "IP67")], "a"), ([("ip_rating", "ne", "IP67")], "b"), ([("net_weight", "eq", 300)], "c"), ([("net_weight", "eq", "300.0")], "c"), ([("net_weight", "eq", "300")], ""), ([("ip_rating", "gt", 5)], ""), ([], ""), ([("net_weight", "gte", 250), ("net_weight", "lte", 300)], "ac")],
)
def test_filter(current, constraints, want):
    assert "".join(r[0] for r in query.filter_products(current, [query.Constraint(*c) for c in constraints]).collect()) == want


def test_filter_limit_and_errors(current):
    assert [r[0] for r in query.filter_products(current, [query.Constraint("net_weight", "gt", 0)], 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        query.holds(query.Constraint("x", "like", "y"))


def test_compare(current):
    got = query.compare(current, ["c", "zz", "a"], ["ip_rating", "net_weight"]).collect()
    assert [(r.product_id, sorted(r.cells)) for r in got] == [("c", ["net_weight"]), ("zz", []), ("a", ["ip_rating", "net_weight"])]
    assert got[0].cells["net_weight"].value == "300.0"


def test_lookups(current):
    assert facts.product_fact(current, "a", "ip_rating").first().value_text == "IP67" and facts.product_fact(current, "a", "ram").count() == 0
    assert [r.attribute_key for r in facts.product_facts(current, "a").collect()] == ["ip_rating", "net_weight"]


REFS = "seq bigint, product_id string, gtin string, mpn string, brand string, model string, source_url string"


def ladder(rows):
    tables, out = ({}, {}, {}), {}
    for seq, known, gtin, mpn, brand, model, _ in sorted(rows):
        keys = (gtin or None, (mpn, brand) if mpn and brand is not None else None, (brand, model.lower()) if brand is not None and model is not None else None)
        got = None if known else next((t[k] for t, k in zip(tables, keys) if k is not None and k in t), None)
        if got is None:
            got = known or seq
            for t, k in zip(tables, keys):
                if k is not None:
                    t.setdefault(k, got)
        out[seq] = got
    return out


def test_resolve_or_create(spark):
    random.seed(8)
    rows = [(-2, "old1", "g1", None, None, None, "u"), (-1, "old2", None, "m1", "b1", "X", "u")]
    rows += [(i, None, random.choice([None, "", *(f"g{k}" for k in range(40))]), random.choice([None, *(f"m{k}" for k in range(40))]), random.choice([None, "b1", "b2"]), random.choice(["x", "X", "y", "z", None]), f"u{i % 5}") for i in range(120)]
    got = {r.seq: r.resolved for r in resolve.resolve_or_create(spark.createDataFrame(rows, REFS)).collect()}
    want = ladder(rows)
    names = {}
    assert len(got) == len(rows)
    for seq in want:
        assert names.setdefault(want[seq], got[seq]) == got[seq]
    assert len(set(names.values())) == len(names) and got[-2] == "old1"
    again = {r.seq: r.resolved for r in resolve.resolve_or_create(spark.createDataFrame(rows, REFS).repartition(9)).collect()}
    assert again == got


def test_sources_accumulate(spark):
    products = spark.createDataFrame([("p", ["b"]), ("q", None)], "product_id string, source_urls array<string>")
    seen = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", None), ("q", "")], "resolved string, source_url string")
    got = {r.product_id: r.source_urls for r in resolve.with_sources(products, seen).collect()}
    assert got == {"p": ["a", "b"], "q": []} and resolve.product(products, "p").count() == 1


def test_ladder(spark):
    products = spark.createDataFrame([("p1", "g1", "m1", "B", "One"), ("p2", None, "m1", "B", "two"), ("p0", "g9", None, "b", "one"), ("p3", "", "", "B", "two")], "product_id string, gtin string, mpn string, brand string, model string")
    refs = spark.createDataFrame([(1, "g9", "m1", "B", "One"), (2, None, "m1", "B", None), (3, "", "", "B", "TWO"), (4, None, None, "b", "two"), (5, None, None, None, None)], "n int, gtin string, mpn string, brand string, model string")
    assert {r.n: r.product_id for r in resolve.resolve(refs, products).collect()} == {1: "p0", 2: "p1", 3: "p2", 4: None, 5: None}


@pytest.fixture(scope="module")
def chunked(spark, current):
    products = spark.createDataFrame([("a", "Nord", "A1", ["x", "y"]), ("b", "Sud", "B1", ["x"]), ("c", "Nord", None, []), ("d", "Nord", "none", [])], "product_id string, brand string, model string, category_path array<string>")
    return retrieval.chunks(products, current)


def test_chunks(chunked):
    got = {r.product_id: r for r in chunked.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].body == "[Brand: Nord] [Model: A1] [Category: x/y]\nip rating: IP67.\nnet weight: 250.0 g.\nSource: https://y/a, as of 2024-05-02."
    assert got["c"].body.startswith("[Brand: Nord] [Model: None] [Category: ]\n") and got["a"].attribute_keys == ["ip_rating", "net_weight"]
    assert retrieval.replace_chunks(chunked, chunked.where("product_id = 'a'").withColumn("body", F.lit("new"))).where("body = 'new'").count() == 1
    assert retrieval.eligible(chunked, "Nord", "y").count() == 1


def test_search(spark, chunked):
    asked = spark.createDataFrame([(1, "IP54 rating", None), (2, "IP54 rating", "Nord"), (3, "кружка", "Sud"), (4, "кружка", "Nobody")], "question_id int, text string, brand string")
    got = {}
    for r in search.search(chunked, asked, 2).join(chunked.select("chunk_id", "product_id"), "chunk_id").orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.product_id)
    assert got[1][0] == "b" and got[2][0] == "a" and got[3] == ["b"] and 4 not in got and len(got[1]) == 2
    best = retrieval.bm25(chunked, asked.where("question_id = 1")).where("rank = 1").join(chunked, "chunk_id").first()
    assert best.product_id == "b"


def test_questions(spark):
    said = {1: "What is the net weight?", 2: "weight of this", 3: "Яка вага?", 4: "max refresh rate please", 5: "counterweight", 6: "", 7: "of cores and threads"}
    onto = ontology.ontology(spark)
    got = {r.question_id: r.attribute_key for r in answer.asked_attributes(spark.createDataFrame(list(said.items()), "question_id int, text string"), ontology.labels(onto)).collect()}
    assert got == {1: "net_weight", 2: "net_weight", 3: "net_weight", 4: "refresh_rate", 7: "cores"} or got[7] in ("cores", "threads")


def test_answers(spark, current, chunked):
    rows = [(1, "net weight?", "b", None), (2, "ram?", "a", None), (3, "hello", "a", None), (4, "net weight?", None, None)]
    asked = spark.createDataFrame(rows, "question_id int, text string, product_id string, brand string")
    labels = ontology.labels(ontology.ontology(spark))
    got = {r.question_id: r for r in answer.answer(asked, labels, current).collect()}
    assert got[1].answer == "net weight: 900.0 g (as reported: 0.9 kg) (sources disagree; see citation). Source: https://x/b, as of 2024-05-01." and got[1].citation.source_url == "https://x/b"
    assert (got[2].route, got[2].answer) == ("refused", "No data for 'ram' on this product.") and got[3].route == "ambiguous" and got[4].answer == answer.NO_PRODUCT
    near = {r.question_id: r for r in answer.answer(asked, labels, current, chunked).collect()}
    assert [near[i].route for i in (1, 2, 3, 4)] == ["exact_lookup", "hybrid", "hybrid", "hybrid"] and near[2].found and near[2].answer.startswith("Based on")


def test_review(spark):
    new = spark.createDataFrame([("attribute_mapping", "x", 1, 100, T0, '{"raw_attribute": "Mystery"}'), ("attribute_mapping", "x", 2, 100, T0, "{}"), ("value_anomaly", "x", 3, 5, T0, "{}"), ("value_anomaly", None, 4, 5, T0, "{}"), ("value_anomaly", None, 5, 1, T0, "{}")], "queue string, dedup string, place int, priority int, created_at timestamp, payload string")
    items = review.enqueue(None, new, ["place"])
    assert sorted(r.place for r in items.collect()) == [1, 3, 4, 5]
    assert sorted(r.place for r in review.enqueue(items, new, ["place"]).collect()) == [4, 5]
    assert {r.queue: r.n_open for r in review.open_counts(items).collect()} == {"attribute_mapping": 1, "low_confidence_fact": 0, "disputed_fact": 0, "entity_resolution": 0, "value_anomaly": 3}
    assert [r.place for r in review.open_items(items, "value_anomaly", 2).collect()] == [5, *[min(3, 4, key=lambda k: items.where(f"place = {k}").first().item_id)]]
    with pytest.raises(ValueError):
        review.open_items(items, "nope")
    one = items.where("place = 1").first().item_id
    decisions = spark.createDataFrame([(one, "resolved", "ann", '{"attribute_key": "color"}', T0), (one, "rejected", "bob", "{}", T0 + dt.timedelta(1))], "item_id string, status string, resolved_by string, resolution string, resolved_at timestamp")
    done = review.resolve(items, decisions)
    assert done.where("status = 'resolved'").first().resolved_by == "ann" and review.item(done, one).count() == 1
    assert [(r.raw_attribute, r.attribute_key) for r in review.learned(done).collect()] == [("Mystery", "color")]
    assert review.resolve(done, decisions.withColumn("resolved_by", F.lit("eve"))).where("resolved_by = 'eve'").count() == 0


def test_expected_values_keep_their_json_type(spark, tmp_path):
    at = tmp_path / "acme" / "things" / "one"
    at.mkdir(parents=True)
    (at / "source.html").write_text("")
    (at / "expected.json").write_text(json.dumps({"expected": {"a": "5.3", "b": 5.3, "c": 7, "d": "x"}}))
    _, want = store.cases(spark, str(tmp_path))
    assert {r.attribute_key: (r.want_num, r.want_text) for r in want.collect()} == {"a": (None, "5.3"), "b": (5.3, None), "c": (7.0, None), "d": (None, "x")}


def test_quality(spark, tmp_path):
    root = tmp_path / "cases"
    for slug, html, want in [("one", "<table><tr><td>Weight</td><td>1.5 kg</td></tr><tr><td>Color</td><td>Red</td></tr></table>", {"net_weight": 1500, "color": "Red"}), ("two", jsonld({"@type": "Product", "weight": {"value": 2, "unitText": "kg"}, "color": "Blue"}), {"net_weight": 1999, "color": "Blue", "ram": 8})]:
        at = root / "acme" / "things" / slug
        at.mkdir(parents=True)
        (at / "source.html").write_text(html)
        (at / "expected.json").write_text(json.dumps({"product": {"source_url": f"https://acme.example/{slug}"}, "expected": want}))
    artifacts, want = store.cases(spark, str(root))
    onto = ontology.ontology(spark)
    rows = normalize.normalized(extract.extract(artifacts), onto, ontology.labels(onto)).where("reason = 'ok'")
    got = rows.select(F.col("raw_artifact_id").alias("case_id"), "attribute_key", "value_num", "value_text", F.col("provenance.extraction_tier").alias("tier"), "tier_pos", "place")
    out = quality.outcomes(want, got)
    assert {(r.case_id[-3:], r.attribute_key): r.status for r in out.collect()} == {("one", "net_weight"): "correct", ("one", "color"): "correct", ("two", "net_weight"): "wrong", ("two", "color"): "correct", ("two", "ram"): "missing"}
    card = quality.scorecard(out)
    overall = card.where("level = 3").first()
    assert (overall.n_cases, overall.n_expected, overall.n_correct, overall.n_wrong, overall.n_missing, overall.accuracy, overall.coverage) == (2, 5, 3, 1, 1, 0.75, 0.8)
    assert card.count() == 4 and "overall" in quality.text_report(card)
    assert {(r.tier, r.n) for r in quality.tier_counts(out).collect()} == {(3, 2), (1, 2)}
    store.write_report(card, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 4


def test_rates(spark):
    pairs = spark.createDataFrame([("a", "a"), (None, None), ("b", "c")], "g string, w string")
    assert quality.answer_accuracy(pairs, "g", "w").first()[0] == pytest.approx(2 / 3) and quality.answer_accuracy(pairs.limit(0), "g", "w").first()[0] == 0.0
    assert {r.label: r.share for r in quality.distribution(pairs, "g").collect()} == {"a": pytest.approx(1 / 3), "b": pytest.approx(1 / 3), None: pytest.approx(1 / 3)}


def test_raw_store(spark, tmp_path):
    raw = store.as_artifacts(spark.createDataFrame([("https://A.b/x", "one", "text/html", T0), ("https://a.b/y", "one", "text/html", T0 + dt.timedelta(1)), ("https://a.b/x", "two", "text/html", T0)], "url string, content string, content_type string, fetched_at timestamp"))
    assert {r.raw_artifact_id.rsplit("/", 1)[0] for r in raw.collect()} == {"raw/a.b"} and raw.select("raw_artifact_id").distinct().count() == 2
    store.put(raw, f"{tmp_path}/raw")
    stored = spark.read.parquet(f"{tmp_path}/raw")
    assert stored.count() == 2 and store.new_artifacts(raw, stored).count() == 0
    one = stored.first().raw_artifact_id
    assert store.get(spark, f"{tmp_path}/raw", one).count() == 1 and store.existing(raw.select("raw_artifact_id"), stored).count() == 3
    late = stored.withColumn("canonical_url", F.lit("https://a.b/x"))
    assert store.latest(late).count() == 1


def test_fetch(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("gone")
        return f"<p>{url}</p>", "text/html"

    got = store.fetched(spark.createDataFrame([("https://a.b/1",), ("https://a.b/bad",)], "url string"), fetch, F.lit(T0)).collect()
    assert [r.content for r in got] == ["<p>https://a.b/1</p>"]


def test_ingest(spark):
    html = jsonld({"@type": "Product", "gtin13": "111", "color": "Blue", "weight": {"value": 2, "unitText": "kg"}, "offers": {"price": "5"}}) + "<table><tr><td>Weight</td><td>2.1 kg</td></tr></table>"
    other = "<table><tr><td>Weight</td><td>900 kg</td></tr><tr><td>Colour</td><td>Red</td></tr></table>"
    raw = pages(spark, html, other)
    refs = spark.createDataFrame([("p0", 0, None, None, None, None, None, "https://shop.example/0"), ("p1", 1, None, "111", None, None, None, "https://shop.example/1")], "raw_artifact_id string, " + REFS)
    out = ingest.ingest(raw, refs, F.lit(T0))
    assert out.products.count() == 1 and sorted(out.products.first().source_urls) == ["https://shop.example/0", "https://shop.example/1"]
    log = {(r.attribute_key, r.source_type, r.source_url[-1]): (r.effective, r.superseded_by is not None) for r in out.versions.collect()}
    assert log[("net_weight", "dom", "0")] == (True, False) and log[("net_weight", "json_ld", "0")] == (False, True) and log[("color", "json_ld", "0")] == (True, False)
    assert {(r.queue, r.dedup) for r in out.review_items.collect()} == {("attribute_mapping", "price"), ("value_anomaly", "Weight:900")}
    counts = {r.raw_artifact_id: (r.candidates, r.facts_written, r.facts_unmapped, r.hitl_enqueued) for r in out.counts.collect()}
    assert counts == {"p0": (4, 3, 1, 1), "p1": (2, 1, 0, 1)}
