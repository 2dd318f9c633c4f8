"""The registered queries of the fact operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text, units, urls, vectors
from factloom.operators import answer, crawl, extract, facts, normalize, ontology, quality, query, resolve, retrieval, review, search
from factloom.plans import benchmark
from factloom.plans.samples import event_observations, graph_pages, jsonld_pages, part_facts, part_products, shop_pages, spec_pages, table
from factloom.sources import store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _normal(spark, candidates):
    onto = ontology.ontology(spark)
    return normalize.normalized(candidates, onto, ontology.labels(onto))


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS page, 'net_weight' AS attribute_key, p_size * 1000.0::DOUBLE AS value_num, NULL AS value_text, 'g' AS unit, p_size || ' kg' AS original_value, 'ok' AS reason FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'material', NULL, p_name, NULL, p_name, 'ok' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'color', NULL, p_brand, NULL, p_brand, 'ok' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'cores', CAST(p_size AS DOUBLE), NULL, 'cores', CAST(p_size AS VARCHAR), 'ok' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, NULL, 'x', 'unmapped' FROM part""")
def dom_extract_normalize(spark, sf_dir):
    rows = _normal(spark, extract.spec_tables(spec_pages(table(spark, sf_dir, "part"))))
    return rows.select(F.col("raw_artifact_id").alias("page"), "attribute_key", "value_num", "value_text", F.col("canonical_unit").alias("unit"), "original_value", "reason")


@registered("""
WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS page, 'M' || p_partkey AS mpn FROM part)
SELECT page, 'material' AS name, p_type AS value, NULL AS unit, '$.material' AS path, mpn, p_brand AS brand, '{"material": "' || p_type || '"}' AS span FROM p
UNION ALL SELECT page, 'weight', CAST(p_size AS VARCHAR), 'kg', '$.weight', mpn, p_brand, '{"weight": "' || p_size || '"}' FROM p
UNION ALL SELECT page, 'price', printf('%.2f', p_retailprice), 'USD', '$.offers.price', mpn, p_brand, '{"price": "' || printf('%.2f', p_retailprice) || '"}' FROM p
UNION ALL SELECT page, 'Cores', CAST(p_size AS VARCHAR), NULL, '$.additionalProperty[0]', mpn, p_brand, '{"Cores": "' || p_size || '"}' FROM p""")
def jsonld_extract(spark, sf_dir):
    rows = extract.jsonld(jsonld_pages(table(spark, sf_dir, "part")))
    return rows.select(
        F.col("raw_artifact_id").alias("page"), F.col("raw_attribute").alias("name"), F.col("raw_value").alias("value"), F.col("raw_unit").alias("unit"),
        F.col("evidence.json_path").alias("path"), F.col("detected_ids")["mpn"].alias("mpn"), F.col("detected_ids")["brand"].alias("brand"),
        F.col("provenance.source_span").alias("span"),
    )


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS page, 'color' AS name, p_brand AS value, 'M' || p_partkey AS mpn FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'material', p_type, 'N' || p_partkey FROM part""")
def jsonld_graph(spark, sf_dir):
    """Products in nested lists and graphs, six deep; other nodes and malformed blocks give nothing."""
    rows = extract.jsonld(graph_pages(table(spark, sf_dir, "part")))
    return rows.select(F.col("raw_artifact_id").alias("page"), F.col("raw_attribute").alias("name"), F.col("raw_value").alias("value"), F.col("detected_ids")["mpn"].alias("mpn"))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS raw_artifact_id, 2 AS blocks, 1 AS failed FROM part")
def jsonld_failures(spark, sf_dir):
    return extract.jsonld_failures(graph_pages(table(spark, sf_dir, "part")))


@registered("""
WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS page FROM part)
SELECT page, 'weight' AS name, CAST(p_size * 100 AS VARCHAR) AS value, 'g' AS unit, page AS gtin, 'S' || page AS sku FROM p
UNION ALL SELECT page, 'price', printf('%.2f', p_retailprice), NULL, page, 'S' || page FROM p
UNION ALL SELECT page, 'Material', p_type, NULL, page, 'S' || page FROM p""")
def cms_extract(spark, sf_dir):
    rows = extract.shop_json(shop_pages(table(spark, sf_dir, "part")))
    return rows.select(
        F.col("raw_artifact_id").alias("page"), F.col("raw_attribute").alias("name"), F.col("raw_value").alias("value"), F.col("raw_unit").alias("unit"),
        F.col("detected_ids")["gtin"].alias("gtin"), F.col("detected_ids")["sku"].alias("sku"),
    )


@registered("""
SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 1000.0 WHEN 3 THEN 0.001 WHEN 4 THEN 28.349523125 WHEN 5 THEN 453.59237 ELSE NULL END, 6) AS grams FROM lineitem""")
def unit_convert(spark, sf_dir):
    spelled = F.element_at(F.array(*(F.lit(x) for x in ("g", " Kilograms", "mg.", "oz", "pounds", "cm", "parsec"))), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.converted(F.col("l_quantity"), spelled, F.lit("g")).alias("grams"))


@registered(r"""
SELECT p_partkey, TRY_CAST(replace(regexp_extract('abt. ' || replace(printf('%.2f', p_retailprice), '.', ',') || ' USD', '[-+]?[0-9]*[.,]?[0-9]+'), ',', '.') AS DOUBLE) AS n, TRY_CAST(NULL AS DOUBLE) AS none FROM part""")
def parse_number(spark, sf_dir):
    said = F.concat(F.lit("abt. "), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")), F.lit(" USD"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parsed_number(said).alias("n"), text.parsed_number(F.lit("n/a")).alias("none"))


@registered(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(text), '_-', '  '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS label FROM documents""")
def label_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_label(F.col("text"))).alias("label"))


def _items(spark, sf_dir):
    """Events as failed candidates: one reason for each kind of event, repeated attributes and values."""
    reason = F.element_at(F.array(*(F.lit(x) for x in ("unmapped", "unparseable", "out_of_constraints", "ok"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("raw_attribute"), F.floor("value").cast("long").cast("string").alias("raw_value"), F.lit(None).cast("string").alias("raw_unit"), reason.alias("reason"),
        F.struct(
            F.col("user_id").cast("string").alias("source_url"), F.lit("").alias("source_span"),
        ).alias("provenance"), F.lit(0).alias("tier_pos"), F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("raw_artifact_id"), F.col("ts"),
    )
    return review.enqueue(None, normalize.review_items(rows, F.col("ts")), ["place"])


ITEMS = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'attribute_mapping' ELSE 'value_anomaly' END AS queue,
                  CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type || ':' || CAST(floor(value) AS BIGINT) END AS dedup FROM events WHERE event_id % 4 < 3),
i AS (SELECT queue, dedup, min(event_id) AS event_id FROM e GROUP BY queue, dedup)
"""


@registered(ITEMS + "SELECT queue, dedup, event_id AS place FROM i")
def hitl_routing(spark, sf_dir):
    return _items(spark, sf_dir).select("queue", "dedup", "place")


@registered(ITEMS + """
SELECT q.queue, count(i.queue) AS n_open FROM (VALUES ('attribute_mapping'), ('low_confidence_fact'), ('disputed_fact'), ('entity_resolution'), ('value_anomaly')) AS q(queue) LEFT JOIN i ON i.queue = q.queue GROUP BY q.queue""")
def hitl_counts(spark, sf_dir):
    return review.open_counts(_items(spark, sf_dir))


@registered(ITEMS + "SELECT dedup, place FROM (SELECT dedup, event_id AS place, row_number() OVER (ORDER BY ts, event_id) AS n FROM i JOIN events USING (event_id) WHERE queue = 'value_anomaly') WHERE n <= 50")
def hitl_open_topk(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("item_id", F.lpad(F.col("place").cast("string"), 20, "0"))
    return review.open_items(items, "value_anomaly").select("dedup", "place")


@registered("""
SELECT label, arg_max(k, (ts, k)) AS attribute_key FROM (SELECT lower(event_type) AS label, 'a' || (user_id % 17) AS k, ts FROM events) GROUP BY label""")
def learned_mapping(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("raw_attribute"), F.lit("en").alias("language"), F.array().cast("array<string>").alias("category_path"),
        F.concat(F.lit("a"), (F.col("user_id") % 17).cast("string")).alias("attribute_key"), F.col("ts").alias("confirmed_at"),
    )
    onto = ontology.ontology(spark)
    known = ontology.with_learned(ontology.labels(onto), ontology.learn_mappings(rows))
    return known.where(F.col("attribute_key").rlike("^a[0-9]+$"))


FOLD = """
WITH RECURSIVE o AS (
  SELECT CAST(user_id AS VARCHAR) AS p, event_type AS a, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n,
         CAST((event_id * 7 + CAST(floor(value) AS BIGINT)) % 3 AS DOUBLE) AS v, CASE WHEN event_id % 4 = 0 THEN 'kg' ELSE 'g' END AS u, [1, 3, 0, 3, 5][event_id % 5 + 1] AS r,
         'u' || (event_id * 13 % 4) AS url, 's' || (event_id % 2) AS s, date_trunc('day', ts) AS t, (event_id % 3) / 2.0 AS c
  FROM events),
f AS (
  SELECT p, a, n, id AS cid, v, u, r, url, s, t, c, id AS x, CAST(NULL AS BIGINT) AS prev, FALSE AS same, FALSE AS sup, TRUE AS win, FALSE AS d FROM o WHERE n = 1
  UNION ALL
  SELECT p, a, n, CASE WHEN win THEN x ELSE prev END, CASE WHEN win THEN ov ELSE v END, CASE WHEN win THEN ou ELSE u END, CASE WHEN win THEN orr ELSE r END, CASE WHEN win THEN ourl ELSE url END,
         CASE WHEN win THEN os ELSE s END, CASE WHEN win THEN ot ELSE t END, CASE WHEN win THEN oc ELSE c END, x, prev, same, sup, win, d
  FROM (SELECT f.p, f.a, o.n, f.v, f.u, f.r, f.url, f.s, f.t, f.c, o.v AS ov, o.u AS ou, o.r AS orr, o.url AS ourl, o.s AS os, o.t AS ot, o.c AS oc, o.id AS x, f.cid AS prev,
               o.v = f.v AND o.u = f.u AND o.url = f.url AND o.s = f.s AS same,
               o.url = f.url AND NOT (o.v = f.v AND o.u = f.u AND o.s = f.s) AS sup,
               CASE WHEN o.url = f.url THEN NOT (o.v = f.v AND o.u = f.u AND o.s = f.s) WHEN o.r <> f.r THEN o.r < f.r WHEN o.t <> f.t THEN o.t > f.t ELSE o.c >= f.c END AS win,
               o.url <> f.url AND o.r = f.r AND (o.v <> f.v OR o.u <> f.u) AS d
        FROM f JOIN o ON o.p = f.p AND o.a = f.a AND o.n = f.n + 1)),
e AS (
  SELECT x AS id, n, win AS eff, d AS dis, CAST(NULL AS BIGINT) AS by_ FROM f WHERE NOT same
  UNION ALL SELECT prev, n, NOT win, CASE WHEN sup THEN NULL ELSE d END, CASE WHEN sup THEN x END FROM f WHERE prev IS NOT NULL AND NOT same),
log AS (SELECT CAST(id AS VARCHAR) AS fact_id, arg_max(eff, n) AS effective, arg_max(dis, n) FILTER (WHERE dis IS NOT NULL) AS disputed, CAST(max(by_) AS VARCHAR) AS superseded_by FROM e GROUP BY id)
"""


def _versions(spark, sf_dir):
    return facts.versions(event_observations(table(spark, sf_dir, "events")))


@registered(FOLD + "SELECT * FROM log")
def fact_versions(spark, sf_dir):
    return _versions(spark, sf_dir).select("fact_id", "effective", "disputed", "superseded_by")


@registered(FOLD + "SELECT CAST(user_id AS VARCHAR) AS product_id, event_type AS attribute_key, fact_id FROM log JOIN events ON fact_id = CAST(event_id AS VARCHAR) WHERE effective AND superseded_by IS NULL")
def facts_current(spark, sf_dir):
    return facts.current(_versions(spark, sf_dir)).select("product_id", "attribute_key", "fact_id")


@registered(FOLD + "SELECT fact_id, effective FROM log WHERE disputed")
def facts_disputed(spark, sf_dir):
    return facts.disputed(_versions(spark, sf_dir)).select("fact_id", "effective")


@registered(FOLD + """, g AS (SELECT log.*, b.ts AS valid_from FROM log JOIN events b ON fact_id = CAST(b.event_id AS VARCHAR))
SELECT g.fact_id, g.valid_from FROM g LEFT JOIN g AS h ON h.fact_id = g.superseded_by WHERE g.valid_from <= (SELECT max(ts) - INTERVAL 10 DAY FROM events) AND (h.fact_id IS NULL OR h.valid_from > (SELECT max(ts) - INTERVAL 10 DAY FROM events))""")
def facts_as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    at = events.agg(F.max("ts")).first()[0]
    rows = _versions(spark, sf_dir).join(events.select(F.col("event_id").cast("string").alias("fact_id"), F.col("ts").alias("valid_from")), "fact_id")
    return facts.as_of(rows, F.lit(at) - F.expr("INTERVAL 10 DAY")).select("fact_id", "valid_from")


def _facts(spark, sf_dir):
    return part_facts(table(spark, sf_dir, "part"))


PID = "'prd_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')"


@registered(f"SELECT {PID} AS product_id, 'net_weight' AS attribute_key, p_size * 100.0::DOUBLE AS value_num, p_partkey % 5 = 0 AS disputed FROM part WHERE p_partkey = 42")
def fact_lookup(spark, sf_dir):
    return facts.product_fact(_facts(spark, sf_dir), "prd_000000000042", "net_weight").select("product_id", "attribute_key", "value_num", "disputed")


@registered(f"""
SELECT {PID} AS product_id, 'net_weight' AS attribute_key, p_size * 100.0::DOUBLE AS value_num, NULL AS value_text FROM part WHERE p_partkey = 43
UNION ALL SELECT {PID}, 'material', NULL, p_type FROM part WHERE p_partkey = 43 AND p_partkey % 7 <> 0""")
def product_facts(spark, sf_dir):
    return facts.product_facts(_facts(spark, sf_dir), "prd_000000000043").select("product_id", "attribute_key", "value_num", "value_text")


@registered(f"SELECT {PID} AS product_id FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_partkey % 7 <> 0 AND p_size * 100 < 2500 ORDER BY 1 LIMIT 100")
def filter_products(spark, sf_dir):
    kind = table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return query.filter_products(_facts(spark, sf_dir), [query.Constraint("material", "eq", kind), query.Constraint("net_weight", "lt", 2500)])


@registered(f"SELECT {PID} AS product_id FROM part WHERE p_type <> (SELECT min(p_type) FROM part) AND p_partkey % 7 <> 0 AND p_size * 100 >= 700 AND p_size * 100 <> 900")
def filter_negated(spark, sf_dir):
    kind = table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return query.filter_products(
        _facts(spark, sf_dir),
        [query.Constraint("material", "ne", kind), query.Constraint("net_weight", "gte", 700), query.Constraint("net_weight", "ne", "900.0")], None,
    )


@registered("SELECT '' AS product_id WHERE FALSE")
def filter_empty(spark, sf_dir):
    return query.filter_products(_facts(spark, sf_dir), [])


@registered(f"""
SELECT CAST(o AS INT) AS ordinal, 'prd_' || lpad(CAST(k AS VARCHAR), 12, '0') AS product_id, CASE WHEN p_partkey IS NOT NULL THEN printf('%.1f', p_size * 100.0::DOUBLE) END AS net_weight, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS material
FROM (VALUES (0, 21), (1, 4), (2, 99999999), (3, 7)) AS q(o, k) LEFT JOIN part ON p_partkey = k""")
def compare(spark, sf_dir):
    rows = query.compare(_facts(spark, sf_dir), [f"prd_{k:012d}" for k in (21, 4, 99999999, 7)], ["net_weight", "material"])
    return rows.select("ordinal", "product_id", F.col("cells")["net_weight"]["value"].alias("net_weight"), F.col("cells")["material"]["value"].alias("material"))


LADDER = f"""
WITH p AS (SELECT {PID} AS product_id, p_brand AS brand, lower(p_name) AS model, CASE WHEN p_partkey % 3 = 0 THEN 'G' || (p_partkey % 500) END AS gtin, CASE WHEN p_partkey % 3 <> 1 THEN 'M' || (p_partkey % 300) END AS mpn FROM part),
r AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 4 = 0 THEN 'G' || (p_partkey % 700) END AS gtin, CASE WHEN p_partkey % 4 < 2 THEN 'M' || (p_partkey % 400) END AS mpn, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS brand, upper(p_name) AS model FROM part)
"""


@registered(LADDER + """, g AS (SELECT gtin, min(product_id) AS i FROM p WHERE gtin IS NOT NULL GROUP BY 1), m AS (SELECT mpn, brand, min(product_id) AS i FROM p WHERE mpn IS NOT NULL GROUP BY 1, 2), b AS (SELECT brand, model, min(product_id) AS i FROM p GROUP BY 1, 2)
SELECT ref, coalesce(g.i, m.i, b.i) AS product_id FROM r LEFT JOIN g ON g.gtin = r.gtin LEFT JOIN m ON m.mpn = r.mpn AND m.brand = r.brand LEFT JOIN b ON b.brand = r.brand AND b.model = lower(r.model)""")
def entity_ladder(spark, sf_dir):
    return resolve.resolve(_refs(table(spark, sf_dir, "part")), part_products(table(spark, sf_dir, "part"))).select("ref", "product_id")


def _refs(part):
    n = F.col("p_partkey")
    return part.select(
        n.alias("ref"), F.when(n % 4 == 0, F.concat(F.lit("G"), (n % 700).cast("string"))).alias("gtin"), F.when(n % 4 < 2, F.concat(F.lit("M"), (n % 400).cast("string"))).alias("mpn"), F.when(n % 11 > 0, F.col("p_brand")).alias("brand"), F.upper("p_name").alias("model"),
    )


def _replayed(refs: str) -> str:
    """SQL that replays references (seq, product_id, gtin, mpn, brand, model) one by one: each key's product is kept by the key's number."""
    return f"""
WITH RECURSIVE refs AS (SELECT row_number() OVER (ORDER BY seq) AS i, * FROM ({refs})),
keyed AS (SELECT i, 1 AS rung, 'g' || gtin AS k FROM refs WHERE gtin <> '' UNION ALL SELECT i, 2, 'm' || mpn || chr(1) || brand FROM refs WHERE mpn <> '' AND brand IS NOT NULL
          UNION ALL SELECT i, 3, 'b' || brand || chr(1) || lower(model) FROM refs WHERE brand IS NOT NULL AND model IS NOT NULL),
ranked AS (SELECT i, rung, dense_rank() OVER (ORDER BY k) AS k FROM keyed),
own AS (SELECT refs.i, list(k ORDER BY rung) FILTER (WHERE k IS NOT NULL) AS ks, any_value(product_id) AS given FROM refs LEFT JOIN ranked USING (i) GROUP BY refs.i),
run AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range((SELECT coalesce(max(k), 0) FROM ranked)), lambda x: CAST(NULL AS BIGINT)) AS t, CAST(NULL AS BIGINT) AS maker
  UNION ALL
  SELECT i, CASE WHEN found IS NULL THEN list_transform(t, lambda v, j: coalesce(v, CASE WHEN list_contains(ks, j) THEN i END)) ELSE t END, coalesce(found, i)
  FROM (SELECT own.i, run.t, coalesce(own.ks, []) AS ks, CASE WHEN given IS NULL THEN list_filter(list_transform(coalesce(own.ks, []), lambda k: run.t[k]), lambda x: x IS NOT NULL)[1] END AS found FROM run JOIN own ON own.i = run.i + 1))
SELECT refs.seq, coalesce(m.product_id, 'prd_' || substr(sha256(CAST(m.seq AS VARCHAR)), 1, 26)) AS resolved FROM run JOIN refs USING (i) JOIN refs m ON m.i = run.maker"""


REF = """SELECT p_partkey AS seq, CAST(NULL AS VARCHAR) AS product_id, CASE WHEN p_partkey % 4 = 0 THEN 'G' || (p_partkey % 700) END AS gtin, CASE WHEN p_partkey % 4 < 2 THEN 'M' || (p_partkey % 400) END AS mpn,
  CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS brand, upper(p_name) AS model FROM part"""


def _seq_refs(spark, sf_dir):
    refs = _refs(table(spark, sf_dir, "part")).withColumn("seq", F.col("ref")).withColumn("product_id", F.lit(None).cast("string"))
    return refs.select("seq", "product_id", "gtin", "mpn", "brand", "model", F.concat(F.lit("https://shop.example/p/"), F.col("ref").cast("string")).alias("source_url"))


@registered(_replayed(REF))
def entity_create(spark, sf_dir):
    return resolve.resolve_or_create(_seq_refs(spark, sf_dir)).select("seq", "resolved")


@registered(
    _replayed(
        REF
        + """ WHERE p_partkey % 3 > 0 UNION ALL SELECT -p_partkey, 'prd_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0'), CASE WHEN p_partkey % 3 = 0 THEN 'G' || (p_partkey % 500) END,
  CASE WHEN p_partkey % 3 <> 1 THEN 'M' || (p_partkey % 300) END, p_brand, p_name FROM part WHERE p_partkey % 7 = 0"""
    )
)
def entity_create_stored(spark, sf_dir):
    """References after the products that exist already, which come first in the order of seq."""
    part = table(spark, sf_dir, "part")
    key = F.substring("product_id", 5, 12).cast("long")
    stored = part_products(part.where("p_partkey % 7 = 0")).select(
        (-key).alias("seq"), "product_id", "gtin", "mpn", "brand", "model", F.lit(None).cast("string").alias("source_url"),
    )
    return resolve.resolve_or_create(_seq_refs(spark, sf_dir).where("seq % 3 > 0").unionByName(stored)).select("seq", "resolved")


@registered(r"""
SELECT h AS host, string_agg(u, ' ' ORDER BY u) AS source_urls, count(*) AS n FROM (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h, url AS u FROM pages) GROUP BY h""")
def source_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("resolved"), F.col("url").alias("source_url"))
    products = pages.select(F.col("resolved").alias("product_id")).distinct().withColumn("source_urls", F.array().cast("array<string>"))
    rows = resolve.with_sources(products, pages)
    return rows.select(F.col("product_id").alias("host"), F.array_join("source_urls", " ").alias("source_urls"), F.size("source_urls").cast("long").alias("n"))


CANONICAL = r"""
WITH c AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare FROM pages),
q AS (SELECT page_id, regexp_extract(bare, '^([^?]*)', 1) AS head, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|yclid|mc_eid|_ga|ref|ref_)(=|$)'))) AS l FROM c),
u AS (SELECT page_id, lower(regexp_extract(head, '^([a-zA-Z]+://[^/]*)', 1)) || CASE WHEN regexp_replace(head, '^[a-zA-Z]+://[^/]*', '') = '' THEN '/' ELSE regexp_replace(head, '^[a-zA-Z]+://[^/]*', '') END || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS canonical_url FROM q)
"""


@registered(CANONICAL + "SELECT page_id, canonical_url FROM u")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@registered(CANONICAL + "SELECT canonical_url, min(page_id) AS page_id, count(*) AS n FROM u GROUP BY 1")
def url_dedupe(spark, sf_dir):
    return urls.deduped(table(spark, sf_dir, "pages"), "page_id")


@registered("""
WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, max(t - i * 7200000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 7200000000 AS granted_us FROM n""")
def rate_limit(spark, sf_dir):
    return crawl.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 7200).select("event_id", F.unix_micros("granted_at").alias("granted_us"))


@registered("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def raw_dedupe(spark, sf_dir):
    return store.by_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@registered("""
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
SELECT h AS content_hash, min(doc_id) AS doc_id FROM d WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0) GROUP BY h""")
def raw_new(spark, sf_dir):
    """New artifacts of a batch that repeats some of itself and of what is stored."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    batch = docs.select(F.sha2("text", 256).alias("raw_artifact_id"), F.timestamp_seconds("doc_id").alias("fetched_at"), F.lit("").alias("url"), "doc_id")
    return store.new_artifacts(batch, batch.where("doc_id % 3 = 0")).select(F.col("raw_artifact_id").alias("content_hash"), "doc_id")


@registered(CANONICAL + "SELECT canonical_url, page_id FROM (SELECT canonical_url, page_id, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id % 7 DESC, lpad(CAST(page_id AS VARCHAR), 12, '0') DESC) AS n FROM u) WHERE n = 1")
def latest_artifact(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical_url(F.col("url")).alias("canonical_url"), F.timestamp_seconds(F.col("page_id") % 7).alias("fetched_at"),
        F.lpad(F.col("page_id").cast("string"), 12, "0").alias("raw_artifact_id"),
    )
    return store.latest(pages).select("canonical_url", "page_id")


@registered(r"""
SELECT doc_id, contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(s, '\s+', ' ', 'g'))) AND contains(lower(s), lower(trim(v))) AND trim(s) <> '' AND trim(v) <> '' AS grounded
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 40) WHEN doc_id % 3 = 1 THEN substr(text, 11, 20) || 'zq' ELSE '  ' END AS s, CASE WHEN doc_id % 2 = 0 THEN substr(text, 15, 5) ELSE 'not there' END AS v FROM documents)""")
def grounding(spark, sf_dir):
    n, t = F.col("doc_id"), F.col("text")
    span = F.when(n % 3 == 0, F.substring(t, 11, 40)).when(n % 3 == 1, F.concat(F.substring(t, 11, 20), F.lit("zq"))).otherwise("  ")
    value = F.when(n % 2 == 0, F.substring(t, 15, 5)).otherwise("not there")
    return table(spark, sf_dir, "documents").select("doc_id", text.grounded(t, span, value).alias("grounded"))


def _chunks(spark, sf_dir):
    return retrieval.chunks(part_products(table(spark, sf_dir, "part")).select("product_id", "brand", "model", "category_path"), _facts(spark, sf_dir))


CHUNK = f"""
WITH c AS (SELECT p_partkey, {PID} AS product_id, p_brand AS brand, '[Brand: ' || p_brand || '] [Model: ' || p_name || '] [Category: ' || replace(p_type, ' ', '/') || ']' || chr(10)
  || CASE WHEN p_partkey % 7 <> 0 THEN 'material: ' || p_type || '.' || chr(10) ELSE '' END || 'net weight: ' || printf('%.1f', p_size * 100.0::DOUBLE) || ' g.' || chr(10)
  || 'Source: https://shop.example/p/' || p_partkey || ', as of ' || strftime(make_timestamp((1700000000 + p_partkey % 10 * 86400) * 1000000), '%Y-%m-%d') || '.' AS body FROM part)
"""


@registered(CHUNK + "SELECT product_id, body, CASE WHEN p_partkey % 7 <> 0 THEN 'material,net_weight' ELSE 'net_weight' END AS attribute_keys FROM c")
def chunk_body(spark, sf_dir):
    return _chunks(spark, sf_dir).select("product_id", "body", F.array_join("attribute_keys", ",").alias("attribute_keys"))


@registered("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(sha1(w), 1, 8)) AS BIGINT) % 1024 AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, bucket, n FROM b""")
def hash_embed(spark, sf_dir):
    return vectors.hashed_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERY_VECTOR = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
NEAR = "SELECT vec_id, round(distance, 6) AS distance FROM (SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(" + str(QUERY_VECTOR) + " AS DOUBLE[])) AS distance FROM embeddings) WHERE {} ORDER BY distance, vec_id LIMIT 10"


@registered(NEAR.format("TRUE"))
def dense_topk(spark, sf_dir):
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, "vec_id", limit=10).select("vec_id", F.round("distance", 6).alias("distance"))


@registered(NEAR.format("label = 3"))
def dense_topk_filtered(spark, sf_dir):
    return retrieval.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), QUERY_VECTOR, "vec_id", limit=10).select("vec_id", F.round("distance", 6).alias("distance"))


@registered("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.vec_id AS question_id, r.vec_id, round(abs(list_cosine_distance(q.e, r.e)), 6) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.e, r.e), 12), r.vec_id) AS INT) AS rank
FROM v q, v r WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def dense_topk_join(spark, sf_dir):
    """The ten nearest of all vectors for each vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.nearest_join(rows, asked, "vec_id", limit=10).select("question_id", "vec_id", F.round(F.abs("distance"), 6).alias("distance"), "rank")


def _questions(spark, sf_dir):
    n = F.col("p_partkey")
    asked = F.element_at(F.array(*(F.lit(x) for x in ("What is the net weight of it?", "Which MATERIAL, please", "battery life?", "is it good"))), (n % 4 + 1).cast("int"))
    known = F.when(n % 6 < 4, F.concat(F.lit("prd_"), F.lpad(n.cast("string"), 12, "0")))
    return table(spark, sf_dir, "part").select(n.alias("question_id"), asked.alias("text"), known.alias("product_id"), F.lit(None).cast("string").alias("brand"))


def _labels(spark):
    return ontology.labels(ontology.ontology(spark))


@registered("""
SELECT p_partkey AS question_id, ['net_weight', 'material', 'battery_life'][p_partkey % 4 + 1] AS attribute_key FROM part WHERE p_partkey % 4 < 3""")
def question_attribute(spark, sf_dir):
    return answer.asked_attributes(_questions(spark, sf_dir), _labels(spark))


ROUTE = """
WITH q AS (SELECT p_partkey AS question_id, p_partkey % 4 AS a, p_partkey % 6 < 4 AS known, p_size, p_type, p_partkey % 7 = 0 AS bare, p_partkey % 5 = 0 AS disputed,
   ' Source: https://shop.example/p/' || p_partkey || ', as of ' || strftime(make_timestamp((1700000000 + p_partkey % 10 * 86400) * 1000000), '%Y-%m-%d') || '.' AS cite FROM part),
r AS (SELECT *, CASE WHEN known AND (a = 0 OR a = 1 AND NOT bare) THEN 'exact_lookup' WHEN a = 3 THEN 'ambiguous' ELSE 'refused' END AS route FROM q)
"""


@registered(ROUTE + """SELECT question_id, route = 'exact_lookup' AS found, route, CASE
  WHEN route = 'exact_lookup' THEN CASE WHEN a = 0 THEN 'net weight: ' || printf('%.1f', p_size * 100.0::DOUBLE) || ' g (as reported: ' || p_size * 100 || ' g)' ELSE 'material: ' || p_type END || CASE WHEN disputed THEN ' (sources disagree; see citation).' ELSE '.' END || cite
  WHEN route = 'ambiguous' THEN 'Could not tell which attribute is being asked about. Please name a known attribute (e.g. weight, IP rating, battery life).'
  WHEN NOT known THEN 'Could not resolve the product. Provide product_id, GTIN, MPN, or brand + model.'
  ELSE 'No data for ''' || ['net_weight', 'material', 'battery_life'][a + 1] || ''' on this product.' END AS answer FROM r""")
def answer_route(spark, sf_dir):
    return answer.answer(_questions(spark, sf_dir), _labels(spark), _facts(spark, sf_dir)).select("question_id", "found", "route", "answer")


@registered(ROUTE + "SELECT route, count(*) AS n FROM r GROUP BY route")
def route_distribution(spark, sf_dir):
    return answer.route_counts(answer.answer(_questions(spark, sf_dir), _labels(spark), _facts(spark, sf_dir)))


@registered(
    CHUNK
    + """,
w AS (SELECT 'chk_' || substr(sha256(product_id || chr(1) || 'fact'), 1, 26) AS chunk_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL),
sizes AS (SELECT chunk_id, count(*) AS size FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
q AS (SELECT p_type, unnest(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+'))) AS term FROM (SELECT DISTINCT p_type FROM part)),
s AS (SELECT p_type AS question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (chunk_id), n GROUP BY ALL)
SELECT question_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s
QUALIFY rank <= 5
"""
)
def keyword_search(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("question_id"), F.col("p_type").alias("text"))
    return retrieval.bm25(_chunks(spark, sf_dir), asked).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vector(name, key, text, rows):
    """SQL of the hashed vectors of a table's text."""
    return f"""{name}n AS (SELECT {key} AS k, CAST(('0x' || substr(sha1(t), 1, 8)) AS BIGINT) % 1024 AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {rows}) GROUP BY ALL),
{name} AS (SELECT k, bucket, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY k) AS DOUBLE)) AS w FROM {name}n)"""


@registered(
    CHUNK
    + f""",
ch AS (SELECT 'chk_' || substr(sha256(product_id || chr(1) || 'fact'), 1, 26) AS chunk_id, brand, body FROM c),
q AS (SELECT p_partkey AS question_id, 'Which ' || p_type || ' has a net weight of ' || p_size || '00 g?' AS text, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part),
{_vector("cv", "chunk_id", "body", "ch")},
{_vector("qv", "question_id", "text", "q")},
dots AS (SELECT qv.k AS question_id, cv.k AS chunk_id, sum(qv.w * cv.w) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
r AS (SELECT q.question_id, ch.chunk_id, round(1 - coalesce(dot, 0), 9) AS distance FROM q JOIN ch ON q.brand IS NULL OR q.brand = ch.brand LEFT JOIN dots ON dots.question_id = q.question_id AND dots.chunk_id = ch.chunk_id)
SELECT question_id, chunk_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS INT) AS rank FROM r QUALIFY rank <= 5"""
)
def chunk_search(spark, sf_dir):
    """The five nearest chunks of a question about each part, half of them within a brand."""
    n = F.col("p_partkey")
    text_ = F.format_string("Which %s has a net weight of %d00 g?", "p_type", "p_size")
    asked = table(spark, sf_dir, "part").select(n.alias("question_id"), text_.alias("text"), F.when(n % 2 == 0, F.col("p_brand")).alias("brand"))
    return search.search(_chunks(spark, sf_dir), asked).select("question_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


ASKED = "['What is the net weight of it?', 'Which MATERIAL, please', 'battery life?', 'is it good']"


@registered(
    CHUNK
    + f""",
ch AS (SELECT p_partkey, 'chk_' || substr(sha256(product_id || chr(1) || 'fact'), 1, 26) AS chunk_id, brand, body FROM c),
dq AS (SELECT a * 10 + b AS k, a, 'Brand#' || b AS brand, {ASKED}[a + 1] AS text FROM range(4) AS x(a), range(11, 16) AS y(b)),
{_vector("cv", "chunk_id", "body", "ch")},
{_vector("qv", "k", "text", "dq")},
dots AS (SELECT qv.k, cv.k AS chunk_id, sum(qv.w * cv.w) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
near AS (SELECT a, dq.brand, arg_min(body, (round(1 - coalesce(dot, 0), 9), ch.chunk_id)) AS body FROM dq JOIN ch ON ch.brand = dq.brand LEFT JOIN dots ON dots.k = dq.k AND dots.chunk_id = ch.chunk_id GROUP BY a, dq.brand),"""
    + ROUTE.replace("WITH q AS", " q AS")
    + """, x AS (SELECT r.*, 'Brand#' || (question_id % 5 + 11) AS brand FROM r)
SELECT question_id, TRUE AS found, CASE WHEN route = 'exact_lookup' THEN route ELSE 'hybrid' END AS route, CASE
  WHEN route = 'exact_lookup' THEN CASE WHEN x.a = 0 THEN 'net weight: ' || printf('%.1f', p_size * 100.0::DOUBLE) || ' g (as reported: ' || p_size * 100 || ' g)' ELSE 'material: ' || p_type END || CASE WHEN disputed THEN ' (sources disagree; see citation).' ELSE '.' END || cite
  ELSE 'Based on the product''s stored data:' || chr(10) || body END AS answer FROM x LEFT JOIN near ON near.a = x.a AND near.brand = x.brand"""
)
def answer_hybrid(spark, sf_dir):
    asked = _questions(spark, sf_dir).withColumn("brand", F.concat(F.lit("Brand#"), (F.col("question_id") % 5 + 11).cast("string")))
    return answer.answer(asked, _labels(spark), _facts(spark, sf_dir), _chunks(spark, sf_dir)).select("question_id", "found", "route", "answer")


@registered(LADDER.split("r AS (")[0] + """
by_g AS (SELECT gtin, min(product_id) AS i FROM p WHERE gtin IS NOT NULL GROUP BY 1), by_m AS (SELECT mpn, brand, min(product_id) AS i FROM p WHERE mpn IS NOT NULL GROUP BY 1, 2), by_b AS (SELECT brand, model, min(product_id) AS i FROM p GROUP BY 1, 2),
q AS (SELECT p_partkey AS question_id, p_partkey % 4 AS a, p_partkey // 4 % 5 AS way, p_brand, p_name FROM part),
n AS (SELECT q.*, CASE way WHEN 0 THEN 'prd_' || lpad(CAST(question_id AS VARCHAR), 12, '0') WHEN 1 THEN by_g.i WHEN 2 THEN by_m.i WHEN 3 THEN by_b.i END AS product_id
      FROM q LEFT JOIN by_g ON by_g.gtin = 'G' || (question_id % 500) LEFT JOIN by_m ON by_m.mpn = 'M' || (question_id % 300) AND by_m.brand = p_brand LEFT JOIN by_b ON by_b.brand = p_brand AND by_b.model = lower(p_name)),
o AS (SELECT n.*, CAST(substr(product_id, 5) AS BIGINT) AS k FROM n)
SELECT question_id, product_id, CASE WHEN k IS NOT NULL AND (a = 0 OR a = 1 AND k % 7 <> 0) THEN 'exact_lookup' WHEN a = 3 THEN 'ambiguous' ELSE 'refused' END AS route FROM o""")
def answer_by_keys(spark, sf_dir):
    """Questions that name their product by its id, gtin, mpn and brand, brand and model, or not at all."""
    n, way = F.col("question_id"), F.floor(F.col("question_id") / 4) % 5
    asked = _questions(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), "p_brand", "p_name"), "question_id")
    asked = asked.select(
        "question_id", "text", F.when(
            way == 0, F.concat(F.lit("prd_"), F.lpad(n.cast("string"), 12, "0")),
        ).alias("product_id"), F.when(way == 1, F.concat(F.lit("G"), (n % 500).cast("string"))).alias("gtin"),
        F.when(way == 2, F.concat(F.lit("M"), (n % 300).cast("string"))).alias("mpn"), F.when(way.isin(2, 3), F.col("p_brand")).alias("brand"), F.when(way == 3, F.upper("p_name")).alias("model"),
    )
    return answer.answer(asked, _labels(spark), _facts(spark, sf_dir), products=part_products(table(spark, sf_dir, "part"))).select("question_id", "product_id", "route")


SCORED = """
WITH o AS (SELECT event_id, 'v' || (user_id % 3) AS vendor, event_type AS category, user_id AS case_id, CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN event_id % 10 < 3 THEN 'wrong' ELSE 'correct' END AS status, CASE WHEN event_id % 10 > 0 THEN event_id % 3 + 1 END AS tier FROM events)
"""


def _outcomes(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("vendor"), F.col("event_type").alias("category"),
        F.when(n % 10 == 0, "missing").when(n % 10 < 3, "wrong").otherwise("correct").alias("status"), F.when(n % 10 > 0, n % 3 + 1).alias("tier"),
    )


@registered(SCORED + """
SELECT vendor, category, CAST(grouping(vendor) * 2 + grouping(category) AS INT) AS level, count(DISTINCT case_id) AS n_cases, count(*) AS n_expected, count(*) FILTER (WHERE status = 'correct') AS n_correct, count(*) FILTER (WHERE status = 'wrong') AS n_wrong,
  count(*) FILTER (WHERE status = 'missing') AS n_missing, round(count(*) FILTER (WHERE status = 'correct') / CAST(count(*) FILTER (WHERE status <> 'missing') AS DOUBLE), 4) AS accuracy, round(count(*) FILTER (WHERE status <> 'missing') / CAST(count(*) AS DOUBLE), 4) AS coverage
FROM o GROUP BY GROUPING SETS ((), (vendor), (category), (vendor, category))""")
def scorecard(spark, sf_dir):
    return quality.scorecard(_outcomes(spark, sf_dir))


@registered("SELECT round(count(*) FILTER (WHERE event_id % 10 = 0 AND event_id % 5 = 0 OR event_id % 10 > 3 AND event_id % 5 > 3) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM events WHERE TRUE")
def accuracy(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(n % 10 == 0, "a").when(n % 10 > 3, "b").otherwise("c").alias("got"), F.when(n % 5 == 0, "a").when(n % 5 > 3, "b").otherwise("d").alias("want"),
    )
    return quality.answer_accuracy(rows, "got", "want").select(F.round("accuracy", 6).alias("accuracy"))


@registered(SCORED + "SELECT CAST(tier AS VARCHAR) AS label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM o WHERE tier IS NOT NULL) AS DOUBLE), 6) AS share FROM o WHERE tier IS NOT NULL GROUP BY 1")
def tier_mix(spark, sf_dir):
    return quality.distribution(_outcomes(spark, sf_dir).where("tier IS NOT NULL"), "tier").select("label", "n", F.round("share", 6).alias("share"))


@registered("""
WITH d AS (SELECT event_type AS domain, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT domain, CAST(day AS VARCHAR) AS day, n FROM (SELECT *, lag(n) OVER (PARTITION BY domain ORDER BY day) AS before FROM d) WHERE n < 0.95 * before""")
def coverage_drop(spark, sf_dir):
    return quality.coverage_drops(table(spark, sf_dir, "events"), "event_type", "ts", 0.95).select("domain", F.col("day").cast("string").alias("day"), "n")


@registered(r"""
SELECT page_id, url, NOT starts_with(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/private') AS allowed, CAST(2 AS DOUBLE) AS crawl_delay FROM pages""")
def robots_allowed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /private\nCrawl-delay: 2\n"))
    return urls.robots_allowed(pages, hosts, "factloom")


@registered(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, page_id % 5 * 1000000 AS t FROM pages),
n AS (SELECT page_id, host, t, (1 + length(host) % 3) * 1000000 AS step, row_number() OVER (PARTITION BY host ORDER BY t, page_id) AS i FROM p
      WHERE NOT starts_with(path, '/' || ['fr', 'en', 'es', 'de'][length(host) % 4 + 1]))
SELECT page_id, host, max(t - i * step) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) + i * step AS granted_us FROM n""")
def crawl_schedule(spark, sf_dir):
    """Pages that their host's rules allow, by the host's own delay: each host forbids one language."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.col("page_id") % 5).alias("at"))
    size = F.length("host")
    barred = F.element_at(F.array(*map(F.lit, ("fr", "en", "es", "de"))), (size % 4 + 1).cast("int"))
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct()
    robots = hosts.withColumn("body", F.format_string("User-agent: *\nDisallow: /%s\nCrawl-delay: %d\n", barred, 1 + size % 3))
    return crawl.schedule(pages, robots, "factloom", order="page_id").select("page_id", "host", F.unix_micros("granted_at").alias("granted_us"))


@registered("""
WITH q AS (SELECT event_id AS question_id, user_id, event_type, ts + to_days(CAST(event_id % 7 - 3 AS INTEGER)) AS at FROM events)
SELECT question_id, coalesce(arg_max(e.event_id, (e.ts, e.event_id)), -1) AS event_id FROM q LEFT JOIN events e ON e.user_id = q.user_id AND e.event_type = q.event_type AND e.ts <= q.at GROUP BY question_id""")
def facts_as_of_join(spark, sf_dir):
    """For each event, which of its user and type was the last some days earlier or later."""
    events = table(spark, sf_dir, "events")
    asked = events.select(F.col("event_id").alias("question_id"), "user_id", "event_type", (F.col("ts") + F.make_dt_interval((F.col("event_id") % 7 - 3).cast("int"))).alias("at"))
    found = facts.as_of_join(asked, events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], since="ts", order="event_id")
    return found.select("question_id", F.coalesce("version.event_id", F.lit(-1)).alias("event_id"))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS page, 5 AS candidates, 4 AS facts_written, 1 AS facts_unmapped, 1 AS failed FROM part")
def ingest_counts(spark, sf_dir):
    rows = quality.ingest_counts(_normal(spark, extract.extract(spec_pages(table(spark, sf_dir, "part")))))
    return rows.select(F.col("raw_artifact_id").alias("page"), *(F.col(c).cast("int") for c in ("candidates", "facts_written", "facts_unmapped", "failed")))


@registered("SELECT 31 AS n_attributes, 18 AS n_quantities")
def ontology_scan(spark, sf_dir):
    return ontology.attributes(spark).agg(F.count("*").cast("int").alias("n_attributes"), F.count_if(F.col("data_type") == "quantity").cast("int").alias("n_quantities"))


WEIGHTS = """
WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS page, p_partkey % 4 AS kind, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'heavy' WHEN 2 THEN p_size || '000' ELSE 'x' END AS value, p_size FROM part)
"""


def _weights(spark, sf_dir):
    """Pages of one row: a weight that can be read, one that can't, one too large, or a label that nobody knows."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    value = F.when(kind == 0, F.concat(size, F.lit(" kg"))).when(kind == 1, "heavy").when(kind == 2, F.concat(size, F.lit("000 kg"))).otherwise("x")
    label = F.when(kind < 3, "Weight").otherwise("Unheard of")
    pages = spec_pages(
        table(spark, sf_dir, "part").select("*", label.alias("_label"), value.alias("_value")),
        F.concat(F.lit("<table><tr><th>"), "_label", F.lit("</th><td>"), "_value", F.lit("</td></tr></table>")),
    )
    return _normal(spark, extract.spec_tables(pages))


@registered(WEIGHTS + """
SELECT page, ['ok', 'unparseable', 'out_of_constraints', 'unmapped'][kind + 1] AS reason, CASE WHEN kind < 3 THEN 'net_weight' END AS attribute_key, CASE WHEN kind = 0 THEN p_size * 1000.0::DOUBLE END AS value_num, CASE WHEN kind = 0 THEN 'g' END AS unit FROM w""")
def normalize_reasons(spark, sf_dir):
    rows = _weights(spark, sf_dir)
    return rows.select(F.col("raw_artifact_id").alias("page"), "reason", "attribute_key", "value_num", F.col("canonical_unit").alias("unit"))


@registered(WEIGHTS + """
SELECT CASE WHEN kind = 3 THEN 'attribute_mapping' ELSE 'value_anomaly' END AS queue, CASE WHEN kind = 3 THEN 'Unheard of' ELSE 'Weight:' || value END AS dedup, count(*) AS n FROM w WHERE kind > 0 GROUP BY ALL""")
def failures_to_queues(spark, sf_dir):
    """Where the failures of real normalisation go, and how many of each share an item."""
    items = normalize.review_items(_weights(spark, sf_dir), F.timestamp_seconds(F.lit(0)))
    return items.groupBy("queue", "dedup").agg(F.count("*").alias("n"))


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS page, 'unmapped' AS before, CASE WHEN p_size % 7 < 4 THEN 'ok' ELSE 'unmapped' END AS after_review, CASE WHEN p_size % 7 < 4 THEN 'material' END AS attribute_key FROM part""")
def review_learning(spark, sf_dir):
    """Unknown labels are queued, some are resolved and some dismissed, and the same pages are normalised again."""
    part = table(spark, sf_dir, "part").withColumn("_label", F.concat(F.lit("Label "), (F.col("p_size") % 7).cast("string")))
    found = extract.spec_tables(spec_pages(part, F.concat(F.lit("<table><tr><th>"), "_label", F.lit("</th><td>"), "p_type", F.lit("</td></tr></table>"))))
    first = _normal(spark, found)
    items = review.enqueue(None, normalize.review_items(first, F.timestamp_seconds(F.lit(0))), ["raw_artifact_id", "tier_pos", "place"])
    known = F.get_json_object("payload", "$.raw_attribute") < "Label 4"
    decided = items.select(
        "item_id", F.when(known, "resolved").otherwise("dismissed").alias("status"), F.lit("someone").alias("resolved_by"),
        F.lit('{"attribute_key": "material"}').alias("resolution"), F.timestamp_seconds(F.lit(1)).alias("resolved_at"),
    )
    learned = review.learned(review.resolve(items, decided))
    onto = ontology.ontology(spark)
    again = normalize.normalized(found, onto, ontology.with_learned(ontology.labels(onto), learned))
    before = first.select(F.col("raw_artifact_id").alias("page"), F.col("reason").alias("before"))
    return again.select(
        F.col("raw_artifact_id").alias("page"), F.col("reason").alias("after_review"), "attribute_key",
    ).join(before, "page").select("page", "before", "after_review", "attribute_key")


@registered("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'attribute_mapping' ELSE 'value_anomaly' END AS queue,
                  CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type || ':' || CAST(floor(value) AS BIGINT) END AS dedup FROM events WHERE event_id % 4 < 3),
i AS (SELECT queue, dedup, min(event_id) AS place FROM e GROUP BY queue, dedup)
SELECT queue, dedup, place FROM i WHERE place % 3 > 0""")
def hitl_enqueue_stored(spark, sf_dir):
    """The same failures again, when of the stored items a third is still open: only what isn't open is queued."""
    items = _items(spark, sf_dir).drop("item_id")
    stored = items.withColumn("status", F.when(F.col("place") % 3 == 0, "open").otherwise("resolved"))
    return review.enqueue(stored, items.drop("status"), ["place"]).select("queue", "dedup", "place")


BENCHMARK = """
WITH o AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id, p_brand AS vendor, 'c' || (p_size % 3) AS category, k AS attribute_key,
  CASE WHEN k = 'battery_life' THEN 'missing' WHEN k = 'net_weight' AND p_partkey % 5 = 0 OR k = 'material' AND p_partkey % 9 = 0 THEN 'wrong' ELSE 'correct' END AS status, CASE WHEN k <> 'battery_life' THEN 3 END AS tier
  FROM part, (VALUES ('net_weight'), ('material'), ('battery_life')) AS v(k))
"""


def _benchmark(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n, text_ = F.col("p_partkey"), F.lit(None).cast("string")
    weight = (F.col("p_size") * 1000 + F.when(n % 5 == 0, 1).otherwise(0)).cast("double")
    wants = F.array(
        F.struct(F.lit("net_weight").alias("attribute_key"), weight.alias("want_num"), text_.alias("want_text")),
        F.struct(
            F.lit("material").alias("attribute_key"), F.lit(None).cast("double").alias("want_num"),
            F.when(n % 9 == 0, "another").otherwise(F.col("p_name")).alias("want_text"),
        ),
        F.struct(F.lit("battery_life").alias("attribute_key"), F.lit(1.0).alias("want_num"), text_.alias("want_text")),
    )
    expected = part.select(
        n.cast("string").alias("case_id"), F.col("p_brand").alias("vendor"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("category"),
        F.explode(wants).alias("w"),
    ).select("case_id", "vendor", "category", "w.*")
    return benchmark.evaluate(spec_pages(part), expected)


@registered(BENCHMARK + "SELECT case_id, attribute_key, status, coalesce(tier, 0) AS tier FROM o")
def benchmark_outcomes(spark, sf_dir):
    return _benchmark(spark, sf_dir).outcomes.select("case_id", "attribute_key", "status", F.coalesce(F.col("tier").cast("int"), F.lit(0)).alias("tier"))


@registered(BENCHMARK + """
SELECT vendor, category, count(DISTINCT case_id) AS n_cases, count(*) AS n_expected, count(*) FILTER (WHERE status = 'correct') AS n_correct, round(count(*) FILTER (WHERE status = 'correct') / CAST(count(*) FILTER (WHERE status <> 'missing') AS DOUBLE), 4) AS accuracy,
  round(count(*) FILTER (WHERE status <> 'missing') / CAST(count(*) AS DOUBLE), 4) AS coverage FROM o GROUP BY GROUPING SETS ((), (vendor), (category), (vendor, category))""")
def benchmark_card(spark, sf_dir):
    return _benchmark(spark, sf_dir).card.select("vendor", "category", "n_cases", "n_expected", "n_correct", "accuracy", "coverage")


@registered(BENCHMARK + "SELECT tier, count(*) AS n FROM o WHERE tier IS NOT NULL GROUP BY tier")
def benchmark_tiers(spark, sf_dir):
    return _benchmark(spark, sf_dir).tiers.select(F.col("tier").cast("int").alias("tier"), "n")


@registered(CHUNK + "SELECT product_id, CASE WHEN p_partkey % 3 = 0 THEN body ELSE 'old' END AS body FROM c UNION ALL SELECT product_id, 'second' FROM c WHERE p_partkey % 3 = 0")
def chunk_replace(spark, sf_dir):
    """A third of the products gets two new chunks in place of its old one."""
    new = _chunks(spark, sf_dir)
    some = new.where(F.substring("product_id", 5, 12).cast("long") % 3 == 0)
    return retrieval.replace_chunks(new.withColumn("body", F.lit("old")), some.unionByName(some.withColumn("body", F.lit("second")))).select("product_id", "body")


@registered(f"SELECT product_id, brand, model, array_to_string(category_path, '/') AS category FROM (SELECT {PID} AS product_id, p_brand AS brand, p_name AS model, string_split(p_type, ' ') AS category_path FROM part WHERE p_partkey = 21)")
def product_by_id(spark, sf_dir):
    return resolve.product(part_products(table(spark, sf_dir, "part")), "prd_000000000021").select(
        "product_id", "brand", "model", F.array_join("category_path", "/").alias("category"),
    )


def _brand_model(page, keys):
    """A model that reads the colour, and makes up a material that isn't on the page."""
    brand = page.partition("<dt>Colour</dt><dd>")[2].partition("</dd>")[0]
    sure = 0.99 if brand.endswith(("1", "3", "5")) else 0.5
    return [
        {"attribute": "color", "value": brand, "source_span": f"Colour</dt><dd>{brand}", "confidence": sure},
        {"attribute": "material", "value": "gold", "source_span": "made of gold"}, {"attribute": "color", "value": "red", "source_span": "Colour"},
    ]


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS page, 'color' AS attribute, p_brand AS value, CASE WHEN substr(p_brand, -1) IN ('1', '3', '5') THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, 4 AS tier FROM part""")
def model_facts(spark, sf_dir):
    """Facts by an injected model: what isn't on the page, or not in its span, is left out, and confidence is capped."""
    rows = extract.by_model(spec_pages(table(spark, sf_dir, "part")), _brand_model, ["color", "material"])
    return rows.select(
        F.col("raw_artifact_id").alias("page"), F.col("raw_attribute").alias("attribute"), F.col("raw_value").alias("value"), "confidence",
        F.col("provenance.extraction_tier").cast("int").alias("tier"),
    )


@registered("SELECT round(count(*) FILTER (WHERE p_partkey % 4 < 3) / CAST(count(*) AS DOUBLE), 6) AS auto_map_rate FROM part")
def auto_map_rate(spark, sf_dir):
    return quality.auto_map_rate(_weights(spark, sf_dir)).select(F.round("auto_map_rate", 6).alias("auto_map_rate"))


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS page, CASE WHEN p_partkey % 2 = 0 THEN 'OWN' ELSE CAST(p_partkey AS VARCHAR) END AS gtin, CASE WHEN p_partkey % 3 = 0 THEN 'M1' END AS mpn FROM part""")
def enriched_refs(spark, sf_dir):
    """References filled from the ids that shop pages name; a value of their own comes first."""
    part = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    refs = part.select(n.cast("string").alias("raw_artifact_id"), F.when(n % 2 == 0, "OWN").when(n % 5 == 0, "").alias("gtin"), F.when(n % 3 == 0, "M1").alias("mpn"))
    return normalize.enriched(refs, extract.shop_json(shop_pages(part))).select(F.col("raw_artifact_id").alias("page"), "gtin", "mpn")


@registered(f"""
SELECT {PID} AS product_id, 'net_weight' AS attribute_key, p_size * 100.0::DOUBLE AS value_num, 'g' AS canonical_unit, p_size * 100 || ' g' AS original_value, p_partkey % 5 = 0 AS disputed, 0.9::DOUBLE AS confidence, 'json_ld' AS source_type,
  'https://shop.example/p/' || p_partkey AS source_url FROM part""")
def fact_rows(spark, sf_dir):
    """What the interface shows of facts, from their nested provenance."""
    rows = _facts(spark, sf_dir).where("attribute_key = 'net_weight'")
    nested = rows.withColumn("provenance", F.struct(F.lit("json_ld").alias("source_type"), "source_url", "source_span", "fetched_at"))
    return facts.fact_rows(nested).select("product_id", "attribute_key", "value_num", "canonical_unit", "original_value", "disputed", "confidence", "source_type", "source_url")


@registered("""
SELECT event_type AS raw_attribute, 'a' || max(user_id % 17) AS attribute_key FROM (SELECT event_type, user_id, rank() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM events WHERE event_type = 'click') WHERE n = 1 GROUP BY 1""")
def mapping_lookup(spark, sf_dir):
    """One label's mapping among those that the latest confirmations give."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("raw_attribute"), F.lit("en").alias("language"), F.array(F.lit("x")).alias("category_path"),
        F.concat(F.lit("a"), (F.col("user_id") % 17).cast("string")).alias("attribute_key"), F.col("ts").alias("confirmed_at"),
    )
    return ontology.mapping(ontology.learn_mappings(rows), "click", "en", ["x"]).select("raw_attribute", "attribute_key")


@registered("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def artifacts_existing(spark, sf_dir):
    """Which documents' artifacts are stored already, when every third is."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("raw_artifact_id"), "doc_id")
    return store.existing(docs, docs.where("doc_id % 3 = 0")).select("doc_id")
