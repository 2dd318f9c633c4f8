"""Extraction of candidate facts from pages: JSON-LD, shop product JSON, specification tables, and a model's output.

JSON is read with native functions, each object parsed once; only the opening of nested lists in JSON-LD is Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from factloom.functions.text import grounded, json_pair, split_quantity, strip
from factloom.functions.units import MEASURED
from factloom.functions.urls import source_url
from factloom.operators import markup

# Confidence by tier, the longest value of a table, and the properties that are attributes.
CONFIDENCE = {"json_ld": 0.95, "cms_adapter": 0.9, "dom": 0.6, "llm_text": 0.85}
MOST_CHARS = 120
SCALARS = ["color", "material", "size", "pattern"]
QUANTITIES = ["weight", "height", "width", "depth"]
GTINS = ["gtin13", "gtin8", "gtin12", "gtin14", "gtin"]
VARIANT = ["sku", "barcode", "price", "grams", "weight", "weight_unit"]
MEMBERS = ["@type", "sku", "mpn", *GTINS, "brand", *SCALARS, *QUANTITIES, "offers", "additionalProperty"]

BLOCK = r"""(?is)<script\b[^<>]*?\btype\s*=\s*["']application/ld\+json["'][^<>]*>(.*?)</script"""
STRINGS = "array<string>"
NUMBER_KIND = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def _get(node: Column, path: str) -> Column:
    return F.get_json_object(node, path)


def _opens(node: Column, sign: str) -> Column:
    """Does JSON text open an object ({) or an array ([)?"""
    return F.startswith(F.ltrim(node), F.lit(sign))


class Node(NamedTuple):
    """A JSON value as text, and parsed: kinds are read from VARIANT, where strings, numbers and booleans differ.

    read: members by key whose texts and kinds are columns already, so that they aren't read again at each use; known: such a kind.
    """

    text: Column
    parsed: Column
    read: dict[str, Node] = {}
    known: Column | None = None

    def member(self, key: str) -> Node:
        return self.read[key] if key in self.read else Node(_get(self.text, f"$['{key}']"), _member(self.parsed, key))

    def kind(self) -> Column:
        return F.schema_of_variant(self.parsed) if self.known is None else self.known

    def string(self) -> Column:
        return F.when(self.kind() == "STRING", self.text)

    def scalar(self) -> Column:
        """A string or number as text; booleans and others null."""
        return F.when(self.kind().rlike(f"^STRING$|{NUMBER_KIND}"), self.text)

    def is_object(self) -> Column:
        return self.kind().startswith("OBJECT")


def _member(parsed: Column, key: str) -> Column:
    return F.try_variant_get(parsed, f"$['{key}']", "variant")


def _with_members(rows: DataFrame, node: str, keys: list[str], escapes: bool = False) -> tuple[DataFrame, Node]:
    """rows with the object of column `node` (never null) read: its members' texts in one parse, and the kinds of those that are there.

    escapes: the text may hold escaped surrogates. One without its partner makes all members null, so such texts are read member by member.
    """
    text, kind = ([f"{what}_{node}_{i}" for i in range(len(keys))] for what in ("text", "kind"))
    parsed = F.col(f"{node}_json")
    rows = rows.select("*", F.json_tuple(node, *keys).alias(*text)).withColumn(f"{node}_json", F.try_parse_json(node))
    if escapes:
        rows = rows.withColumns({t: F.when(F.col(node).rlike(r"(?i)\\ud[89a-f]"), _get(F.col(node), f"$['{k}']")).otherwise(F.col(t)) for k, t in zip(keys, text, strict=True)})
    rows = rows.select("*", *(F.when(F.col(t).isNotNull(), F.schema_of_variant(_member(parsed, k))).alias(a) for k, t, a in zip(keys, text, kind, strict=True)))
    members = {k: Node(F.col(t), _member(parsed, k), known=F.col(a)) for k, t, a in zip(keys, text, kind, strict=True)}
    return rows, Node(F.col(node), parsed, members)


def _with_parsed(values: Column) -> Column:
    """Texts as structs of text and parsed, so that lambdas parse each only once."""
    return F.transform(values, lambda x: F.struct(x.alias("text"), F.try_parse_json(x).alias("parsed")))


def _is_number(kind: Column) -> Column:
    return kind.rlike(NUMBER_KIND)


def _list(node: Column) -> Column:
    return F.coalesce(F.when(_opens(node, "["), F.from_json(node, STRINGS)), F.array().cast(STRINGS))


@F.pandas_udf(ArrayType(StringType()))
def _opened(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in blocks:
        yield series.map(markup.products)


def _provenance(tier: int, kind: str, method: str, span: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("source_type"), F.col("source_url"), F.lit(tier).alias("extraction_tier"), F.lit(method).alias("extraction_method"), span.alias("source_span"),
        F.col("raw_artifact_id"), F.col("fetched_at"),
    )


def _evidence(kind: str, selector: Column | None = None, path: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"), (selector if selector is not None else none).cast("string").alias("selector"), (path if path is not None else none).cast("string").alias("json_path"),
        none.cast("int").alias("page"), none.cast("array<double>").alias("bbox"),
    )


def _pages(artifacts: DataFrame) -> DataFrame:
    """The columns that readers need, dealt by page: a table in one small file would be one task, and reading costs far more than the shuffle."""
    parts = int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = artifacts.select("raw_artifact_id", source_url(F.col("canonical_url"), F.col("url")).alias("source_url"), "content", "fetched_at")
    return rows.repartition(parts, "raw_artifact_id")


def _fact(name: Column, value: Column, unit: Column, path: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), unit.cast("string").alias("unit"), path.alias("path"))


def _facts(rows: DataFrame, every: Column) -> DataFrame:
    """rows with fact_at and fact, for each of `every` with a name and a value.

    The outer explode is what keeps Spark from evaluating all facts once more in a filter on their number. Callers don't
    filter either, but leave `every` null: a filter would go below the shuffle of the pages and parse them there.
    """
    some = F.filter(every, lambda x: x["name"].isNotNull() & x["value"].isNotNull())
    return rows.select("*", F.posexplode_outer(some).alias("fact_at", "fact")).where("fact_at IS NOT NULL")


def _candidates(rows: DataFrame, tier: int, tier_pos: int, kind: str, method: str) -> DataFrame:
    """rows: page columns, ids, fact, place."""
    f = F.col("fact")
    return rows.select(
        "raw_artifact_id", f["name"].alias("raw_attribute"), f["value"].alias("raw_value"), f["unit"].alias("raw_unit"), F.lit(CONFIDENCE[kind]).alias("confidence"), F.col("ids").alias("detected_ids"),
        _provenance(tier, kind, method, json_pair(f["name"], f["value"])).alias("provenance"), _evidence("json", path=f["path"]).alias("evidence"), F.lit(tier_pos).alias("tier_pos"), "place",
    )


def _filled(x: Column) -> Column:
    return F.when(x.rlike(r"(?U)\S"), x)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where f uses x more than once and lambdas would evaluate it each time."""
    return F.get(F.transform(F.array(x), f), 0)


def _unit_of(node: Node) -> Column:
    text = node.member("unitText").string()
    return F.coalesce(F.when(text != "", text), node.member("unitCode").string())


def _measure(node: Node) -> tuple[Column, Column]:
    """A quantity: a scalar, or an object with value and unit."""
    value = F.when(node.is_object(), node.member("value").scalar()).otherwise(_filled(strip(node.scalar())))
    return value, F.when(node.is_object(), _unit_of(node))


def jsonld_blocks(artifacts: DataFrame) -> DataFrame:
    """The JSON-LD blocks of pages: page columns, block_at, block. What follows the last end of a script holds none, so each search finds its end."""
    closed = F.regexp_extract("content", "(?is)^.*</script", 0)
    return _pages(artifacts).select("*", F.posexplode(F.regexp_extract_all(closed, F.lit(BLOCK), F.lit(1))).alias("block_at", "block")).drop("content")


def jsonld_failures(artifacts: DataFrame) -> DataFrame:
    """(raw_artifact_id, blocks, failed): how many JSON-LD blocks a page has, and how many of them can't be read."""
    rows = jsonld_blocks(artifacts).select("raw_artifact_id", _opened("block").isNull().alias("failed"))
    return rows.groupBy("raw_artifact_id").agg(F.count("*").alias("blocks"), F.count_if("failed").alias("failed"))


def jsonld(artifacts: DataFrame, tier_pos: int = 0) -> DataFrame:
    """Facts of schema.org products in JSON-LD blocks. Blocks that can't be read give none; lists and @graph are opened as deep as JSON can be read."""
    blocks = jsonld_blocks(artifacts)
    nodes = blocks.select("*", F.posexplode(_opened("block")).alias("node_at", "node")).drop("block").where("node IS NOT NULL")
    nodes, n = _with_members(nodes, "node", MEMBERS)
    offers = n.member("offers")
    listed = _opens(offers.text, "[")
    nodes = nodes.withColumn("offer", F.when(listed, F.get(_list(offers.text), 0)).otherwise(offers.text))
    kind = n.member("@type")
    is_product = F.when(kind.kind().startswith("ARRAY"), F.array_contains(_list(kind.text), "Product")).otherwise(kind.text == "Product")
    gtin = F.coalesce(*(n.member(k).scalar() for k in GTINS))
    brand = F.coalesce(F.when(n.member("brand").is_object(), n.member("brand").member("name").string()), n.member("brand").string())
    ids = F.map_filter(
        F.create_map(F.lit("sku"), n.member("sku").scalar(), F.lit("mpn"), n.member("mpn").scalar(), F.lit("gtin"), gtin, F.lit("brand"), brand), lambda k,
        v: v.isNotNull(),
    )
    facts = [_fact(F.lit(k), _filled(n.member(k).string()), F.lit(None), F.lit(f"$.{k}")) for k in SCALARS]
    facts += [_fact(F.lit(k), *_measure(n.member(k)), F.lit(f"$.{k}")) for k in QUANTITIES]
    offer = Node(F.col("offer"), F.when(listed, F.try_variant_get(offers.parsed, "$[0]", "variant")).otherwise(offers.parsed))
    facts.append(_fact(F.lit("price"), offer.member("price").scalar(), offer.member("priceCurrency").string(), F.lit("$.offers.price")))

    def extra(x, i):
        x = Node(x["text"], x["parsed"])
        return _fact(_once(x.member("name").string(), _filled), x.member("value").scalar(), _unit_of(x), F.concat(F.lit("$.additionalProperty["), i.cast("string"), F.lit("]")))

    every = F.concat(F.array(*facts), F.transform(_with_parsed(_list(n.member("additionalProperty").text)), extra))
    rows = _facts(nodes.select("*", ids.alias("ids")), F.when(is_product, every))
    place = (F.col("block_at") * 1_000_000 + F.col("node_at")).cast("long") * 1_000_000 + F.col("fact_at")
    return _candidates(rows.withColumn("place", place), 1, tier_pos, "json_ld", "jsonld_v1")


def shop_json(artifacts: DataFrame, tier_pos: int = 1) -> DataFrame:
    """Facts of a shop's product JSON: the first variant's weight and price, and the options that have one value."""
    pages = _pages(artifacts).withColumn("page_json", F.when(_opens(F.col("content"), "{"), F.try_parse_json("content")))
    page = Node(F.col("content"), F.col("page_json"))
    is_product = F.try_variant_get("page_json", "$['product']", "struct<variants variant>").isNotNull()  # an object; its schema isn't made
    has_variants = F.col("content").contains('"variants"') & page.member("variants").parsed.isNotNull()
    rows = pages.withColumn("node", F.coalesce(F.when(is_product, page.member("product").text).when(has_variants, F.col("content")), F.lit("{}"))).drop("content", "page_json")
    rows, n = _with_members(rows, "node", ["vendor", "variants", "options"], escapes=True)
    rows = rows.withColumn("first", F.get(_list(n.member("variants").text), 0))
    rows, v = _with_members(rows.withColumn("variant", F.when(_opens(F.col("first"), "{"), F.col("first")).otherwise("{}")), "variant", VARIANT, escapes=True)
    ids = F.create_map(F.lit("brand"), _filled(n.member("vendor").string()), F.lit("sku"), _filled(v.member("sku").scalar()), F.lit("gtin"), _filled(v.member("barcode").scalar()))
    ids = F.map_filter(ids, lambda k, x: x.isNotNull())
    grams = F.when(_is_number(v.member("grams").kind()) & (v.member("grams").text.try_cast("double") > 0), v.member("grams").text)
    unit = v.member("weight_unit").string()
    other = F.when(_is_number(v.member("weight").kind()) & unit.isNotNull(), v.member("weight").text)
    weight = _fact(F.lit("weight"), F.coalesce(grams, other), F.when(grams.isNotNull(), "g").otherwise(unit), F.lit("$.product.variants[0].grams"))
    price = _fact(F.lit("price"), v.member("price").scalar(), F.lit(None), F.lit("$.product.variants[0].price"))

    def option(x, i):
        x = Node(x["text"], x["parsed"])
        values = _once(x.member("values").text, _list)
        is_text = F.schema_of_variant(F.try_variant_get(x.parsed, "$.values[0]", "variant")) == "STRING"
        one = _once(values, lambda y: F.when((F.size(y) == 1) & is_text, F.get(y, 0)))
        return _fact(x.member("name").string(), _once(one, _filled), F.lit(None), F.concat(F.lit("$.product.options["), i.cast("string"), F.lit("]")))

    every = F.concat(F.array(weight, price), F.transform(_with_parsed(_list(n.member("options").text)), option))
    rows = _facts(rows.select("*", ids.alias("ids")), every)
    return _candidates(rows.withColumn("place", F.col("fact_at").cast("long")), 2, tier_pos, "cms_adapter", "shop_json_v1")


def spec_read(artifacts: DataFrame) -> DataFrame:
    """(raw_artifact_id, source_url, fetched_at, place, label, value, error) of specification tables and lists, through the contract of readers."""
    may = F.lower("content").rlike("<(?:tr|dt|td|th|dd)\\b")
    return markup.read(_pages(artifacts).where(may), markup.cells, "factloom_spec_cells")


def spec_pairs(artifacts: DataFrame) -> DataFrame:
    return markup.pairs_of(spec_read(artifacts))


def spec_tables(artifacts: DataFrame, tier_pos: int = 2) -> DataFrame:
    """Facts of specification tables and definition lists."""
    pairs = spec_pairs(artifacts).where((F.length("label") > 0) & F.length("value").between(1, MOST_CHARS))
    value, unit = split_quantity(F.col("value"), MEASURED)
    return pairs.select(
        "raw_artifact_id", F.col("label").alias("raw_attribute"), value.alias("raw_value"), unit.alias("raw_unit"), F.lit(CONFIDENCE["dom"]).alias("confidence"), F.create_map().cast("map<string,string>").alias("detected_ids"),
        _provenance(
            3, "dom", "spec_tables_v1", F.concat("label", F.lit(": "), "value"),
        ).alias("provenance"), _evidence("html", selector=F.lit("table/dl")).alias("evidence"), F.lit(tier_pos).alias("tier_pos"), "place",
    )


#: (page text, attribute keys) -> rows of attribute, value, unit, source_span, confidence.
Model = Callable[[str, list[str]], Iterable[dict]]


def by_model(artifacts: DataFrame, model: Model, keys: list[str], tier_pos: int = 3, cap: float = CONFIDENCE["llm_text"]) -> DataFrame:
    """Facts that a model finds, if their spans are on the page and their values in the spans. The model runs in batches of pages."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                for i, x in enumerate(model(r.content or "", keys)):
                    rows.append((
                        r.raw_artifact_id, r.source_url, r.fetched_at, r.content, i, x["attribute"], x["value"], x.get("unit"), x.get("source_span") or "",
                        float(x.get("confidence", 0.7)),
                    ))
            yield pd.DataFrame(rows, columns=["raw_artifact_id", "source_url", "fetched_at", "content", "place", "attribute", "value", "unit", "source_span", "model_confidence"])

    schema = "raw_artifact_id string, source_url string, fetched_at timestamp, content string, place bigint, attribute string, value string, unit string, source_span string, model_confidence double"
    return ground(_pages(artifacts).mapInPandas(run, schema), tier_pos, cap)


def ground(extracted: DataFrame, tier_pos: int = 3, cap: float = CONFIDENCE["llm_text"]) -> DataFrame:
    """What a model extracted, with the page's content beside it: only grounded facts stay, and confidence is capped."""
    kept = extracted.where(grounded(F.col("content"), F.col("source_span"), F.col("value")))
    return kept.select(
        "raw_artifact_id", F.col("attribute").alias("raw_attribute"), F.col("value").alias("raw_value"), F.col("unit").alias("raw_unit"), F.least(F.col("model_confidence"), F.lit(cap)).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("detected_ids"), _provenance(4, "llm_text", "model_v1", strip(F.col("source_span"))).alias("provenance"), _evidence("html").alias("evidence"), F.lit(tier_pos).alias("tier_pos"), "place",
    )


def extract(artifacts: DataFrame) -> DataFrame:
    """All deterministic tiers by content type: JSON pages give shop facts, others JSON-LD and table facts."""
    is_json = F.coalesce(F.lower("content_type").contains("json"), F.lit(False))
    return shop_json(artifacts.where(is_json)).unionByName(jsonld(artifacts.where(~is_json))).unionByName(spec_tables(artifacts.where(~is_json)))
