"""Entity resolution: a ladder of keys (gtin, then mpn and brand, then brand and model), with and without creation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import entity_id
from factloom.sources.store import written


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def resolve(refs: DataFrame, products: DataFrame) -> DataFrame:
    """refs with product_id, the match on the highest rung, or null. Of several matches the smallest id counts.

    Each rung is an equality join with the products reduced to one row a key, so a popular key doesn't multiply rows.
    """
    p = products.select("product_id", _filled("gtin").alias("gtin"), _filled("mpn").alias("mpn"), "brand", F.lower("model").alias("model"))
    rungs = [
        (["gtin"], "_by_gtin"),
        (["mpn", "brand"], "_by_mpn"),
        (["brand", "model"], "_by_model"),
    ]
    rows = refs.withColumn("_gtin", _filled("gtin")).withColumn("_mpn", _filled("mpn")).withColumn("_brand", F.col("brand")).withColumn("_model", F.lower("model"))
    for keys, name in rungs:
        side = p.dropna(subset=keys).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("product_id").alias(name))
        rows = rows.join(side, [f"_{k}" for k in keys], "left")
    return rows.withColumn("product_id", F.coalesce("_by_gtin", "_by_mpn", "_by_model")).drop("_gtin", "_mpn", "_brand", "_model", "_by_gtin", "_by_mpn", "_by_model")


def _keys() -> Column:
    gtin, mpn = _filled("gtin"), _filled("mpn")
    return F.filter(
        F.array(
            F.concat_ws("\u0001", F.lit("g"), gtin), F.when(mpn.isNotNull() & F.col("brand").isNotNull(), F.concat_ws("\u0001", F.lit("m"), mpn, "brand")),
            F.when(F.col("brand").isNotNull() & F.col("model").isNotNull(), F.concat_ws("\u0001", F.lit("b"), "brand", F.lower("model"))),
        ),
        lambda k: k.isNotNull() & (k != "g"),
    )


def _components(refs: DataFrame) -> DataFrame:
    """(seq, component): references that share keys, directly or over others, by least labels on a bipartite graph of references and keys.

    Tables of labels are written in few bytes a row and look small enough to broadcast long after they aren't: joins are sorted ones.
    """
    edges = written(refs.select("seq", F.explode(_keys()).alias("key")), "keys")
    labels = written(refs.select("seq", F.col("seq").alias("component")), "labels")
    while True:
        by_key = edges.join(labels.hint("merge"), "seq").groupBy("key").agg(F.min("component").alias("least"))
        near = edges.join(by_key.hint("merge"), "key").groupBy("seq").agg(F.min("least").alias("least"))
        up = labels.select(F.col("seq").alias("least"), F.col("component").alias("up"))
        new = labels.join(near.hint("merge"), "seq", "left").withColumn("least", F.least("component", F.coalesce("least", "component"))).join(up.hint("merge"), "least", "left")
        new = written(new.select("seq", F.col("component").alias("old"), F.least("least", F.coalesce("up", "least")).alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("seq", "component")
        if not changed:
            return labels


def resolve_or_create(refs: DataFrame) -> DataFrame:
    """refs (seq, product_id or null, gtin, mpn, brand, model) with `resolved`, replayed in the order of seq.

    A reference that matches no product so far makes one. Products that exist already come first, as references with
    their product_id. References that share no key, even over others, can't meet, so components are replayed apart; a
    component is sorted and streamed, with tables of its keys as the only state. A component isn't one product: the
    ladder takes the first match.
    """
    rows = refs.join(_components(refs).hint("merge"), "seq").withColumn("_id", F.coalesce("product_id", entity_id("prd", F.col("seq"))))
    columns = refs.columns
    schema = refs.select("*", F.lit("").alias("resolved")).schema

    def replay(frames):
        at, tables = None, ()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.component != at:
                    at, tables = row.component, ({}, {}, {})
                gtin, mpn, brand, model = (x if isinstance(x, str) else None for x in (row.gtin, row.mpn, row.brand, row.model))
                keys = (gtin or None, (mpn, brand) if mpn and brand is not None else None, (brand, model.lower()) if brand is not None and model is not None else None)
                found = None if isinstance(row.product_id, str) else next((t[k] for t, k in zip(tables, keys) if k is not None and k in t), None)
                if found is None:
                    found = row[-1]
                    for t, k in zip(tables, keys):
                        if k is not None:
                            t.setdefault(k, found)
                out.append(found)
            yield frame[columns].assign(resolved=pd.Series(out, index=frame.index, dtype="object"))

    ordered = rows.select("component", *columns, "_id").repartition("component").sortWithinPartitions("component", "seq")
    return ordered.mapInPandas(replay, schema)


def products_of(resolved: DataFrame) -> DataFrame:
    """The products: attributes of the reference that made them (later ones fill nothing in), and the distinct source URLs of all."""
    head = F.min_by(F.struct("gtin", "mpn", "brand", "model"), "seq").alias("p")
    urls = F.array_compact(F.sort_array(F.collect_set("source_url"))).alias("source_urls")
    return resolved.groupBy(F.col("resolved").alias("product_id")).agg(head, urls).select("product_id", "p.*", "source_urls")


def product(products: DataFrame, product_id: str) -> DataFrame:
    """The product, or no row if it is unknown."""
    return products.where(F.col("product_id") == product_id)


def product_rows(products: DataFrame) -> DataFrame:
    """What the interface shows of a product: all but when it was made and changed."""
    return products.drop("created_at", "updated_at")


def with_sources(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """products with the source URLs of resolved references added to `source_urls`; nothing else is filled in."""
    found = resolved.where("source_url <> ''").groupBy(F.col("resolved").alias("product_id")).agg(F.collect_set("source_url").alias("_new"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("source_urls", none), F.coalesce("_new", none))
    return products.join(found, "product_id", "left").withColumn("source_urls", F.sort_array(both)).drop("_new")
