"""URLs as columns: canonical form, source URL, host; and robots rules."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Query keys that only track.
TRACKING = ["gclid", "fbclid", "yclid", "mc_eid", "_ga", "ref", "ref_"]
TRACKING_PREFIX = "utm_"


def _decoded(x: Column) -> Column:
    # a stray percent sign is text
    return F.coalesce(F.try_url_decode(x), F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking(key: Column) -> Column:
    return F.lower(key).isin(TRACKING) | F.lower(key).startswith(TRACKING_PREFIX)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, `/` for no path, the query without tracking keys sorted by key and value, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    origin = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substr(head, F.length(origin) + 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _decoded(F.regexp_replace(p, "(?s)^[^=]*=", ""))).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p.k)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")
    return F.concat(F.lower(origin), F.when(path == "", "/").otherwise(path), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def deduped(pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(canonical_url, key, n): the least key of the pages of each canonical URL, and how many there are."""
    return pages.groupBy(canonical_url(F.col(url)).alias("canonical_url")).agg(F.min(key).alias(key), F.count("*").alias("n"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def source_url(canonical: Column, url: Column) -> Column:
    return F.coalesce(F.when(canonical != "", canonical), url)


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages (url, ...) with `allowed` and `crawl_delay` by robots (host, body); a host without rules allows all.

    Each worker parses a host's rules once for a run of its rows.
    """
    schema = T.StructType([*pages.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("crawl_delay", T.DoubleType())])
    rules = robots.select("host", F.col("body").alias("_body"))
    joined = pages.withColumn("host", host(F.col("url"))).join(rules, "host", "left")

    def judge(frames):
        known: dict = {}
        for frame in frames:
            allowed, delays = [], []
            for name, body, url in zip(frame["host"], frame["_body"], frame["url"]):
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    parser = RobotFileParser()
                    parser.parse((body or "").splitlines())
                    known[name] = parser
                allowed.append(known[name].can_fetch(agent, url))
                delay = known[name].crawl_delay(agent)
                delays.append(None if delay is None else float(delay))
            yield frame.drop(columns=["host", "_body"]).assign(allowed=allowed, crawl_delay=pd.Series(delays, index=frame.index, dtype="float64"))[schema.names]

    return joined.mapInPandas(judge, schema)
