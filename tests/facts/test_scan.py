"""Scans over long keys, the rate limit, as-of joins and nearest-neighbour joins against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import crawl, facts, retrieval, scan

START = dt.datetime(2024, 1, 1)


def hot_rows(n=3000, seed=1):
    """Nine in ten rows of one key; some without a key."""
    r = random.Random(seed)
    return [(i, r.choice(["hot"] * 18 + ["a", None]), r.randint(0, 500), r.choice([None, None, r.randint(0, 9)])) for i in range(n)]


def test_a_long_key_is_many_ranges(spark):
    rows = spark.createDataFrame(hot_rows(), "i int, k string, at int, v int")
    own = scan.dealt(rows, ["k"], ["at", "i"], 16)
    sizes = [r["count"] for r in own.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3 * 3000 / 16
    assert scan.totals(own, ["k"], n=F.count("*")).count() <= 2 * 16
    got = {r.i: r.n for r in scan.numbered(rows, ["k"], ["at", "i"], "n").collect()}
    want, seen = {}, {}
    for i, k, at, _ in sorted(hot_rows(), key=lambda x: (x[2], x[0])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_last_known(spark):
    rows = [*hot_rows(), (9001, "none", 1, None), (9002, "none", 2, None)]
    df = spark.createDataFrame(rows, "i int, k string, at int, v int")
    got = {r.i: r.last for r in scan.last_known(df, ["k"], ["at", "i"], "v", "last").collect()}
    want, seen = {}, {}
    for i, k, at, v in sorted(rows, key=lambda x: (x[2], x[0])):
        seen[k] = seen.get(k) if v is None else v
        want[i] = seen[k]
    assert got == want and got[9002] is None
    assert scan.last_known(df.limit(0), ["k"], ["at"], "v", "last").count() == 0


def test_rate_limit_of_a_domain_with_most_requests(spark):
    rows = [(i, k, START + dt.timedelta(seconds=at)) for i, k, at, _ in hot_rows()]
    df = spark.createDataFrame(rows, "i int, d string, at timestamp")
    seconds = F.when(F.col("d") == "hot", 0.25).otherwise(3.5)
    got = {r.i: r.granted_at for r in crawl.rate_limited(df, "d", "at", "i", seconds).collect()}
    last = {}
    for i, d, at in sorted(rows, key=lambda x: (x[2], x[0])):
        wait = dt.timedelta(seconds=0.25 if d == "hot" else 3.5)
        last[d] = max(at, last[d] + wait) if d in last else at
        assert got[i] == last[d]


def test_schedule_joins_robots_and_the_limit(spark):
    pages = [("https://a.example/x", 0), ("https://a.example/no/y", 0), ("https://a.example/z", 0), ("https://b.example/1", 0), ("https://b.example/2", 0)]
    pages = spark.createDataFrame([(u, START + dt.timedelta(seconds=s)) for u, s in pages], "url string, at timestamp")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /no\nCrawl-delay: 7")], "host string, body string")
    got = {r.url: (r.granted_at - START).total_seconds() for r in crawl.schedule(pages, robots, "bot", interval=2.0).collect()}
    assert got == {"https://a.example/x": 0, "https://a.example/z": 7, "https://b.example/1": 0, "https://b.example/2": 2}


@pytest.mark.parametrize("until", [None, "ended"])
def test_as_of_join(spark, until):
    r = random.Random(4)
    at = lambda: START + dt.timedelta(hours=r.randint(0, 300))
    key = lambda: (r.choice(["hot"] * 9 + ["p", None]), r.choice(["x", "y"]))
    versions = [(*key(), i, at(), None) for i in range(800)]
    versions = [(*v[:4], r.choice([None, v[3] + dt.timedelta(hours=20)])) for v in versions]
    asked = [(q, *key(), at() if q % 50 else None) for q in range(1000)]
    got = facts.as_of_join(
        spark.createDataFrame(asked, "q int, product_id string, attribute_key string, at timestamp"),
        spark.createDataFrame(versions, "product_id string, attribute_key string, seq int, valid_from timestamp, ended timestamp"),
        ["product_id", "attribute_key"], until=until,
    ).collect()
    want = {}
    for q, p, a, when in asked:
        begun = [v for v in versions if when and v[:2] == (p, a) and v[3] <= when]
        last = max(begun, key=lambda v: (v[3], v[2])) if begun else None
        want[q] = last[2] if last and not (until and last[4] and last[4] <= when) else None
    assert {x.q: x.version and x.version.seq for x in got} == want


@pytest.mark.parametrize("block", [1 << 25, 3000])
def test_nearest_join(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "ASKED_BYTES", block)
    monkeypatch.setattr(retrieval, "PRODUCT_BYTES", 8 * 1024 * 37)
    r = np.random.default_rng(2)
    vector = lambda: [float(x) for x in r.integers(-2, 3, 8)]
    rows = [(f"k{i:03}", vector()) for i in range(300)] + [("z1", None), ("a0", [0.0] * 8), ("b", [1.0]), ("c", [float("nan")] * 8), (None, vector())]
    asked = [(i, vector()) for i in range(90)] + [(900, None), (901, [0.0] * 8)]
    got = retrieval.nearest_join(spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4), spark.createDataFrame(asked, "question_id int, embedding array<double>"), limit=7).collect()

    def distance(a, b):
        a, b = (np.array(x if x else [0.0], float) for x in (a, b))
        ok = len(a) == len(b) == 8 and np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()
        return round(1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), 12) if ok else np.inf

    want = {}
    for q, e in asked:
        want |= {(q, k, n + 1): d for n, (d, k) in enumerate(sorted((distance(e, v), k) for k, v in rows if k)[:7])}
    got = {(x.question_id, x.chunk_id, x.rank): np.inf if x.distance is None else x.distance for x in got}
    assert set(got) == set(want) and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in got)


def test_nearest_join_of_nothing(spark):
    some = spark.createDataFrame([("k", [1.0])], "chunk_id string, embedding array<double>")
    none = spark.createDataFrame([], "question_id int, embedding array<double>")
    assert retrieval.nearest_join(some, none).count() == 0
    assert retrieval.nearest_join(some.limit(0), spark.createDataFrame([(1, [1.0])], "question_id int, embedding array<double>")).count() == 0
