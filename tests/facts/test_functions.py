"""Column functions on single values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text, units, urls, vectors
from factloom.operators import crawl


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_numbers(spark):
    said = ["2.3", "2,3", "2300", "  14 ", "-5", "n/a", "", None, "1,299.00", "2560 x 1440", "10-20", ".5", "up to +7.5 h"]
    assert values(spark, said, text.parsed_number(F.col("x"))) == [2.3, 2.3, 2300.0, 14.0, -5.0, None, None, None, 1.299, 2560.0, 10.0, 0.5, 7.5]


def test_labels(spark):
    said = ["Net_Weight", " net-weight: ", "Вага (нетто)", "IP  rating!", "", None, " Tab\there "]
    assert values(spark, said, text.normalized_label(F.col("x"))) == ["net weight", "net weight", "вага нетто", "ip rating", "", None, "tab here"]


def test_quantities(spark):
    value, unit = text.split_quantity(F.col("x"), units.MEASURED)
    said = ["2.3 kg", "2,3kg", "14.5 lbs", "20 cores", "120", "Steel", "5 KG", "5 kg net"]
    assert values(spark, said, value) == ["2.3", "2,3", "14.5 lbs", "20 cores", "120", "Steel", "5", "5 kg net"]
    assert values(spark, said, unit) == ["kg", "kg", None, None, None, None, "KG", None]


@pytest.mark.parametrize(
    "value, unit, to, want",
    [(2.3, "kg", "g", 2300.0), (2.3, None, "g", 2.3), (2.3, "", "g", 2.3), (1.0, "Pounds.", "g", 453.59237), (27.0, '"', "in", 27.0), (1.0, "tb", "gb", 1024.0), (90.0, "min", "h", 1.5), (8.0, "cores", "threads", None), (5.0, "cm", "g", None), (5.0, "parsec", "g", None), (512.0, "kb", "mb", None), (16.0, "core", "cores", 16.0)],
)
def test_conversion(spark, value, unit, to, want):
    assert values(spark, [(value, unit, to)], units.converted(F.col("v"), F.col("u"), F.col("t")), "v double, u string, t string") == [want]


def test_float_text(spark):
    random.seed(1)
    numbers = [0.0, 1.0, 2300.0, 0.5, 0.0001, 0.00012, 1e7, 12345678.0, 12345678.5, 1e15, -2.5, -1e8, 0.001, 123.456, -0.0005] + [round(random.uniform(-1e6, 1e6), random.randint(0, 6)) for _ in range(200)]
    assert values(spark, numbers, text.float_text(F.col("x")), "x double") == [repr(x) for x in numbers]


def test_json_text(spark):
    assert values(spark, ['a "b" \\ é', None], text.json_pair(F.lit("k"), F.col("x")))[0] == '{"k": "a \\"b\\" \\\\ é"}'


def test_grounded(spark):
    rows = [("The  cup\nweighs 2 kg.", "cup weighs 2 kg", "2"), ("The cup", "the CUP", "cup"), ("The cup", "The cup", "CUP "), ("The cup", "", "cup"), ("The cup", "The cup", " "), ("The cup", "The cup", "pot"), (None, "a", "a")]
    assert values(spark, rows, text.grounded(F.col("c"), F.col("s"), F.col("v")), "c string, s string, v string") == [True, False, True, False, False, False, False]


def test_urls(spark):
    said = {
        "HTTPS://Shop.Example/p?utm_source=x&b=2&a=1#top": "https://shop.example/p?a=1&b=2", "http://a.b": "http://a.b/", "http://a.b?ref=1": "http://a.b/", "http://a.b/x?q=a+b&q=%C3%A9&e=": "http://a.b/x?e=&q=a+b&q=%C3%A9",
        "http://a.b/x?gclid=1&Fbclid=2&k": "http://a.b/x?k=", "http://a.b/x?s=*~": "http://a.b/x?s=%2A~", "http://A.b/Path/X": "http://a.b/Path/X",
    }
    assert values(spark, list(said), urls.canonical_url(F.col("x"))) == list(said.values())
    assert values(spark, ["https://u@Shop.example:80/x", "nonsense"], urls.host(F.col("x"))) == ["shop.example", ""]


def test_rate_limit(spark):
    random.seed(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice("ab"), start + dt.timedelta(seconds=random.randint(0, 60))) for i in range(60)]
    got = {r.n: r.granted_at for r in crawl.rate_limited(spark.createDataFrame(rows, "n int, d string, at timestamp"), "d", "at", "n", 2.5).collect()}
    last = {}
    for i, d, at in sorted(rows, key=lambda r: (r[2], r[0])):
        last[d] = max(at, last[d] + dt.timedelta(seconds=2.5)) if d in last else at
        assert got[i] == last[d]


def test_robots(spark):
    pages = spark.createDataFrame([("http://a.b/private/x",), ("http://a.b/ok",), ("http://none.b/private",)], "url string")
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /private\nCrawl-delay: 2")], "host string, body string")
    got = {r.url: (r.allowed, r.crawl_delay) for r in urls.robots_allowed(pages, robots, "bot").collect()}
    assert got == {"http://a.b/private/x": (False, 2.0), "http://a.b/ok": (True, 2.0), "http://none.b/private": (True, None)}


def test_vectors(spark):
    df = spark.createDataFrame([(1, "red red cup"), (2, "кружка"), (3, "Cup, RED")], "id int, t string")
    rows = vectors.embedded(df, "id", "t").collect()
    norms = {}
    for r in rows:
        norms[r.id] = norms.get(r.id, 0) + r.weight**2
    assert norms == {1: pytest.approx(1.0), 3: pytest.approx(1.0)}
    assert values(spark, [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], vectors.cosine_distance(F.col("a"), F.col("b")), "a array<double>, b array<double>") == [1.0, pytest.approx(0.0), None]
