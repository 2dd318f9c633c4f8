"""Readers of markup and JSON-LD: what they find, odd pages, and time that grows with the page."""

import time

import pytest

from factloom.operators import extract, markup

PAGE = "raw_artifact_id string, url string, canonical_url string, content string, content_type string, fetched_at timestamp"


def pages(spark, *contents):
    return spark.createDataFrame([(str(i), "https://x.example/", None, x, "text/html", None) for i, x in enumerate(contents)], PAGE)


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("<tr><th>Weight</th><td> 2 <b>kg</b></td></tr>", [("Weight", "2 kg")]),
        ("<TR><TD>a</td><TD>b&amp;c</TD ></TR><tr><td>a</td><td>b</td><td>c</td></tr>", [("a", "b&c")]),
        ("<tr><td>a<td>b</td><td>c</td></tr>", [("b", "c")]),  # a cell without its end isn't one
        ("<tr><td>a</td><!-- <td>no</td> --><script>'<td>no</td>'</script><td>b</td></tr>", [("a", "b")]),
        ("<tr><td>a</td><td>b</td><tr><td>c</td><td>d</td></tr>", [("c", "d")]),  # the first row has no end
        ("<dl><dt>t</dt><dd>one</dd><dd>two</dd><dt></dt><dd>x</dd></dl>", [("t", "one")]),
        ("<tr><td>a</td><td></td></tr>", []),
        ("a < b <tr><td>x</td><td>y", []),
        ("", []),
    ],
)
def test_cells(page, found):
    assert markup.cells(page) == found


@pytest.mark.parametrize("unclosed", ["<script>", "<!--", "<td", "<td>", "<", "</td>", "<style><script", "<tr><td>a</td>", '<script type="application/ld+json">'])
def test_a_megabyte_of_it_takes_under_two_seconds(unclosed):
    page = unclosed * (1_000_000 // len(unclosed))
    began = time.process_time()
    markup.cells(page)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("unclosed", ['<script type="application/ld+json">', '<script type="application/ld+json"', "<script "])
def test_unclosed_json_ld(spark, unclosed):
    page = '<script type="application/ld+json">{"@type":"Product","color":"red"}</script>' + unclosed * (1_000_000 // len(unclosed))
    began = time.time()
    assert [r.raw_value for r in extract.jsonld(pages(spark, page)).collect()] == ["red"]
    assert time.time() - began < 20


def test_objects():
    found = markup.objects('[{"a":1,"@graph":[{"b":1},[{"c":1}]]},[{"d":1}]]')
    assert found == ['{"d": 1}', '{"a": 1, "@graph": [{"b": 1}, [{"c": 1}]]}', '{"c": 1}', '{"b": 1}']
    assert markup.objects("[" * 200_000 + "]" * 200_000) is None and markup.objects("{") is None and markup.objects(None) is None
    assert markup.objects("3") == [] and markup.objects('{"@graph":{"x":1}}') == ['{"@graph": {"x": 1}}']
    assert markup.objects('{"color":"\\ud800"}') == ['{"color": "�"}']


def test_products():
    """Other objects hold a place, and aren't written out; a product is written without its graph, whose objects stand on their own."""
    block = '[{"@type":"Thing","@graph":[{"@type":["Thing","Product"],"a":1,"@graph":[{"@type":"Product","b":NaN}]}]},{"@type":["x"]},7]'
    assert markup.products(block) == [None, None, '{"@type": ["Thing", "Product"], "a": 1}', '{"@type": "Product", "b": NaN}']
    assert markup.products("[]") == [] and markup.products("{") is None and markup.products(None) is None and markup.products("[" * 200_000 + "]" * 200_000) is None


def test_a_product_beside_a_number_that_json_lacks(spark):
    """NaN in a product's graph made the product itself unreadable."""
    page = '<script type="application/ld+json">{"@type":"Product","color":"red","@graph":[{"@type":"Product","color":"blue","weight":NaN}]}</script>'
    assert [(r.raw_value, r.place) for r in extract.jsonld(pages(spark, page)).collect()] == [("red", 0)]


def test_shop_pages_read_one_after_another(spark):
    """Values of a page don't stand in for those that the next lacks; a surrogate without its partner makes only its own member null."""
    good = '{"product":{"vendor":"V","variants":[{"sku":"a","price":"9.90"}],"options":[{"name":"M","values":["S"]}]}}'
    odd = ["[]", '{"product":[]}', None, '{"product":{"variants":7}}', '{"variants":[{"price":1.50}]}', '{"product":{"vendor":"\\ud800","variants":[{"sku":"\\uD800","price":3}]}}', '{"product":{"variants":[{"price":1}]}']
    rows = pages(spark, *(x for y in odd for x in (good, y)))
    found = sorted((int(r.raw_artifact_id), r.raw_attribute, r.raw_value, r.detected_ids) for r in extract.shop_json(rows).collect())
    assert [x for x in found if x[0] % 2] == [(9, "price", "1.5", {}), (11, "price", "3", {})]
    assert [x[1:] for x in found if not x[0] % 2] == [(a, v, {"brand": "V", "sku": "a"}) for _ in odd for a, v in (("M", "S"), ("price", "9.90"))]


def test_pages_that_ended_jobs(spark):
    block = '<script type="application/ld+json">%s</script>'
    good = '{"@type":"Product","color":"red"}'
    rows = pages(spark, block % ("[" * 200_000 + "]" * 200_000), block % '{"@type":"Product","color":"\\ud800"}', block % good, block % good + block % "{")
    assert sorted(r.raw_value for r in extract.jsonld(rows).collect()) == ["red", "red", "�"]
    assert {r.raw_artifact_id: (r.blocks, r.failed) for r in extract.jsonld_failures(rows).collect()} == {"0": (1, 1), "1": (1, 0), "2": (1, 0), "3": (2, 1)}


def test_a_reader_by_the_contract(spark):
    """Any function may read pages; what it can't read is counted, and ends nothing."""

    def lines(page):
        for line in page.split(";"):
            label, value = line.split("=")
            yield label, value

    df = spark.createDataFrame([(1, "a=1;b=\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")), (2, "a=1;oops"), (3, None), (4, "c=")], "id int, content string")
    found = markup.read(df, lines, "test_lines")
    assert sorted(tuple(r) for r in markup.pairs_of(found).collect()) == [(1, 0, "a", "1"), (1, 1, "b", "😀"), (4, 0, "c", "")]
    assert [tuple(r) for r in markup.failures(found).collect()] == [("ValueError", 2)]
