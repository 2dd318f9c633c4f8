"""Search with upper bounds against all pairs: the same rows, for a small part of the products."""

import random
from collections import Counter, defaultdict

import pytest

from factloom.functions.vectors import embedded
from factloom.operators import search


def all_pairs(spark, chunks, asked, limit):
    """Distances of every question to every chunk of its brand, by a plain loop over the same vectors."""
    c, q = defaultdict(dict), defaultdict(dict)
    for r in embedded(spark.createDataFrame([(k, b) for k, _, b, _ in chunks], "k string, t string"), "k", "t").collect():
        c[r.k][r.bucket] = r.weight
    for r in embedded(spark.createDataFrame([(k, t or "") for k, t, _ in asked], "k int, t string"), "k", "t").collect():
        q[r.k][r.bucket] = r.weight
    out, n = set(), 0
    for k, _, brand in asked:
        some = [x for x, own, _, stale in chunks if not stale and (brand is None or own == brand)]
        n += len(some)
        ranked = sorted((round(1 - sum(w * c[x].get(b, 0) for b, w in q[k].items()), 9), x) for x in some)
        out |= {(k, x, d, i + 1) for i, (d, x) in enumerate(ranked[:limit])}
    return out, n


def corpus(seed, n=500):
    """Chunks of one template, with a few words of their own; equal ones, stale ones, ones without words or brand."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    chunks = []
    for i in range(n):
        own = " ".join(r.choices(words, k=r.randint(1, 12)))
        chunks.append((f"c{r.randint(0, 9)}{i:03}", r.choice(["A", "A", "A", "B", None]), f"product net weight material source {own}", r.random() < 0.05))
    chunks += [("d1", "A", "", False), ("d2", None, "ЖЖ", False), ("d3", "B", chunks[0][2], False), ("d4", "B", chunks[0][2], False)]
    asked = [(i, "what is the net weight of " + " ".join(r.choices(words, k=2)), r.choice([None, "A", "B"])) for i in range(40)]
    asked += [(100, "what is the net weight", None), (101, "what is the net weight", None), (102, "ЖЖ", "B"), (103, None, None), (104, "weight", "unknown"), (105, "material source product net", "A")]
    return chunks, asked


def asked_of(spark, chunks, asked):
    return (
        spark.createDataFrame(chunks, "chunk_id string, brand string, body string, stale boolean").repartition(3),
        spark.createDataFrame(asked, "question_id int, text string, brand string"),
    )


@pytest.mark.parametrize("head", [4, 64, 1000])
def test_same_rows_as_all_pairs(spark, head):
    chunks, asked = corpus(head)
    told = []
    got = search.search(*asked_of(spark, chunks, asked), limit=3, head=head, told=told)
    got = {(r.question_id, r.chunk_id, round(r.distance, 9), r.rank) for r in got.collect()}
    want, pairs = all_pairs(spark, chunks, asked, 3)
    assert got == want
    if head == 4:
        assert sum(told) < 0.5 * pairs
    assert not [k for k, n in Counter((q, c) for q, c, _, _ in got).items() if n > 1]


def test_a_template_word_doesnt_join_all(spark):
    """A question of words that all chunks have reads the heads of their lists, however many chunks there are."""
    r = random.Random(7)
    chunks = [(f"c{i:05}", "A", "net weight material " + "x y z " * r.randint(1, 300), False) for i in range(3000)]
    told = []
    got = search.search(*asked_of(spark, chunks, [(1, "net weight", None), (2, "net weight", "A"), (3, "material", "A")]), limit=5, head=32, told=told)
    assert got.count() == 15 and sum(told) < 0.1 * 3 * 3000


def test_chunks_that_look_alike_are_one_product(spark):
    """Chunks that differ only in words that nobody asks for are compared with a question once, and still take places one by one."""
    chunks = [(f"c{i * 7919 % 800:03}", "A" if i % 2 else None, f"net weight {i % 4} source u{i}", False) for i in range(800)]
    asked = [(1, "net weight 1", None), (2, "net weight 3", "A"), (3, "weight 2", "A")]
    told = []
    got = search.search(*asked_of(spark, chunks, asked), limit=5, told=told)
    want, _ = all_pairs(spark, chunks, asked, 5)
    assert {(r.question_id, r.chunk_id, round(r.distance, 9), r.rank) for r in got.collect()} == want
    assert 0 < sum(told) < 100


def test_nothing(spark):
    chunks, asked = asked_of(spark, [("c", "A", "x", False)], [(1, "x", None)])
    assert search.search(chunks.limit(0), asked).count() == 0 and search.search(chunks, asked.limit(0)).count() == 0
