"""Keyword search against a plain loop over all pairs; no table that grows with the chunks is broadcast."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.plans import samples

CHUNKS, ASKED = "chunk_id string, body string", "question_id int, text string"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def all_pairs(chunks, asked, limit, k1=1.2, b=0.75):
    """(question_id, chunk_id, score, rank) by BM25; rows of one chunk_id are one chunk, but count as rows. No chunk_id takes no place."""
    own = defaultdict(Counter)
    for k, body in chunks:
        own[k] += Counter(words(body))
    df = Counter(w for c in own.values() for w in c)
    sizes = {k: c.total() for k, c in own.items() if c}
    n, mean = len(chunks), sum(sizes.values()) / max(1, len(sizes)) or 1.0
    out = set()
    for q, text in asked:
        scores = []
        for k, size in sizes.items():
            some = [w for w in set(words(text)) if w in own[k]]
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own[k][w] * (k1 + 1) / (own[k][w] + k1 * (1 - b + b * size / mean)) for w in some]
            if some and k is not None:
                scores.append((-round(sum(parts), 9), k))
        out |= {(q, k, round(-s, 8), i + 1) for i, (s, k) in enumerate(sorted(scores)[:limit])}
    return out


def corpus(seed):
    """Chunks of one template with many that look alike; repeated ids and rows, ones without an id, a body or a word."""
    r = random.Random(seed)
    chunks = [(f"c{i * 7919 % 400:03}", f"net weight {' '.join(r.choices('abcde', k=r.randint(1, 3)))} source u{i}") for i in range(400)]
    chunks += [("c001", "a a a"), ("c001", "a a a"), ("d1", None), ("d2", ""), ("d3", "Ж!"), ("d4", "A-a_b"), (None, "a rare"), (None, "net")]
    asked = [(1, "a"), (2, "Net weight, a b"), (3, "unheard of"), (4, None), (5, "rare u7 e e"), (6, "Ж"), (7, "c d"), (8, "u1 u2 u3 source")]
    return chunks, asked


@pytest.mark.parametrize("broadcast_terms", [retrieval.TERMS, 0])
@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_same_rows_as_all_pairs(spark, limit, broadcast_terms):
    chunks, asked = corpus(limit)
    got = retrieval.bm25(spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(asked, ASKED), limit=limit, broadcast_terms=broadcast_terms)
    assert got.columns == ["question_id", "chunk_id", "score", "rank"]
    assert {(r.question_id, r.chunk_id, round(r.score, 8), r.rank) for r in got.collect()} == all_pairs(chunks, asked, limit)


def test_chunks_are_not_broadcast(spark):
    """Scores, sizes and words of chunks meet in sorted joins; what is broadcast while chunks are read is the asked words alone."""
    n = F.col("id")
    part = spark.range(1, 41, numPartitions=1).select(
        n.alias("p_partkey"), F.concat(F.lit("name "), n).alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("SMALL TIN").alias("p_type"), (n % 50).cast("int").alias("p_size"), (n / 7).alias("p_retailprice"),
    )
    chunks = retrieval.chunks(samples.part_products(part).select("product_id", "brand", "model", "category_path"), samples.part_facts(part))
    asked = part.select("p_type").distinct().select(F.col("p_type").alias("question_id"), F.col("p_type").alias("text"))
    rows = retrieval.bm25(chunks, asked)
    assert "BroadcastExchange" not in physical(rows)
    assert rows.count() == 5


@pytest.mark.parametrize("broadcast, joins", [(True, 1), (False, 0)])
def test_only_asked_words_are_broadcast(spark, broadcast, joins):
    terms = spark.createDataFrame([("a",)], "term string")
    rows = retrieval.seen_words(spark.createDataFrame([("c1", "a b a"), ("c2", "b"), ("c2", "a"), ("c3", None)], CHUNKS), F.broadcast(terms) if broadcast else terms.hint("merge"))
    assert physical(rows).count("BroadcastExchange") == joins
    assert {(r.chunk_id, r.rows, r.size, tuple(map(tuple, r.seen))) for r in rows.collect()} == {("c1", 1, 3, (("a", 2),)), ("c2", 2, 2, (("a", 1),)), ("c3", 1, 0, ())}


def test_chunks_that_look_alike_are_scored_once(spark, monkeypatch):
    """Of 900 chunks that a question can't tell apart but for three words one a kind is scored, and the first few of each are kept."""
    kept = {}
    written = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    chunks = [(f"c{i * 7919 % 900:03}", f"net weight k{i % 3} source u{i}") for i in range(900)]
    got = retrieval.bm25(spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame([(1, "k1 weight"), (2, "k2 k0")], ASKED), limit=5)
    assert {(r.question_id, r.chunk_id, round(r.score, 8), r.rank) for r in got.collect()} == all_pairs(chunks, [(1, "k1 weight"), (2, "k2 k0")], 5)
    assert [len(r.members) for r in kept["groups"].collect()] == [5, 5, 5] and kept["seen"].count() == 900


def test_nothing(spark):
    chunks, asked = spark.createDataFrame([("c", "x")], CHUNKS), spark.createDataFrame([(1, "x")], ASKED)
    assert retrieval.bm25(chunks.limit(0), asked).count() == 0 and retrieval.bm25(chunks, asked.limit(0)).count() == 0
    assert [tuple(r)[:2] for r in retrieval.bm25(chunks, asked).collect()] == [(1, "c")]
