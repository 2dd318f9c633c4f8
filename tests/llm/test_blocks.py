"""Blocks are bounded by text, whatever the number of ranges that the driver may hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import common as c
from factloom.llm.blocks import BLOCK, CUTS, ROW, blocks, edges, packed, planned, present, shards, unpacked
from factloom.llm.substring import Words, _confirm, covered, reported, word_ids


@pytest.mark.parametrize("ranges", [3, 16384])
def test_blocks_are_bounded_by_text(spark, ranges):
    long = {40: 9000, 41: 9000, 42: 9000, 43: 9000, 120: 30_000}
    rows = [(i, "x" * long.get(i, 100)) for i in range(300)] + [(None, "x" * 50), (7, "again"), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got, total = blocks(docs, chars=5000, ranges=ranges)
    assert total == sum(len(t or "") + ROW for _, t in rows)
    found = got.groupBy(BLOCK).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + ROW).alias("n"), F.max(F.length("text")).alias("most"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    assert sum(r.n for r in found) == total and len(found) > 10
    # a range is a step of ids of equal width: text may be uneven inside it
    assert all(r.n <= 3 * max(5000, r.most) for r in found) if ranges > 3 else all(r.n <= 60_000 for r in found)
    ends = sorted((r[BLOCK], r.low, r.high) for r in found if r.low is not None)
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    assert blocks(docs.limit(0))[0].count() == 0


@pytest.mark.parametrize("ranges", [2, 16, 16384])
def test_blocks_of_clumped_ids(spark, ranges):
    """Ids in seven clumps of very different width, with some nulls and large ids: no block is much larger than asked."""
    clumps = [(0, 1), (10_000, 1), (1 << 40, 3), ((1 << 40) + 5000, 1), (1 << 50, 1000), ((1 << 52) - 10, 1), (-50_000, 7)]
    rows = [(base + step * i, "x" * (50 + i % 100)) for base, step in clumps for i in range(400)] + [(None, "y" * 30)] * 14 + [((1 << 63) - 1, "z" * 40)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got, total = blocks(docs, chars=10_000, ranges=ranges)
    found = got.groupBy(BLOCK).agg(F.sum(F.length("text") + ROW).alias("n"), F.count("*").alias("rows"), F.min(F.col("doc_id").isNull()).alias("nulls")).collect()
    assert sum(r.n for r in found) == total and max(r.n for r in found) <= 40_000 and len(found) >= total / 40_000
    assert max((r[BLOCK] for r in found), default=0) == next(r[BLOCK] for r in got.where("doc_id IS NULL").select(BLOCK).collect())
    order = [r[0] for r in got.where("doc_id IS NOT NULL").groupBy(BLOCK).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy(BLOCK).selectExpr("struct(a, b)").collect()]
    assert all(x.b < y.a for x, y in zip(order, order[1:]))


def test_ranges_are_joined_or_divided():
    assert edges(3, 0.0, 9.0, [float(x) for x in range(1, CUTS)]) == ([0.0, 21.0, 43.0, 10.0], 1)
    assert edges(1, 0.0, 9.0, []) == ([0.0, 10.0], 1) and edges(200, 0.0, 9.0, [1.0] * (CUTS - 1))[1] == 3
    assert [x[1:3] for x in planned([(0.0, 0, 9, 10), (1.0, 10, 19, 80), (2.0, 20, 29, 950), (3.0, 30, 39, 20)], 100)] == [(0, 1), (0, 1), (1, 10), (11, 1)]


def test_only_shards_that_occur():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 40, 300, dtype=np.int64).astype(np.uint64))
    names, begins = present(values, 6, 40)
    cut = shards(values, 6, 40)
    assert names.tolist() == np.flatnonzero(np.diff(cut)).tolist() and begins[:-1].tolist() == cut[:-1][names].tolist() and begins[-1] == 300
    assert [x.tolist() for x in present(values[:0], 6, 40)] == [[], [0]] and present(values, 0, 40)[1].tolist() == [0, 300]


def test_a_line_of_all_documents_is_asked_of_each_block_once():
    """A thousand blocks with one window in common: each but the first gets it from the one before, so none serves many."""
    hashes = np.array([5, 70], np.uint64)
    sent = [(k, packed(hashes if k % 10 == 0 else hashes[:1])) for k in range(1000)]
    rows = pa.table({"shard": pa.array([0] * 1000, pa.int32()), "block": pa.array([k for k, _ in sent][::-1], pa.int32()), "payload": pa.array([x for _, x in sent][::-1], pa.binary())})
    asked = _confirm(rows).to_pylist()
    of = {r["block"]: (np.frombuffer(r["at"], "<u4").tolist(), np.frombuffer(r["targets"], "<i4").tolist()) for r in asked}
    assert len(of) == 999 and all(len(t) <= 2 for _, t in of.values())
    assert of[0] == ([0, 1], [1, 10]) and of[3] == ([0], [4]) and of[980] == ([0, 1], [981, 990])


def test_lists_of_hashes():
    random = np.random.default_rng(1)
    for most in (1 << 20, 1 << 45, 1 << 63):
        x = np.unique(random.integers(0, most, 500, dtype=np.int64).astype(np.uint64))
        assert (unpacked(packed(x)) == x).all() and (unpacked(packed(x[:1])) == x[:1]).all()
    cut = shards(x, 3, 63)
    assert cut[0] == 0 and cut[-1] == len(x) and all((x[a:b] >> np.uint64(60) == k).all() for k, (a, b) in enumerate(zip(cut, cut[1:])))


def test_words_are_numbered_by_their_bytes():
    import pyarrow as pa

    w = Words(pa.array(["a b aa a", "b aa ab c"]))
    for bits in (0, 1, 64):
        ids = word_ids(w.data, w.starts, w.ends, w.hashes >> np.uint64(64 - bits) if bits else w.hashes * np.uint64(0)).tolist()
        names = "a b aa a b aa ab c".split()
        assert all((ids[i] == ids[j]) == (names[i] == names[j]) for i in range(8) for j in range(8))


def test_only_what_an_automaton_reports_goes():
    ids, own = np.array([1, 2, 3, 1, 2, 3, 4, 2, 3, 4]), np.array([0, 3, 7, 10])
    ranks = np.array([0, 1, 2])
    def found(*passages, limits=None, most=9):
        cuts = np.cumsum([0, *map(len, passages)])
        return reported(ids, own, ranks, np.array([x for p in passages for x in p], int), cuts, np.array(limits or [-1] * len(passages)), 3, most).tolist()

    assert found() == [] and found([1, 2]) == []
    assert found([1, 2, 3], [2, 3, 4], limits=[0, 1], most=1) == [3, 7]
    assert found([3, 1, 2]) == []  # not over the border of texts
    assert found([1, 2, 3, 4]) == [0, 3, 4, 7]
    assert covered(np.array([0, 1, 6]), 10, 3).tolist() == [True] * 4 + [False] * 2 + [True] * 3 + [False]
    assert c.U64(1)


def test_crowded_anchors():
    """An anchor that many passages share, against plain search."""
    random = np.random.default_rng(5)
    for size in (3, 4, 5, 13):
        texts = [random.integers(0, 2, int(n)) for n in random.integers(0, 120, 30)]
        passages = [random.integers(0, 2, int(n)) for n in random.integers(0, 40, 25)] + [texts[3][:30], texts[3][:30]]
        limits = np.full(len(passages), 4)  # equal windows have one limit, as in a block
        known = {tuple(p[k : k + size].tolist()) for p in passages for k in range(len(p) - size + 1)}
        own = np.cumsum([0, *map(len, texts)])
        want = [int(own[d]) + k for d, t in enumerate(texts) for k in range(len(t) - size + 1) if d > 4 and tuple(t[k : k + size].tolist()) in known]
        for most in (3, 1000):
            got = reported(np.concatenate(texts), own, np.arange(30), np.concatenate(passages), np.cumsum([0, *map(len, passages)]), limits, size, most)
            assert got.tolist() == want
