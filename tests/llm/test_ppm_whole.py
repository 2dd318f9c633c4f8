"""The sharded scores are those of one trie of all n-grams, also where these are more than a million."""

import random

import numpy as np
import pytest

from factloom.llm import ppm
from factloom.llm.langid import held_out


def test_all_ngrams_count(spark):
    random.seed(8)
    rows = [(i, "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=4000))) for i in range(100)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, "É x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    trie = ppm.learn(docs.where(~held_out(of=5, at=1)))
    assert len(trie.count) > 1_000_000
    got = {r.doc_id: r.score for r in ppm.report(docs).collect()}
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        codes, _ = ppm.coded(*ppm.spelled(data, np.array([0, len(data)])))
        assert got[i] == pytest.approx(trie.scores(codes).sum(), rel=1e-9)


def test_blocks_of_one_text_and_threshold(spark):
    """Scores don't depend on how texts are packed; a trie of few n-grams keeps no more than asked."""
    random.seed(9)
    rows = [(i, " ".join(random.choices(["ab", "Bc", "é", "zz\tq", "w" * 30], k=40))) for i in range(40)] + [(None, "ab"), (3, None), (41, ""), (42, "ab " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    key = lambda r: (r.doc_id or -1, r.n_tokens)
    a, b = (sorted(ppm.report(docs, chars).collect(), key=key) for chars in (100, 8_000_000))
    assert [tuple(r)[:-2] for r in a] == [tuple(r)[:-2] for r in b]
    assert [r.score for r in a] == pytest.approx([r.score for r in b]) and [r.base_score for r in a] == pytest.approx([r.base_score for r in b])
    for nodes in (20, 100, 300):
        assert len(ppm.learn(docs, nodes).count) <= nodes
