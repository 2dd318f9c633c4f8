"""An empty table, very long texts and extra columns in chat formatting."""

import hashlib

from factloom.llm import chat


def test_empty_long_and_extra(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, tree string, node string"
    none = chat.report(spark.createDataFrame([], schema)).collect()
    assert [(r.conv_id, r.n_turns) for r in none] == [(-7, 2)]
    long = "a <b> # \\ " * 30_000
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame([(1, 0, "user", "q", "x", "y"), (1, 1, "assistant", long, "x", "y")], schema)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_repeated_messages_count_once(spark):
    """A path of three messages, each there twice, has three turns; of unlike rows of one message the first counts."""
    rows = [("t", 1, None, 1.0, "user", "hi"), ("t", 2, 1, 1.0, "assistant", "yo"), ("t", 3, 2, 1.0, "user", "ok")] * 2
    rows += [("t", 2, 1, 0.5, "assistant", "less"), ("t", 1, 9, 7.0, "user", "has a parent"), (None, 1, None, 1.0, "user", None)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = {r.tree: (r.n_turns, chat.read_back(r.formatted)) for r in chat.formatted(messages).collect()}
    assert got["t"] == (3, [("user", "hi"), ("assistant", "yo"), ("user", "ok")])
    assert chat.paths(messages).where("tree = 't'").count() == 3
