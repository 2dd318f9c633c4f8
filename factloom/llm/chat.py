"""Chat formatting of reply trees.

Messages name their parent. Iterated self-joins with pointer doubling give each message its distance to the root and the
sum of the scores on the way, in as many rounds as the logarithm of the depth; the leaves of a tree are ranked by that
sum (ties: the smaller message), and the chosen leaves' paths are enumerated from the same pointers, again in so many
rounds. Each path becomes one conversation.

A turn is `### role:`, a line break, the text, `</turn>` and a line break. In roles and texts a backslash, # and < (and :
in a role) are written as a backslash and a letter, so neither can contain a control string, and reading back is exact.
The loss mask lists the spans of assistant texts in the formatted string, in code points.

A message whose parent isn't there is a root. Messages in a cycle lead to no root and form no path. Of several rows of one
message (tree, node) the first counts: by parent (null first), greatest score, role, text. Null role or text is
empty. Turns with equal numbers stand by role and text. A null conversation is a conversation of its own. A very long
text is one turn like any other, and one conversation is one string. An empty table gives no rows. Only the columns named
are read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import common as c

TURN = "</turn>\n"


def single(messages: DataFrame) -> DataFrame:
    """One row of each message."""
    named = [k for k in ("role", "text") if k in messages.columns]
    first = Window.partitionBy("tree", "node").orderBy("parent", F.desc("score"), *named)
    return messages.select("tree", "node", "parent", "score", *named, F.row_number().over(first).alias("factloom_n")).where("factloom_n = 1").drop("factloom_n")


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages (tree, node, parent, score) -> (tree, rank, node, place): the `keep` best root-to-leaf paths of each tree."""
    return _paths(single(messages), keep)


def _paths(messages: DataFrame, keep: int) -> DataFrame:
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    start = messages.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("hops"))
    start = c.written(start, "replies")
    open_, done, levels = start, [], []
    for _ in range(start.count().bit_length() + 1):  # only messages that haven't reached their root are joined again; those in a cycle never do
        done.append(open_.where("up IS NULL"))
        open_ = open_.where("up IS NOT NULL")
        if not open_.limit(1).count():
            break
        levels.append(open_)
        every = reduce(DataFrame.unionByName, done, open_)
        above = every.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("hops").alias("far"))
        open_ = c.written(open_.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("hops") + F.col("far")).alias("hops")), "replies")
    ends = reduce(DataFrame.unionByName, done)
    parents = start.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = ends.join(parents, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    on = c.written(chosen.select("tree", "rank", "node", F.col("hops").alias("place")), "paths")
    for k, level in reversed(list(enumerate(levels))):
        jump = level.select("tree", "node", "up")
        above = on.join(jump, ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        on = c.written(on.unionByName(above), "paths")
    return on


#: How characters of control strings are written inside roles and texts; the colon in roles only.
CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
COLON = {":": "\\c"}
PLAIN = {code[1]: char for char, code in (CODES | COLON).items()}


def escaped(x, codes=CODES):
    out = F.coalesce(x, F.lit(""))
    for char, code in codes.items():  # the backslash comes first
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages (tree, node, parent, score, role, text) -> (tree, rank, n_turns, formatted, loss_spans), one row a path."""
    return _formatted(single(messages), keep)


def _formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    rows = _paths(messages, keep).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit("### "), escaped(F.col("role"), CODES | COLON), F.lit(":\n"))
    rows = rows.select("tree", "rank", "place", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escaped(F.col("text")).alias("body"))
    ends = F.sum(F.length("head") + F.length("body") + len(TURN)).over(Window.partitionBy("tree", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", ends - len(TURN)).withColumn("turn", F.concat("head", "body", F.lit(TURN)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("stop")))
    whole = rows.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return whole.select("tree", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x.turn), "").alias("formatted"), "loss_spans")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns = (turn[len("### ") :].partition(":\n") for turn in text.split(TURN)[:-1])
    return [(unescaped(role), unescaped(body)) for role, _, body in turns]


def from_turns(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = c.written(rows.withColumn("node", at).drop("turn"), "turns")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
PROBE = "\\### Assistant: </turn> ok"


def report(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and one that holds control strings, read back from the formatted strings."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    done = _formatted(from_turns(rows.unionByName(probe)))  # numbered, so each message is one row

    def run(batches):
        for batch in batches:
            out = []
            for tree, text, spans in zip(*(batch.column(x).to_pylist() for x in ("tree", "formatted", "loss_spans"))):
                turns = read_back(text)
                loss = "".join(unescaped(text[s["start"] : s["stop"]]) for s in spans)
                out.append((int(tree) if tree else None, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return done.mapInArrow(run, SCHEMA)
