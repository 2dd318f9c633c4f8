r"""Prefix trie of conversations: what a cache of shared beginnings would save, node by node.

A conversation is a sequence of turns (role, text); each distinct sequence of first turns is a node, from the textless
root down. The members of a node are the conversations that begin with it. Nothing walks a tree:

* A node is named by its depth and two 64-bit hashes, the running XOR of hashes of (depth, role, text).
* Each node is owned by its smallest member. Deeper nodes have fewer members, so a conversation owns a suffix of its
  path: one number, the least depth that it owns, says which nodes are its own (`owners`).
* A subtree's sum over its nodes of (members - 1) x words is the members' words from that depth on, minus those words of
  them that stand in nodes they own. Each conversation knows both sums at each of its depths, so one group-by of
  occurrences by node gives all subtrees. So does the number of leaves: a leaf has one owner, which adds one.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length is many tasks: running numbers,
hashes and word counts are windows within a range, and what the ranges before it add up to is carried over. Only
conversations that several ranges have need that, two ranges' border each, so the carry is broadcast: as many rows as
there are ranges. A node that a third of all conversations have is summed before its shuffle, or looked up by broadcast
(`common.looked_up`). Members that end at a node are joined to text by ranges of conv_id and hashed as a stream.

Order of turns: turn (null first), then role, then text; repeated rows are turns like any others. A null role or text is
empty. Rows without a conv_id belong to no conversation and are left out. An empty table gives no rows, not even a root.
A very long text is one hash and one word count. `report` takes conv_id, turn, role and text, whatever else there is.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm import common as c

WORD = r"[^\x20\x09-\x0D]+"
#: The turns shared with the conversation whose id is the next lower multiple of BASE: crc32 of the id mod SHARED.
BASE, SHARED = 20, 4


def ranged(turns: DataFrame) -> DataFrame:
    """conv_id, part, n (from 1), hash, words: turns numbered in order, and the range that each stands in."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ("turn", "role", "text")
    dealt = own.repartitionByRange(c.spread(own.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part", "conv_id").orderBy(*order)
    rows = dealt.select("conv_id", "part", F.row_number().over(within).cast("long").alias("n"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = c.written(rows, "turns")
    before = carried(rows, {"before": F.count("*")}, {"before": F.sum})
    return rows.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", "part", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "a", "b", "words")


def carried(rows: DataFrame, sums: dict[str, Column], fold: dict) -> DataFrame:
    """(conv_id, part, sums of the parts before it), for the conversations that stand in several parts: parts of them, so few."""
    split = rows.groupBy("conv_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("conv_id")
    each = rows.join(F.broadcast(split), "conv_id", "left_semi").groupBy("conv_id", "part").agg(*(v.alias(k) for k, v in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("conv_id", "part", *(f(k).over(earlier).alias(k) for k, f in fold.items()))


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns (conv_id, part, n, a, b, words) -> (conv_id, part, depth, a, b, words) of rebuilt conversations.

    A conversation begins with the first h turns of its base, then come its own after its first h. Base turns have part -1.
    """
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE)
    heads = turns.where((F.col("n") < SHARED) & (F.col("conv_id") % BASE == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("n", "a", "b", "words"))).alias("head"))  # SHARED - 1 turns
    convs = convs.join(heads, "base", "left").withColumn("head", F.filter(F.coalesce("head", F.array()), lambda x: x.n <= F.col("h")))
    first = convs.select("conv_id", F.lit(-1).alias("part"), F.explode("head").alias("x")).select("conv_id", "part", F.col("x.n").alias("depth"), "x.a", "x.b", "x.words")
    # each range of a long conversation gets the two numbers for itself
    shift = turns.groupBy("conv_id", "part").agg(F.max("n").alias("last")).join(convs.select("conv_id", "h", F.size("head").alias("k")), "conv_id").where("last > h").drop("last")
    rest = turns.join(shift, ["conv_id", "part"]).where("n > h").select("conv_id", "part", (F.col("n") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "words")
    return first.unionByName(rest)


def occurrences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, part, node, parent, depth, words, below, ends): a row for each conversation and depth, the root included.

    below: words of the conversation from this depth on; ends: the last one. rows: conv_id, part, depth, a, b, words.
    """
    tag = lambda x: F.xxhash64("depth", x)
    rows = c.written(rows.select("conv_id", "part", "depth", tag("a").alias("a"), tag("b").alias("b"), "words"), "rebuilt")
    total = rows.groupBy("conv_id").agg(F.sum("words").alias("total"), F.max("depth").alias("last"))
    names = {"a0": F.bit_xor("a"), "b0": F.bit_xor("b"), "w0": F.sum("words")}
    before = carried(rows, names, {"a0": F.bit_xor, "b0": F.bit_xor, "w0": F.sum})
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.groupBy("conv_id", "part").agg(F.lit(None)).select("conv_id", "part").join(total, "conv_id").join(F.broadcast(before), ["conv_id", "part"], "left")
    zero = F.lit(0).cast("long")
    own = own.select("conv_id", "part", "total", "last", *(F.coalesce(k, zero).alias(k) for k in names))
    dealt = rows.join(own, ["conv_id", "part"])
    path = {k: F.bit_xor(k).over(within).bitwiseXOR(F.col(k + "0")) for k in "ab"}
    run = dealt.select("conv_id", "part", "depth", "words", "last", path["a"].alias("x"), path["b"].alias("y"), "a", "b", (F.col("total") - F.sum("words").over(within) - F.col("w0") + F.col("words")).alias("below"))
    node = F.struct("depth", F.col("x").alias("a"), F.col("y").alias("b"))
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("x").bitwiseXOR(F.col("a")).alias("a"), F.col("y").bitwiseXOR(F.col("b")).alias("b"))
    run = run.select("conv_id", "part", node.alias("node"), up.alias("parent"), "words", "below", (F.col("depth") == F.col("last")).alias("ends"))
    top = F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    roots = convs.join(total, "conv_id", "left").select("conv_id", F.lit(-1).alias("part"), top.alias("node"), F.lit(None).cast(run.schema["parent"].dataType).alias("parent"), zero.alias("words"), F.coalesce("total", zero).alias("below"), F.col("total").isNull().alias("ends"))
    return run.unionByName(roots)


def owners(nodes: DataFrame) -> DataFrame:
    """(conv_id, least, own_words, leaf) of the conversations that own nodes: the least depth owned, the conversation's words from there on, and whether its last node is a leaf."""
    first = F.min(F.struct(F.col("node.depth").alias("depth"), F.col("below"))).alias("x")
    return nodes.groupBy("conv_id").agg(first, F.max(F.col("n_children") == 0).cast("long").alias("leaf")).select("conv_id", F.col("x.depth").alias("least"), F.col("x.below").alias("own_words"), "leaf")


def ends_sha256(seen: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ascending ids of the conversations that end at a node, joined by commas.

    seen: node, conv_id. Ids are joined in ranges; a node's ranges pass through one hash in constant memory.
    """
    dealt = seen.repartitionByRange(c.spread(seen.sparkSession), "conv_id").withColumn("range", F.spark_partition_id())
    joined = dealt.groupBy("node", "range").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    rows = joined.select("node", "range", "ids").repartition("node").sortWithinPartitions("node", "range")

    def run(batches):
        node, sha = None, None
        for batch in batches:
            names, shas = [], []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if own == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        names.append(node)
                        shas.append(sha.hexdigest())
                    node, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("node").type), pa.array(shas, pa.string())], ["node", "ends_sha256"])
            kind = batch.schema.field("node").type
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return rows.select("node", "ids").mapInArrow(run, rows.select("node", F.lit("").alias("ends_sha256")).schema)


def trie(seen: DataFrame) -> DataFrame:
    """Occurrences -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seen = c.written(seen, "occurrences")
    nodes = seen.groupBy("node").agg(F.min(F.struct("conv_id", "below")).alias("x"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"))
    nodes = c.written(nodes.select("node", "x.conv_id", "x.below", "parent", "n_convs"), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = c.written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    owned = c.written(owners(nodes), "owners")

    # a conversation's range of occurrences, with what the conversation owns
    mine = seen.groupBy("conv_id", "part").agg(F.lit(None)).select("conv_id", "part").join(owned, "conv_id")
    marked = seen.join(mine, ["conv_id", "part"], "left")
    zero = F.lit(0).cast("long")
    not_own = F.when(F.col("node.depth") >= F.col("least"), zero).otherwise(F.col("below") - F.coalesce("own_words", zero))
    sums = marked.groupBy("node").agg(F.sum(not_own).alias("saved_tokens"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))

    # the parent's owner: the node's own, but for the first node that a conversation owns
    firsts = nodes.join(owned.select("conv_id", F.col("least").alias("l")), "conv_id").where((F.col("node.depth") == F.col("l")) & F.col("parent").isNotNull())
    firsts = c.written(firsts.select(F.col("node").alias("child"), F.col("parent").alias("node")), "firsts")
    above = c.looked_up(firsts, nodes.select("node", F.col("conv_id").alias("above")), "node").select(F.col("child").alias("node"), "above")

    ends = ends_sha256(seen.where("ends").select("node", "conv_id"))
    rows = nodes.join(sums, "node").join(above, "node", "left").join(ends, "node", "left")
    parent = F.when(F.col("parent").isNotNull(), F.coalesce("above", "conv_id")).alias("parent_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", F.col("node.depth").cast("long").alias("depth"), parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = c.written(ranged(conversations), "numbered")
    return trie(occurrences(rebuilt(turns), turns.select("conv_id").distinct()))
