"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of LEAST or more, and what they reach.

`keep_one` with fingerprints also takes all links of SimHash fingerprints, found by the pigeonring index of
`simhash.links`; groups are components of both kinds of links together, so neither loses one to the other's order.

Words are split at ASCII white space, A-Z lower-cased; a text of fewer words than SHINGLE is one shingle; texts without
words (null, empty) are copies of each other. Texts with equal sets are one node.

Candidates: BANDS keys a node, each of ROWS min-hashes. A pair at 0.8 has no key in common with a probability of
(1 - 0.8 ** 5) ** 32 = 3e-6. A 64-bit SimHash alone doesn't find them: at 0.8 fingerprints differ in about 10 bits, and no
ring of segments tells such pairs from the others at scale. All candidates pass an exact check of the two sets, in two steps:

1. Each bucket (nodes with a key in common) has its members checked against the least of them, if their sizes allow a
   similarity of LEAST. The checks of one node are dealt over tasks of HUB members; a task holds that node's set and
   streams the others'. What passes is linked.
2. A bucket whose members aren't one component by then has all pairs of different components checked, in blocks of two
   parts of PART members or PART_BYTES of sets, which give only the links that join components. So no pairs are made of
   a group of copies, and none of a bucket's pairs is left out.

Texts are read once for keys, and those of candidates once more for their sets: a bitmap of BITS bits, which is all that
is broadcast of them, keeps most other texts out. Sets are compared by 64-bit hashes of shingles. A null doc_id is larger
than any other and doesn't name the copy to keep unless no other is there; repeated doc_ids are members like any others.
A very long text is one set. An empty table gives no rows. All columns stay, whatever their names, but for those that
begin with factloom_, which are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import common as c, simhash
from factloom.llm.graph import components

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
HUB = 1000
PART, PART_BYTES = 256, 4 << 20
BITS = 1 << 27
#: Bytes of text that are shingled at once: each takes some forty in between.
PIECE = 1 << 18
LAST = (1 << 63) - 1
NODE, KEY, SIZE, KEYS, FP = "factloom_node", "factloom_key", "factloom_size", "factloom_keys", "factloom_fp"
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS, ROWS, 2), dtype=np.int64).astype(c.U64) | c.U64(1)


def shingles(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another; and the texts' offsets into them."""
    data, offsets = c.flat(texts)
    low = c.LOWER[data]
    starts, ends, words_at = c.runs(c.NOT_SPACE[low], offsets)
    words = c.span_hashes(low, starts, ends)
    at, hashes = c.windows(words, words_at, size)
    n_words = np.diff(words_at)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    own = np.concatenate([np.searchsorted(words_at, at, "right") - 1, short])
    hashes = np.concatenate([hashes, c.span_hashes(words, words_at[short], words_at[short + 1], c.WORD_BASE)])
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.append(True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])) if len(own) else np.zeros(0, bool)
    own, hashes = own[new], hashes[new]
    return hashes, np.searchsorted(own, np.arange(len(n_words) + 1))


def nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    n = np.diff(offsets)
    out = np.zeros(len(n), c.U64)
    full = n > 0
    if full.any():
        out[full] = c.mixed(np.add.reduceat(c.mixed(hashes), offsets[:-1][full]) + n[full].astype(c.U64))
    return out.view(np.int64)


def bands(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys of each set that isn't empty."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(at), BANDS), c.U64)
    if len(at):
        for b in range(BANDS):
            key = np.full(len(at), b + 1, c.U64)
            for r in range(ROWS):
                key = c.mixed(key * FACTORS[b, r, 0] + np.minimum.reduceat((hashes ^ FACTORS[b, r, 1]) * FACTORS[b, r, 0], at))
            out[:, b] = key
    return out.view(np.int64)


def _signed(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """docs with NODE, SIZE (distinct shingles), KEYS (none for an empty set), FP (null without fingerprints) and KEY (the doc_id or LAST), written."""

    def run(batches):
        for piece in c.pieces(batches, most=PIECE):
            hashes, offsets = shingles(piece.column("text"))
            keys = bands(hashes, offsets)
            at = np.append(0, np.cumsum(np.diff(offsets) > 0)) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.ravel()))
            fp = pa.array(simhash.fingerprints(piece.column("text").to_pylist()).view(np.int64)) if fingerprints else pa.nulls(len(piece), pa.int64())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(nodes(hashes, offsets)), pa.array(np.diff(offsets)), lists, fp], [*piece.schema.names, NODE, SIZE, KEYS, FP])

    zero = F.lit(0).cast("long")
    rows = docs.mapInArrow(run, docs.select("*", zero.alias(NODE), zero.alias(SIZE), F.array().cast("array<bigint>").alias(KEYS), F.lit(None).cast("long").alias(FP)).schema)
    return c.written(rows.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))), "signed")


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """BITS bits, of which those of the column's values are set."""
    at = F.pmod(F.xxhash64(column), F.lit(BITS)) + 1  # the functions count from 1
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in found.collect():  # BITS at most
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    p, q = LEAST
    n = len(a) + len(b)
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * q >= (n - both) * p


def _check(batches):
    """Rows (a, part, b, shingles) sorted by (a, part, b), null first: the set of a itself first, then those of its candidates."""
    key, own = None, None
    for batch in batches:
        a, b = [], []
        for x, part, y, text in zip(*(batch.column(k) for k in ("a", "part", "b", "shingles"))):
            found = np.frombuffer(text.as_buffer(), c.U64)
            if not y.is_valid:
                key, own = (x, part), found.copy()
            elif key == (x, part) and _alike(own, found):
                a.append(x.as_py())
                b.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _across(rows: pa.Table) -> pa.Table:
    """Links between components among the members of one block."""
    node, label, part = (rows.column(x).to_numpy() for x in ("node", "label", "part"))
    sets = [np.frombuffer(x.as_buffer(), c.U64) for x in rows.column("shingles")]
    n = np.array([len(x) for x in sets])
    label = label.copy()
    same_part = rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py()
    p, q = LEAST
    out = []
    for i in range(len(node)):
        some = (label != label[i]) & (np.minimum(n, n[i]) * q >= np.maximum(n, n[i]) * p)
        some[: i + 1] = False
        if not same_part:
            some &= part != part[i]
        for j in np.flatnonzero(some):
            if label[j] != label[i] and _alike(sets[i], sets[j]):
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _sets(signed: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in needed, and of few others, once each."""
    bits = signed.sparkSession.sparkContext.broadcast(_bitmap(needed, "node"))
    at = F.pmod(F.xxhash64(NODE), F.lit(BITS)).cast("long").alias("at")

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            some = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for piece in c.pieces([batch.filter(pa.array(some.astype(bool)))], most=PIECE):
                hashes, offsets = shingles(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], ["node", "shingles"])

    texts = signed.where(F.col(SIZE) > 0).select(F.col(NODE).alias("node"), at, F.col("text").cast("string").alias("text"))
    return c.written(texts.mapInArrow(run, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _sizes_allow(a, b):
    p, q = LEAST
    return F.least(a, b) * q >= F.greatest(a, b) * p


def _fingerprint_links(signed: DataFrame) -> DataFrame:
    """(a, b): nodes with one fingerprint, linked to the least of them, and the least nodes of fingerprints that link."""
    own = c.written(signed.where(F.col(FP).isNotNull()).select(F.col(FP).alias("fp"), F.col(NODE).alias("node")).distinct(), "fingerprints")
    least = c.written(own.groupBy("fp").agg(F.min("node").alias("a")), "distinct")
    same = c.looked_up(own, least, "fp").where("a <> node").select("a", F.col("node").alias("b"))
    near = simhash.links(least.select("fp")).withColumnsRenamed({"a": "fp", "b": "other"}).join(least, "fp")
    return same.unionByName(near.select("a", F.col("other").alias("fp")).join(least.withColumnRenamed("a", "b"), "fp").select("a", "b"))


def labelled(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of `_signed` documents (node, least doc_id), and the labels of those that are linked (node, label)."""
    every = signed.groupBy(F.col(NODE).alias("node")).agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.first(SIZE).alias("size"), F.first(KEYS).alias("keys"))
    every = c.written(every, "nodes")
    entries = every.select("node", "size", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("hub"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.sum("size").alias("total")).where("n > 1")
    buckets = buckets.groupBy("n", "hub", "mix", "total").agg(F.min("key").alias("key")).drop("mix")  # a bucket of the same nodes: once
    members = c.written(entries.join(c.written(buckets, "buckets"), "key"), "members")
    sets = _sets(signed, members.select("node").distinct())

    asked = members.where((F.col("node") != F.col("hub.node")) & _sizes_allow(F.col("size"), F.col("hub.size")))
    pairs = c.written(asked.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    first = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    # a node that very many are asked about is looked up by broadcast
    rest = c.looked_up(pairs, hubs, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", F.col("b").alias("node"))
    rows = first.unionByName(rest).join(sets, "node").select("a", "part", "b", "shingles")
    rows = rows.repartition(c.spread(signed.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    links = c.written(rows.mapInArrow(_check, "a bigint, b bigint").unionByName(_fingerprint_links(signed)), "links")
    labels = components(links)

    members = members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = c.written(members, "members")
    torn = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("total") * 8 / PART_BYTES)).cast("int")
    rest = members.join(torn, "key", "left_semi").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", "node", "label", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    more = c.written(rest.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(_across, "a bigint, b bigint"), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    return every.select("node", "least"), labels


def keep_one(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """Of each group of linked documents the row with the least doc_id (nulls last; then the least node, then text); all columns stay.

    fingerprints: documents whose SimHash fingerprints link, as `simhash` says, are linked as well.
    """
    signed = _signed(docs, fingerprints)
    every, labels = labelled(signed)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("node"))).alias("x")
    keep = every.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(first)
    keep = keep.select(F.coalesce("x.doc_id", F.lit(LAST)).alias(KEY), F.col("x.node").alias(NODE))
    first = F.row_number().over(Window.partitionBy(KEY, NODE).orderBy("text"))
    rows = signed.drop(SIZE, KEYS, FP).join(keep, [KEY, NODE], "left_semi")
    return rows.withColumn(NODE + "_n", first).where(F.col(NODE + "_n") == 1).select(docs.columns)
