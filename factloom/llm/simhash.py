"""SimHash near-duplicates, with candidates by the pigeonring principle.

A document's fingerprint: words (split at ASCII white space, A-Z lower-cased), shingles of three (repeats count), the
XXH64 of each with seed 42; a bit is 1 if it is set in more than half of the hashes. A text of fewer words is one
shingle; without words (null, empty) the fingerprint is zero, linked like any other. Fingerprints link at no more than
two differing bits.

Pigeonring: the 64 bits are a ring of three segments with a budget of two differing bits. Of any two fingerprints within
budget there is a segment from which each chain of k consecutive segments differs in at most 2k/3 bits: none in the
first, one in the first two, two in all. So a fingerprint enters the index under its first segment and its second one,
as it is or with one bit changed, for each of the three starts; keys that only one fingerprint has are pruned there.
The rest go on to the third segment in the same way, until whole keys meet. A whole key is within one bit of all that
meet at it, which are 65 at most, so each key links its members to the least of them; those links pass the full Hamming
check. No pairs of a group are made: work is linear in the number of distinct fingerprints, and exact copies are one.

Copies of one text are looked up by broadcast where they are more than one in a thousand rows, so no task holds them all.

Repeated rows and doc_ids are members like any others; a null doc_id doesn't name a component unless no other is there.
A very long text is shingled in one piece, like any other. An empty table gives no rows. `report` takes doc_id and text
alone; `keep_one` keeps all columns, whatever their names, but for factloom_fp and factloom_key, which are reserved.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import common as c
from factloom.llm.graph import components

SHINGLE = 3
SEED = 42
#: First bit and number of bits of the segments of the ring.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: str, size: int = SHINGLE, digest=xxhash.xxh64_intdigest) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < size:
        return [digest(line, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])]


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    hashes, offsets = [], [0]
    for t in texts:
        hashes += shingle_hashes(t or "", size)
        offsets.append(len(hashes))
    at = np.array(offsets)
    n = np.diff(at)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for piece in c.pieces(batches):
            fp = fingerprints(piece.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _changes() -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the index: the start of its chain, and the bit of the second segment that it changes (0: none)."""
    start, flip = [], []
    for i in range(len(SEGMENTS)):
        first, n = SEGMENTS[(i + 1) % 3]
        start += [i] * (n + 1)
        flip += [0, *(1 << b for b in range(first, first + n))]
    return np.array(start), np.array(flip, np.uint64)


START, FLIP = _changes()
#: The bits of the first two segments of a chain, and of its last one, by its start.
CHAIN = np.array([sum(1 << b for k in (i, (i + 1) % 3) for b in range(SEGMENTS[k][0], sum(SEGMENTS[k]))) for i in range(3)], np.uint64)


def _chain_keys(fp: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """What two entries of the index have in common if their chains agree."""
    return c.mixed(((fp ^ FLIP[entry]) & CHAIN[START[entry]]) ^ (START[entry].astype(np.uint64) + c.U64(1)) * c.U64(0x9E3779B97F4A7C15))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def chained(fp: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among entries of the index: prune by the first two segments, go on to the third, check in full."""
    order, begin = _groups(_chain_keys(fp, entry))
    fp, entry = fp[order], entry[order]
    if not len(fp):
        return fp, fp
    exact = FLIP[entry] == 0
    some = (np.minimum.reduceat(fp, begin) != np.maximum.reduceat(fp, begin)) & np.logical_or.reduceat(exact, begin)
    live = np.repeat(some, np.diff(np.append(begin, len(fp))))
    fp, entry, exact = fp[live], entry[live], exact[live]
    mids, owner = [fp ^ FLIP[entry]], [fp]
    for i in range(3):
        own = fp[exact & (START[entry] == i)]
        first, n = SEGMENTS[(i + 2) % 3]
        for b in range(first, first + n):
            mids.append(own ^ c.U64(1 << b))
            owner.append(own)
    mids, owner = np.concatenate(mids), np.concatenate(owner)
    order, begin = _groups(mids)
    if not len(begin):
        return mids, owner
    owner = owner[order]
    hub = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(owner))))
    near = (hub != owner) & (np.bitwise_count(hub ^ owner) <= 2)
    pairs = np.unique(np.stack([hub[near], owner[near]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, shard_entries: int = 1_000_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp: same components as all pairs that differ in two bits or fewer.

    Entries go to shards by their chains' keys, packed: a fingerprint and one byte for the entry.
    """
    shards = 1 << max(4, (fps.count() * len(FLIP) // shard_entries).bit_length())

    def send(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            fp, entry = np.repeat(own, len(FLIP)), np.tile(np.arange(len(FLIP)), len(own))
            shard = (_chain_keys(fp, entry) % c.U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            full = [k for k in range(shards) if cut[k] < cut[k + 1]]
            fp, entry = fp[order], entry[order].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([fp[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()), pa.array([entry[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["shard", "fps", "entries"])

    def join(rows):
        fp = np.frombuffer(b"".join(rows.column("fps").to_pylist()), np.uint64)
        entry = np.frombuffer(b"".join(rows.column("entries").to_pylist()), np.uint8)
        a, b = chained(fp, entry)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = fps.select("fp").mapInArrow(send, "shard int, fps binary, entries binary")
    return sent.groupBy("shard").applyInArrow(join, "a bigint, b bigint").distinct()


def labelled(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own: doc_id, fp -> the distinct fingerprints with their least doc_id, and the labels of the linked ones."""
    fps = c.written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return fps, components(links(fps.select("fp"))).withColumnRenamed("node", "fp")


def linked(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id that links reach."""
    own = c.written(fingerprinted(docs, size), "fingerprints")
    fps, labels = labelled(own)
    named = c.written(fps.join(labels, "fp").select("fp", "label", "least"), "named")
    group = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = c.looked_up(named, group, "label").select("fp", "component_id")
    by_fp = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return c.looked_up(own, by_fp, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


FP, KEY = "factloom_fp", "factloom_key"


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of each group of linked documents the row with the least doc_id (nulls last; then the least fingerprint, then text); all columns stay."""
    fps, labels = labelled(c.written(fingerprinted(docs, size), "fingerprints"))
    group = F.coalesce("label", "fp")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("fp"))).alias("x")
    keep = fps.join(labels, "fp", "left").groupBy(group.alias("label")).agg(first)
    keep = keep.select(F.coalesce("x.doc_id", F.lit((1 << 63) - 1)).alias(KEY), F.col("x.fp").alias(FP))

    def run(batches):
        for piece in c.pieces(batches):
            fp = fingerprints(piece.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(fp.view(np.int64))], [*piece.schema.names, FP])

    rows = docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(FP)).schema)
    rows = rows.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    first = F.row_number().over(Window.partitionBy(KEY, FP).orderBy("text"))
    return rows.join(keep, [KEY, FP], "left_semi").withColumn(FP + "_n", first).where(F.col(FP + "_n") == 1).select(docs.columns)
