"""Blocks of documents: ranges of doc_id of about equal text, for operators whose tasks hold a stretch of text at once.

The fine ranges are row quantiles of doc_id, RANGES at most, so what the driver holds is bounded. Neighbouring ranges
of little text are one block; a range of more text than a block is divided into as many blocks as it needs, at its own
row quantiles (CUTS at most for a range), and beyond those at equal steps of doc_id between them. So blocks grow in
number with the text and not in size, whatever the number of ranges and however doc_ids are clumped. A block is larger
than asked where one document is, where one doc_id (or null, or ids that are one double) has many rows, or where texts
of a range are of very unequal length.

Every row counts ROW characters besides its text. Rows of one doc_id are in one block; a null doc_id is larger than any
other. An empty table is one block without rows. Columns of any name are kept; BLOCK is the only one added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c

CHARS = 3_000_000
RANGES = 1 << 14
CUTS = 64
ROW = 32
LAST = (1 << 63) - 1
BLOCK = "factloom_block"
AT, RANGE, BASE, EDGES, INNER, CUT = (f"{BLOCK}_{x}" for x in ("at", "range", "base", "edges", "inner", "cut"))
#: A double above all doc_ids.
NULLS = 9.3e18


def planned(ranges: list[tuple[float, float, float, int]], chars: int) -> list[tuple[float, int, int, float, float]]:
    """(range, least id, greatest id, characters) in order -> (range, first block, blocks, least id, greatest id)."""
    out, block, filled = [], -1, 0
    for name, low, high, size in ranges:
        if size > chars:
            steps = -(-size // chars)
            out.append((name, block + 1, int(steps), low, high))
            block, filled = block + int(steps), chars
        else:
            if block < 0 or filled + size > chars:
                block, filled = block + 1, 0
            filled += size
            out.append((name, block, 1, low, high))
    return out


def edges(steps: int, low: float, high: float, quantiles: list[float]) -> tuple[list[float], int]:
    """Where the sub-ranges of a range of `steps` blocks begin and the last one ends, and how many equal steps each of them has.

    quantiles: CUTS - 1 of them. All sub-ranges together have `steps` steps or somewhat fewer.
    """
    parts = min(steps, CUTS)
    cuts = [quantiles[round(i * CUTS / parts) - 1] for i in range(1, parts)]
    return [low, *sorted(cuts), high + 1.0], max(1, steps // parts)


def blocks(docs: DataFrame, chars: int = CHARS, ranges: int = RANGES) -> tuple[DataFrame, int]:
    """docs with a column BLOCK, ascending with doc_id, and the number of characters."""
    size = F.coalesce(F.length("text"), F.lit(0)) + ROW
    n, total = docs.agg(F.count("*"), F.sum(size)).first()
    total = total or 0
    parts = max(1, min(ranges, n, 4 * -(-total // chars)))
    if parts == 1 and total <= chars:
        return docs.withColumn(BLOCK, F.lit(0)), total
    keyed = docs.withColumn(AT, F.coalesce(F.col("doc_id").cast("double"), F.lit(NULLS)))
    cuts = keyed.approxQuantile(AT, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    if cuts:
        splits = [-float("inf"), *sorted({*cuts}), float("inf")]
        keyed = Bucketizer(splits=splits, inputCol=AT, outputCol=RANGE, handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn(RANGE, F.lit(0.0))
    measured = keyed.groupBy(RANGE).agg(F.min(AT), F.max(AT), F.sum(size)).collect()  # RANGES rows at most
    plan = planned(sorted(map(tuple, measured)), chars)
    many = [name for name, _, steps, low, high in plan if steps > 1 and low < high]
    found = {}
    if many:
        inside = keyed.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in many], f"{RANGE} double")), RANGE, "left_semi")
        quantiles = F.percentile_approx(AT, [i / CUTS for i in range(1, CUTS)], 50 * CUTS)
        found = dict(map(tuple, inside.groupBy(RANGE).agg(quantiles).collect()))  # CUTS numbers a range
    rows = [(name, base, *edges(steps if name in found else 1, low, high, found.get(name, []))) for name, base, steps, low, high in plan]
    schema = f"{RANGE} double, {BASE} int, {EDGES} array<double>, {INNER} int"
    keyed = keyed.join(F.broadcast(docs.sparkSession.createDataFrame(rows, schema)), RANGE)
    # the last edge at or below the id: quantiles that are equal leave blocks empty
    below = F.when(F.size(EDGES) > 2, F.size(F.filter(EDGES, lambda x: x <= F.col(AT))) - 1).otherwise(0)
    keyed = keyed.withColumn(CUT, below.cast("int"))
    low, high = F.get(EDGES, F.col(CUT)), F.get(EDGES, F.col(CUT) + 1)
    step = F.least(F.floor((F.col(AT) - low) / (high - low) * F.col(INNER)).cast("int"), F.col(INNER) - 1)
    step = F.when(F.col(INNER) > 1, step).otherwise(0)
    return keyed.withColumn(BLOCK, F.col(BASE) + F.col(CUT) * F.col(INNER) + step).drop(AT, RANGE, BASE, EDGES, INNER, CUT), total


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit values as steps of four, six or eight bytes."""
    steps = np.diff(ascending, prepend=c.U64(0))
    most = int(steps[1:].max()) if len(steps) > 1 else 0
    bytes_ = 4 if most < 1 << 32 else 6 if most < 1 << 48 else 8
    return bytes([bytes_]) + steps[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :bytes_].tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    bytes_ = payload[0]
    steps = np.zeros(((len(payload) - 9) // bytes_ + 1, 8), np.uint8)
    steps[0] = np.frombuffer(payload, np.uint8, 8, 1)
    steps[1:, :bytes_] = np.frombuffer(payload, np.uint8, offset=9).reshape(-1, bytes_)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=c.U64)


def shards(ascending: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where each of the 2 ** bits ranges of values of `width` bits begins, and the end."""
    begins = np.arange(1 << bits, dtype=c.U64) << c.U64(width - bits) if bits else np.zeros(1, c.U64)
    return np.append(np.searchsorted(ascending, begins), len(ascending))


def present(ascending: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The shards, by their upper `bits`, that some values of `width` bits are in; where each begins, and the end."""
    names = (ascending >> c.U64(width - bits) if bits else np.zeros(len(ascending), c.U64)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return names[begins], np.append(begins, len(ascending))


def dealt(name: int, values, names: np.ndarray, begins: np.ndarray) -> pa.Table:
    """A row for each shard that gets something: its number, the block's name, and what the shard gets."""
    payload = [values(a, b) for a, b in zip(begins.tolist(), begins[1:].tolist())]
    return pa.table({"shard": pa.array(names, pa.int32()), "block": pa.array([name] * len(names), pa.int32()), "payload": pa.array(payload, pa.binary())})
