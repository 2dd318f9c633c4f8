"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Paragraphs are lines, cut further where a rolling hash of the last WINDOW bytes says so, every MEAN bytes on average in
any script, so that an edit changes few. The sketch of a document adds each distinct 64-bit paragraph digest to one cell
in each of three thirds: a count, the exclusive or of the digests, and that of their 32-bit check sums.

A fingerprint is the smallest sketch, of CELLS times a power of two, from which peeling recovers all digests of its text;
so it depends on the text alone and is as large as the text needs. Two fingerprints are compared at the size of the
smaller one, to which the larger is folded: their difference, cell by cell, is peeled. If cells remain, both are taken
larger, which is always possible, as each gives back its own digests, until all is recovered. Likeness is the share of
common digests in all (1 if neither has any); `likeness_of` computes it from two fingerprints and nothing else.

Null text is empty text: no digests, a sketch of zeros. Equal texts have equal fingerprints. Neighbours are in order of
descending doc_id; null counts as the greatest, and rows with one doc_id stand in the order of their texts. A document
that is alone is its own neighbour. A very long text is a block of its own with a fingerprint in proportion. An empty
table gives no rows. Only doc_id and text are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import common as c
from factloom.llm.blocks import BLOCK, LAST, blocks

CELLS = 24
GROW = 4
HASHES = 3
MEAN = 128
WINDOW = 12
AT_ONCE = 1 << 19
CHECK = c.U64(0x5851F42D4C957F2D)
CHECK_BITS = c.U64(0xFFFFFFFF)
#: Blocks whose order is told by one window; the driver holds a number for so many of them.
ORDERED = 4096


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of each text, and each text's offsets into them."""
    data, offsets = c.flat(pa.array(texts, pa.string()))
    inside = data != 10
    starts, ends, _ = c.runs(inside, offsets)
    last = np.arange(WINDOW, len(data))  # a cut comes before this byte
    told = (c.span_hashes(data, last - WINDOW, last) & c.U64(MEAN - 1)) == 0
    cut = last[told]
    cut = cut[inside[cut] & inside[cut - 1]]
    text = np.searchsorted(offsets, cut, "right") - 1
    cut = cut[cut - WINDOW >= offsets[text]]  # a text doesn't see the one before it
    starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    own = np.searchsorted(starts, offsets)
    found = c.span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(own))
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


def _check(keys: np.ndarray) -> np.ndarray:
    return c.mixed(keys ^ CHECK) & CHECK_BITS


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each third. A smaller table's cell is a larger one's, modulo the smaller third."""
    third = cells // HASHES
    return np.stack([(c.mixed(keys + c.U64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) & c.U64(third - 1)) + c.U64(j * third) for j in range(HASHES)]).astype(np.int64)


def sketches(keys: np.ndarray, owner: np.ndarray, n: int, cells: int, sign: np.ndarray | None = None):
    """Counts, digests and checks of n sketches, flat; `sign` -1 subtracts a digest."""
    count, key, check = np.zeros(n * cells, np.int32), np.zeros(n * cells, c.U64), np.zeros(n * cells, c.U64)
    own = _check(keys)
    for at in _cells(keys, cells) + owner * cells:
        np.add.at(count, at, np.int32(1) if sign is None else sign)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, own)
    return count, key, check


def peeled(count, key, check, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The digests that are recovered, their sketches and signs, and whether each sketch gave back all. Consumes its tables."""
    found = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        look = look[(np.abs(count[look]) == 1)]
        look = look[_check(key[look]) == check[look]]
        if not len(look):
            break
        pair, own, sign = look // cells, key[look], count[look]
        order = np.lexsort((own, pair))
        pair, own, sign = pair[order], own[order], sign[order]
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])
        pair, own, sign = pair[keep], own[keep], sign[keep]
        found.append((own, pair, sign))
        known = _check(own)
        touched = _cells(own, cells) + pair * cells
        for at in touched:
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key, at, own)
            np.bitwise_xor.at(check, at, known)
        look = c.distinct(touched.ravel())
    rest = (count.reshape(n, cells) != 0).any(axis=1) | (key.reshape(n, cells) != 0).any(axis=1)
    own, pair, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, c.U64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    return own, pair, sign, ~rest


def _taken(found: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, and which of them each belongs to."""
    long = offsets[at + 1] - offsets[at]
    stops = np.cumsum(long)
    return found[np.repeat(offsets[at] - (stops - long), long) + np.arange(int(stops[-1]) if len(stops) else 0)], np.repeat(np.arange(len(at)), long)


def sizes_and_prints(found: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of cells of each text's fingerprint, and the fingerprint: the size, counts, digests and checks in base64."""
    n = np.diff(offsets)
    cells = np.full(len(n), CELLS, np.int64)
    while (small := 4 * cells < 5 * n).any():  # a table of fewer cells gives nothing back
        cells[small] *= 2
    out, open_ = [""] * len(n), np.arange(len(n))
    while len(open_):
        size = int(cells[open_].min())
        now = open_[cells[open_] == size]
        for k in range(0, len(now), max(1, AT_ONCE // size)):
            own = now[k : k + max(1, AT_ONCE // size)]
            count, key, check = sketches(*_taken(found, offsets, own), len(own), size)
            done = peeled(count.copy(), key.copy(), check.copy(), len(own), size)[3]
            raw = np.concatenate([count.astype("<i4").view(np.uint8).reshape(len(own), -1), key.view(np.uint8).reshape(len(own), -1), check.astype("<u4").view(np.uint8).reshape(len(own), -1)], axis=1)
            head = int(size).to_bytes(4, "little")
            for i in np.flatnonzero(done).tolist():
                out[own[i]] = base64.b64encode(head + raw[i].tobytes()).decode()
            cells[own[~done]] *= 2
            open_ = np.setdiff1d(open_, own[done], assume_unique=True)
    return cells, out


def opened(fingerprint: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of a fingerprint."""
    raw = base64.b64decode(fingerprint)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<i4", n, 4).astype(np.int32), np.frombuffer(raw, "<u8", n, 4 + 4 * n).copy(), np.frombuffer(raw, "<u4", n, 4 + 12 * n).astype(c.U64)


def folded(sketch, cells: int):
    """The sketch as one of fewer cells."""
    count, key, check = (x.reshape(HASHES, -1, cells // HASHES) for x in sketch)
    return count.sum(axis=1, dtype=np.int32).ravel(), np.bitwise_xor.reduce(key, axis=1).ravel(), np.bitwise_xor.reduce(check, axis=1).ravel()


def likeness_of(a: str, b: str) -> float:
    """The share of common digests of two fingerprints, from these alone."""
    sides = [opened(x) for x in (a, b)]
    size = min(len(x[0]) for x in sides)
    known = [peeled(*(y.copy() for y in x), 1, len(x[0]))[0] for x in sides]
    if not len(known[0]) + len(known[1]):
        return 1.0
    while True:
        p, q = (folded(x, size) if len(x[0]) >= size else sketches(own, np.zeros(len(own), np.int64), 1, size) for x, own in zip(sides, known))
        _, _, sign, done = peeled(p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2], 1, size)
        if done[0]:
            more, less = int((sign > 0).sum()), int((sign < 0).sum())
            return (len(known[0]) - more) / (len(known[0]) + less)
        size *= GROW


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], pairs: np.ndarray) -> np.ndarray:
    """likeness_of for many pairs (i, j) of a[i] and b[j] at once; a and b: digests, offsets into them, and cells."""
    na, nb = np.diff(a[1])[pairs[:, 0]], np.diff(b[1])[pairs[:, 1]]
    out = np.ones(len(pairs))
    cells = np.minimum(a[2][pairs[:, 0]], b[2][pairs[:, 1]])
    while (small := cells < np.abs(na - nb)).any():  # a table that small can't hold the difference
        cells[small] *= GROW
    open_ = np.flatnonzero(na + nb)
    while len(open_):
        size = int(cells[open_].min())
        now = open_[cells[open_] == size]
        for k in range(0, len(now), max(1, AT_ONCE // size)):
            own = now[k : k + max(1, AT_ONCE // size)]
            (p, p_of), (q, q_of) = (_taken(*side[:2], pairs[own, column]) for side, column in ((a, 0), (b, 1)))
            sign = np.repeat(np.array([1, -1], np.int32), [len(p), len(q)])
            _, pair, sign, done = peeled(*sketches(np.append(p, q), np.append(p_of, q_of), len(own), size, sign), len(own), size)
            more, less = np.bincount(pair[sign > 0], minlength=len(own)), np.bincount(pair[sign < 0], minlength=len(own))
            out[own[done]] = ((na[own] - more) / np.maximum(1, na[own] + less))[done]
            cells[own[done]] = 0
            cells[own[~done]] *= GROW
        open_ = open_[cells[open_] > 0]
    return out


def _edited(own: str, following: str) -> str:
    k = len(own) // 3
    return own[: len(own) - k] + following[:k]


def _printed(texts: list[str]) -> tuple[tuple[np.ndarray, ...], list[str]]:
    found, offsets = digests(texts)
    cells, prints = sizes_and_prints(found, offsets)
    return (found, offsets, cells), prints


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likenesses to that and to the next document.

    Documents are dealt by ranges of doc_id. The greatest document of a block also goes to the block above, as the
    neighbour of the least one there; the greatest of all goes to the lowest block.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt, _ = blocks(docs)
    key = F.coalesce("doc_id", F.lit(LAST))
    tops = c.written(dealt.groupBy(BLOCK).agg(F.max(key).alias("top")).withColumn("some", F.floor(F.col(BLOCK) / ORDERED)), "tops")
    firsts = sorted(map(tuple, tops.groupBy("some").agg(F.min(BLOCK)).collect()))
    spark = docs.sparkSession
    after = spark.createDataFrame([(some, firsts[(k + 1) % len(firsts)][1]) for k, (some, _) in enumerate(firsts)], "some bigint, next int")
    above = F.coalesce(F.lead(BLOCK).over(Window.partitionBy("some").orderBy(BLOCK)), "next")
    # a written table has a known size: Spark broadcasts it while it is small, and shuffles the texts once more beyond
    ups = c.written(tops.join(after, "some").select(BLOCK, "top", above.alias("above")), "ups")
    here = F.struct(F.col(BLOCK).alias("b"), F.lit(False).alias("tail"))
    there = F.struct(F.col("above").alias("b"), F.lit(True).alias("tail"))
    both = dealt.join(ups, BLOCK).select("doc_id", "text", F.explode(F.when(key == F.col("top"), F.array(here, there)).otherwise(F.array(here))).alias("x"))
    both = both.select(F.col("x.b").alias(BLOCK), "x.tail", "doc_id", "text").repartition(c.spread(spark), BLOCK)

    def sketch(rows):
        ids = rows.column("doc_id").to_pylist()
        texts = [x or "" for x in rows.column("text").to_pylist()]
        tail = rows.column("tail").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (tail[i], -(LAST if ids[i] is None else ids[i]), texts[i]))
        n = len(ids) - sum(tail)
        order = order[: n + 1]
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        out = []
        for k in range(0, n, 500):
            m = min(n, k + 500) - k
            own = texts[k : k + m + 1]
            edited = [_edited(x, y) for x, y in zip(own, own[1:])]
            (a, a_prints), (b, b_prints) = _printed(own), _printed(edited)
            to = np.arange(m)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids[k : k + m], pa.int64()), "n_chars": pa.array([len(x) for x in own[:m]], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                        "fingerprint": pa.array(a_prints[:m], pa.string()), "edited_fingerprint": pa.array(b_prints, pa.string()),
                        "near_edited": pa.array(likeness(a, b, np.stack([to, to], axis=1))), "near_next": pa.array(likeness(a, a, np.stack([to, to + 1], axis=1))),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in EMPTY})

    return both.groupBy(BLOCK).applyInArrow(sketch, SCHEMA)


EMPTY = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
