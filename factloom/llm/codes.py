"""Vector codes: each of the equal parts of a vector becomes the number of the nearest entry of that part's codebook.

Components become integers, floor(SCALE * x), so all sums and distances are exact and don't depend on the order of rows.
A codebook starts as the parts of the ENTRIES smallest vec_ids; each round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by its parts' componentwise floored mean.

Nearest entries are found by segment means. The means of a part's blocks and the norm of what is left of it bound the
distance from below: |x - e|^2 >= sum over blocks of n (mean(x) - mean(e))^2 + (|rest(x)| - |rest(e)|)^2. One block comes
first, then two, four and so on; after each, entries whose bound is above the exact distance of the most promising one go.
The bounds are lowered by more than rounding can add, so no nearest entry goes; what survives gets its exact distance.

Every round is one pass over the table: tasks add up their parts, a group-by adds up tasks, and only codebooks (parts x
ENTRIES x components, whatever the table's size) reach the driver. A label that a third of the rows have is looked up by
broadcast of a thousand rows at most.

Rows go whose vector is null or has a null or non-finite component, or a length that isn't that of the smallest kept
vec_id, or no positive multiple of the number of parts. Components beyond what squared distances hold in 63 bits are held
at that bound (2 ** 27 for 64 components, that is 524288 before scaling). Repeated vec_ids are rows like any others, and
are ordered by their vectors; a null vec_id is larger than any other. Fewer rows than ENTRIES give smaller codebooks;
an empty table gives no rows. Null labels are one label. A sum of errors beyond 63 bits is null. `encoded` keeps all
columns, whatever their names, but for CODE and ERROR, which are reserved; `report` takes vec_id, embedding and label.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c
from factloom.llm.vectors import matrix, whole

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows whose bounds are held at once: ROWS x ENTRIES doubles for a level.
ROWS = 8192
CODE, ERROR = "factloom_code", "factloom_error"


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within what squared distances allow."""
    most = 1 << max(1, (62 - math.ceil(math.log2(max(1, rows.shape[1])))) // 2 - 1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * SCALE), -most, most).astype(np.int64)


def _blocks(size: int) -> list[np.ndarray]:
    """First positions of the blocks, coarse to fine: one block, two, four, down to blocks of two."""
    out, n = [], size
    while n > 1:
        out.append(np.arange(0, size, n))
        n = (n + 1) // 2 if n > 2 else 1
    return out


def _segments(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Block means times the root of the block's length, and in the last column the norm of what is left."""
    lengths = np.diff(np.append(starts, rows.shape[1]))
    means = np.add.reduceat(rows, starts, axis=1) / lengths
    rest = rows - np.repeat(means, lengths, axis=1)
    return np.concatenate([means * np.sqrt(lengths), np.sqrt((rest * rest).sum(axis=1))[:, None]], axis=1)


class Book:
    """The entries of one part, with their segments at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.starts = _blocks(entries.shape[1])
        self.levels = [_segments(entries.astype(np.float64), s) for s in self.starts]
        self.norms = (entries.astype(np.float64) ** 2).sum(axis=1)
        #: Exact distances computed, and all there are.
        self.exact = self.all = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, and its squared distance."""
        n, k = len(parts), len(self.entries)
        self.all += n * k
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.starts:
            row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        else:
            wide = parts.astype(np.float64)
            slack = 1e-12 * ((wide * wide).sum(axis=1)[:, None] + self.norms) + 1e-9
            own = _segments(wide, self.starts[0])
            bound = sum((own[:, j, None] - self.levels[0][:, j]) ** 2 for j in range(own.shape[1])) - slack
            likely = bound.argmin(axis=1)
            least = ((parts - self.entries[likely]) ** 2).sum(axis=1)
            row, entry = np.nonzero(bound <= least[:, None])
            self.exact += n
            for starts, level in zip(self.starts[1:], self.levels[1:]):
                own = _segments(wide, starts)
                finer = ((own[row] - level[entry]) ** 2).sum(axis=1) - slack[row, entry]
                likely = entry[_leasts(row, finer)]
                least = np.minimum(least, ((parts - self.entries[likely]) ** 2).sum(axis=1))
                self.exact += n
                keep = finer <= least[row]
                row, entry = row[keep], entry[keep]
        self.exact += len(row)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = _leasts(row, distance)  # entries ascend within a row
        return entry[first], distance[first]


def _leasts(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the first least value of each row is; row ascends from 0 without gaps."""
    least = np.minimum.reduceat(values, np.flatnonzero(np.append(True, row[1:] != row[:-1])))
    found = np.flatnonzero(values == least[row])
    return found[np.append(True, row[found][1:] != row[found][:-1])]


def _whole_parts(batches: Iterator[pa.RecordBatch], size: int, parts: int):
    """(batch, places of its rows that take part, their parts as integers: rows x parts x components)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            rows, kept = matrix(piece.column("embedding"), size)
            yield piece, kept, integers(rows).reshape(len(rows), parts, size // parts)


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks before the first round: parts x entries x components; no entries for an empty table."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own = own.where(whole("embedding") & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = (F.asc_nulls_last("vec_id"), "embedding")
    first = own.orderBy(*order).limit(1).select(F.size("embedding")).first()
    if first is None:
        return np.zeros((parts, 0, 1), np.int64)
    found = own.where(F.size("embedding") == first[0]).orderBy(*order).limit(entries).collect()  # ENTRIES rows
    seeds = integers(np.array([r.embedding for r in found], np.float64))
    return np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts that are nearest to them; unused ones stay."""
    parts, entries, size = books.shape

    def add(batches):
        kept = [Book(b) for b in books]
        sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for _, _, own in _whole_parts(batches, parts * size, parts):
            for p in range(parts):
                entry, _ = kept[p].nearest(own[:, p])
                counts[p] += np.bincount(entry, minlength=entries)
                for j in range(size):
                    # exact: ROWS summands of 2 ** 30 at most
                    sums[p, :, j] += np.bincount(entry, weights=own[:, p, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(counts)
        columns = {"part": np.repeat(p, size), "entry": np.repeat(e, size), "place": np.tile(np.arange(size), len(p))}
        columns |= {"total": sums[p, e].ravel(), "n": np.repeat(counts[p, e], size)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})

    added = rows.select("embedding").mapInArrow(add, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    out = books.copy()
    for r in added.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many as components
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of all rows (vec_id, embedding): parts x entries x components."""
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows that take part, with CODE (two hex digits a part) and ERROR (squared distances summed over parts)."""
    parts, _, size = books.shape
    schema = rows.select("*", F.lit("").alias(CODE), F.lit(0).cast("long").alias(ERROR)).schema
    if not books.size:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        kept = [Book(b) for b in books]
        for piece, at, own in _whole_parts(batches, parts * size, parts):
            found = [kept[p].nearest(own[:, p]) for p in range(parts)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            taken = piece.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error, pa.int64())], [*taken.schema.names, CODE, ERROR])

    return rows.mapInArrow(run, schema)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = learn(rows)
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    own = c.written(encoded(rows, books).select("vec_id", F.col(CODE).alias("code"), F.col(ERROR).alias("error"), label.alias("label")), "codes")
    summed = own.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return c.looked_up(own, summed, "label").select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
