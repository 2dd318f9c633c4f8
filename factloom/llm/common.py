"""What the text operators share: table access, written intermediate tables, and byte-level views of Arrow text.

Text is handled as one flat array of UTF-8 bytes per piece (a few MB), with the offsets of the documents in it.
Words and windows get 64-bit polynomial hashes from prefix sums, so any run of words is hashed in constant time.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

PIECE_BYTES = 1 << 20
U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for the bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: True for the bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:128] = [chr(i).isdigit() or "a" <= chr(i) <= "z" for i in range(128)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a local one where that is unset and all runs in one JVM (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that more than one in HOT rows have: HOT at most, in whatever table."""
    total = rows.count()
    return written(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT > total).select(key), "hot")


def looked_up(rows: DataFrame, names: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows.join(names, key, how) for names that have a key once, also where one key has a third of the rows.

    What names has for the hot keys is broadcast, HOT rows at most; the rest is joined by shuffle. rows is read several
    times, so it should be a written table.
    """
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)
    few = rows.join(hot, key, "left_anti").join(names, key, how)
    return few.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(names.join(hot, key, "left_semi")), key, how))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches, column: str = "text", most: int = PIECE_BYTES):
    """Cut record batches into pieces of at most `most` bytes of text (a longer document is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another (null: none), and the offsets of the texts in them."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document borders, and each document's offsets into them."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = inside[first]
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


@functools.lru_cache(maxsize=8)
def _powers(base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(most + 1, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(n).bit_length()))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of `size` words that stand in one document, and their hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    fits = np.ones(n, bool)
    for back in range(1, size):
        at = word_offsets[1:] - back
        fits[at[at >= word_offsets[:-1]]] = False
    at = np.flatnonzero(fits)
    return at, span_hashes(hashes, at, at + size, WORD_BASE)
