"""Benchmark decontamination: a hash set of normalised test n-grams, held against every window of the training words.

Words are maximal runs of ASCII letters (lower-cased), ASCII digits and non-ASCII characters. A benchmark item gives
all its windows of `size` words, or itself if it is shorter (an item without words gives none). Window hashes of the
documents are looked up in the set; each hit is verified word by word before it counts.

The set is broadcast only up to about MOST_WINDOWS windows. The windows of a larger benchmark stay a table. What is
broadcast of it is a filter of 2^FILTER_BITS bits; windows of the documents that pass are joined with the table by their
words, so the driver holds no more than the filter. Both ways give the same rows.

Null or empty texts have no words and no hits. Repeated rows are scanned each for itself. Equal windows of several
items count for each item. Extra columns are dropped by `scan` and kept by `remove`, whatever their names, but for
factloom_row and factloom_hit, which are reserved. A very long text is scanned whole, by itself. An empty table of
documents gives no rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c

SIZE = 10
MOST_WINDOWS = 1_000_000
FILTER_BITS = 27
BATCH_ROWS = 50_000


class WindowSet:
    """The windows of some items: hashes sorted for lookup, words for verification, items for the report."""

    def __init__(self, items: Iterable[tuple[str, str]], size: int = SIZE):
        self.size = size
        found: dict[bytes, set[str]] = {}
        for item, text in items:
            data, offsets = c.flat(pa.array([text], pa.string()))
            data = c.LOWER[data]
            starts, ends, _ = c.runs(c.ALNUM[data], offsets)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            for at in range(max(min(len(words), 1), len(words) - size + 1)):
                found.setdefault(b" ".join(words[at : at + size]), set()).add(item)
        self.parts = {}
        by_length: dict[int, list[bytes]] = {}
        for key in found:
            by_length.setdefault(key.count(b" ") + 1, []).append(key)
        for length, keys in by_length.items():
            data, offsets = c.flat(pa.array([k.decode() for k in keys], pa.string()))
            starts, ends, word_offsets = c.runs(c.ALNUM[data], offsets)
            _, hashes = c.windows(c.span_hashes(data, starts, ends), word_offsets, length)
            order = np.argsort(hashes)
            mask = np.zeros(1 << 20, bool)
            mask[hashes >> c.U64(44)] = True
            self.parts[length] = (hashes[order], mask, [keys[i] for i in order], [sorted(found[keys[i]]) for i in order])

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray):
        """Verified hits in lower-cased text: (first word, length, items)."""
        hashes = c.span_hashes(data, starts, ends)
        for length, (keys, mask, words, items) in self.parts.items():
            at, found = c.windows(hashes, word_offsets, length)
            at, found = (x[mask[found >> c.U64(44)]] for x in (at, found)) if len(at) else (at, found)
            place = np.searchsorted(keys, found)
            place[place == len(keys)] = 0
            good = np.flatnonzero(keys[place] == found) if len(found) else []
            for k in good:
                w, p = int(at[k]), int(place[k])
                own = b" ".join([data[a:b].tobytes() for a, b in zip(starts[w : w + length].tolist(), ends[w : w + length].tolist())])
                while p < len(keys) and keys[p] == found[k]:
                    if words[p] == own:
                        yield w, length, items[p]
                        break
                    p += 1


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string")).where("text <> ''")


def window_set(benchmark: DataFrame, size: int = SIZE, most: int = MOST_WINDOWS) -> WindowSet | None:
    """The windows of the benchmark, or None if they may be more than `most`.

    Characters are counted on Spark first: a window begins at a word, which takes two characters with its border.
    """
    rows = _items(benchmark)
    total = rows.agg(F.sum(F.length("text")).cast("long")).first()[0] or 0
    return WindowSet(map(tuple, rows.toLocalIterator()), size) if total <= 2 * most else None


def _words_of(piece, known: WindowSet):
    data, offsets = c.flat(piece.column("text"))
    data = c.LOWER[data]
    starts, ends, word_offsets = c.runs(c.ALNUM[data], offsets)
    hit = np.zeros(len(starts), bool)
    items: dict[int, set] = {}
    border = word_offsets.tolist()
    for w, length, found in known.hits(data, starts, ends, word_offsets):
        hit[w : w + length] = True
        items.setdefault(bisect.bisect_right(border, w) - 1, set()).update(found)
    return starts, ends, word_offsets, hit, items


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int = MOST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    known = window_set(benchmark, size, most)
    if known is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def report(batches):
            for piece in c.pieces(batches):
                _, _, word_offsets, hit, items = _words_of(piece, shared.value)
                n_hit = _per_doc(hit, word_offsets)
                listed = [sorted(items.get(i, ())) for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.diff(word_offsets)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]), pa.array(n_hit > 0),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(report, REPORT)
    rows = c.written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.expr("uuid()").alias(ROW)), "decontaminate")
    windows = window_table(benchmark, size)
    found = candidates(rows, windows)
    every = found.where("words IS NULL").select(ROW, "doc_id", "n_words").join(hit_words(found, windows), ROW, "left").join(hit_items(found, windows), ROW, "left")
    n_hit, n_items = (F.coalesce(F.size(x), F.lit(0)).cast("long") for x in (HIT, "items"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ROW, HIT = "factloom_row", "factloom_hit"


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The words of windows, joined by a space."""
    first, last = starts.tolist(), ends.tolist()
    return pa.array([b" ".join([data[first[w] : last[w]].tobytes() for w in range(k, k + length)]).decode() for k in at.tolist()], pa.string())


def window_table(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, length, hash, words) of every window of the benchmark, once for each item; a written table."""

    def find(batches):
        for piece in c.pieces(batches):
            data, offsets = c.flat(piece.column("text"))
            data = c.LOWER[data]
            starts, ends, word_offsets = c.runs(c.ALNUM[data], offsets)
            hashes = c.span_hashes(data, starts, ends)
            for length in range(1, size + 1):
                at, found = c.windows(hashes, word_offsets, length)
                own = np.searchsorted(word_offsets, at, "right") - 1
                if length < size:
                    whole = np.diff(word_offsets)[own] == length
                    at, found, own = at[whole], found[whole], own[whole]
                for k in range(0, len(at), BATCH_ROWS):
                    part = slice(k, k + BATCH_ROWS)
                    words = _spelled(data, starts, ends, at[part], length)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("item").take(pa.array(own[part])), pa.array(np.full(len(words), length, np.int32)), pa.array(found[part].view(np.int64)), words], ["item", "length", "hash", "words"]
                    )

    return c.written(_items(benchmark).mapInArrow(find, "item string, length int, hash bigint, words string").distinct(), "windows")


def _filter(windows: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of a hash: set if a window has it. Bitmaps of 4096 bytes, built on Spark."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS) + 1
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for number, bits in windows.groupBy(F.bitmap_bucket_number(bit).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit))).toLocalIterator():
        out[(number - 1) * len(bits) : number * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def candidates(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(ROW, doc_id, n_words, at, length, words) of the documents' windows that pass the filter, and one row without words for each document."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # `size` at most
    shared = rows.sparkSession.sparkContext.broadcast(_filter(windows))
    names = [ROW, "doc_id", "n_words", "at", "length", "words"]

    def find(batches):
        bits = shared.value
        for piece in c.pieces(batches):
            data, offsets = c.flat(piece.column("text"))
            data = c.LOWER[data]
            starts, ends, word_offsets = c.runs(c.ALNUM[data], offsets)
            hashes = c.span_hashes(data, starts, ends)
            none = [pa.nulls(piece.num_rows, t) for t in (pa.int64(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([piece.column(ROW), piece.column("doc_id"), pa.array(np.diff(word_offsets)), *none], names)
            for length in lengths:
                at, found = c.windows(hashes, word_offsets, length)
                bit = (found >> c.U64(64 - FILTER_BITS)).astype(np.int64)
                at = at[(bits[bit >> 3] >> (bit & 7)) & 1 == 1]
                for k in range(0, len(at), BATCH_ROWS):
                    part = at[k : k + BATCH_ROWS]
                    own = np.searchsorted(word_offsets, part, "right") - 1
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(ROW).take(pa.array(own)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(part - word_offsets[own]), pa.array(np.full(n, length, np.int32)),
                            _spelled(data, starts, ends, part, length),
                        ],
                        names,
                    )

    return c.written(rows.select("doc_id", "text", ROW).mapInArrow(find, f"{ROW} string, doc_id bigint, n_words bigint, at bigint, length int, words string"), "candidates")


def hit_words(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(ROW, HIT): the places of the words that are hit, for each document with any."""
    places = c.looked_up(found.where("words IS NOT NULL"), windows.select("words").distinct(), "words")
    inside = F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("length") - 1)))
    return places.groupBy(ROW).agg(F.array_distinct(inside).alias(HIT))


def hit_items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(ROW, items): the items with windows in each document that has any. Windows of many documents are salted by document."""
    asked = c.written(found.where("words IS NOT NULL").select(ROW, "words").distinct(), "asked")
    hot = F.broadcast(c.hot_keys(asked, "words"))
    few = asked.join(hot, "words", "left_anti").join(windows, "words").select(ROW, "item")
    n = c.spread(found.sparkSession)
    salted = windows.join(hot, "words", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    many = asked.join(hot, "words", "left_semi").withColumn("salt", F.pmod(F.hash(ROW), F.lit(n))).join(salted, ["words", "salt"]).select(ROW, "item")
    return few.unionByName(many).distinct().groupBy(ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))


def _cut(piece, starts, ends, word_offsets, hit: np.ndarray, drop_share: float):
    """The piece without its hit spans, and without the documents that are mostly hit."""
    texts = piece.column("text").to_pylist()
    _, offsets = c.flat(piece.column("text"))
    keep = np.ones(piece.num_rows, bool)
    for i in np.flatnonzero(_per_doc(hit, word_offsets)).tolist():
        a, b = int(word_offsets[i]), int(word_offsets[i + 1])
        own = hit[a:b]
        if own.sum() > drop_share * (b - a):
            keep[i] = False
            continue
        raw, out, at = texts[i].encode(), [], 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
        for x, y in zip(edge[::2], edge[1::2]):
            out.append(raw[at : int(starts[a + x] - offsets[i])])
            at = int(ends[a + y - 1] - offsets[i])
        texts[i] = b"".join([*out, raw[at:]]).decode()
    k = piece.schema.get_field_index("text")
    return piece.set_column(k, piece.schema.field(k), pa.array(texts, piece.schema.field(k).type)).filter(pa.array(keep))


def remove(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, drop_share: float = 0.5, most: int = MOST_WINDOWS) -> DataFrame:
    """The documents without their hit spans; those with more than `drop_share` of their words hit go altogether.

    A span runs from its first hit word to its last, with the characters between them. All columns stay.
    """
    known = window_set(benchmark, size, most)
    if known is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def cut(batches):
            for piece in c.pieces(batches):
                starts, ends, word_offsets, hit, _ = _words_of(piece, shared.value)
                yield _cut(piece, starts, ends, word_offsets, hit, drop_share)

        return docs.mapInArrow(cut, docs.schema)
    rows = c.written(docs.withColumn(ROW, F.expr("uuid()")), "decontaminate")
    columns = docs.columns
    windows = window_table(benchmark, size)
    found = hit_words(candidates(rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), ROW), windows), windows)

    def cut_known(batches):
        for piece in c.pieces(batches):
            data, offsets = c.flat(piece.column("text"))
            starts, ends, word_offsets = c.runs(c.ALNUM[c.LOWER[data]], offsets)
            hit = np.zeros(len(starts), bool)
            for i, own in enumerate(piece.column(HIT).to_pylist()):
                hit[word_offsets[i] + np.array(own or [], np.int64)] = True
            yield _cut(piece.select(columns), starts, ends, word_offsets, hit, drop_share)

    return rows.join(found, ROW, "left").select(*columns, HIT).mapInArrow(cut_known, docs.schema)
