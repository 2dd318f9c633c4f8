"""Chunks of product facts, and search over them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from factloom.functions.text import entity_id
from factloom.functions.vectors import cosine_distance, tokens
from factloom.operators.query import value_text
from factloom.sources import buckets
from factloom.sources.store import written


def chunks(products: DataFrame, facts: DataFrame) -> DataFrame:
    """One chunk for each product with facts: a header, a line a fact by attribute, and the latest source.

    facts: product_id, attribute_key, value_num, value_text, canonical_unit, source_url, fetched_at. Of equally late
    facts the first by attribute names the source.
    """
    unit = F.when(F.col("canonical_unit") != "", F.concat(F.lit(" "), "canonical_unit")).otherwise("")
    line = F.concat(F.replace("attribute_key", F.lit("_"), F.lit(" ")), F.lit(": "), value_text(), unit, F.lit("."))
    lines = facts.select("product_id", "attribute_key", line.alias("line"), "source_url", "fetched_at")
    order = F.struct(F.col("fetched_at").isNull(), -F.unix_micros("fetched_at"), "attribute_key")
    body = lines.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("attribute_key", "line"))).alias("l"), F.sort_array(F.collect_set("attribute_key")).alias("attribute_keys"),
        F.min_by(F.struct("source_url", "fetched_at"), order).alias("latest"),
    )
    rows = products.join(body.hint("merge"), "product_id")  # facts may be many more than their estimated size says
    head = F.concat(
        F.lit("[Brand: "), F.coalesce("brand", F.lit("None")), F.lit("] [Model: "), F.coalesce("model", F.lit("None")), F.lit("] [Category: "),
        F.array_join("category_path", "/"), F.lit("]"),
    )
    tail = F.concat(F.lit("Source: "), "latest.source_url", F.lit(", as of "), F.date_format("latest.fetched_at", "yyyy-MM-dd"), F.lit("."))
    text = F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x.line), "\n"), tail)
    return rows.select(
        entity_id("chk", F.col("product_id"), F.lit("fact")).alias("chunk_id"), "product_id", F.lit("fact").alias("kind"), text.alias("body"), "attribute_keys", "brand", "category_path",
        "latest.source_url", "latest.fetched_at", F.lit(False).alias("stale"),
    )


def replace_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table with those of (product_id, kind) in `new` replaced."""
    return stored.join(new.select("product_id", "kind").distinct(), ["product_id", "kind"], "left_anti").unionByName(new, allowMissingColumns=True)


def store_chunks(new: DataFrame, path: str, batch: int) -> None:
    """Replace the chunks of (product_id, kind) in `new` in the table at `path`; only the buckets of those keys are rewritten."""
    buckets.replace(new, path, ["product_id", "kind"], batch)


def eligible(rows: DataFrame, brand: str | None = None, category: str | None = None) -> DataFrame:
    rows = rows.where(~F.coalesce("stale", F.lit(False)))
    if brand is not None:
        rows = rows.where(F.col("brand") == brand)
    if category is not None:
        rows = rows.where(F.array_contains("category_path", category))
    return rows


def nearest(rows: DataFrame, query: list[float], key: str = "chunk_id", vector: str = "embedding", limit: int = 5) -> DataFrame:
    """The nearest rows by cosine distance, exact; rows without a distance come last, ties by key."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", cosine_distance(F.col(vector), asked)).orderBy(F.asc_nulls_last("distance"), key).limit(limit)


#: Bytes of question vectors that are broadcast at once, and of products that a task holds.
ASKED_BYTES, PRODUCT_BYTES = 32 << 20, 16 << 20


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of a list column as rows; NaN where there is no direction (null, zero, another length, a part that isn't a finite number)."""
    out = np.full((len(column), size), np.nan)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    if size and len(at):
        out[at] = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    with np.errstate(all="ignore"):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(np.isfinite(out).all(axis=1, keepdims=True), out, np.nan)


class _Best:
    """The `limit` nearest keys of each question so far; equal distances by key. No distance is farther than any."""

    def __init__(self, asked: np.ndarray, limit: int):
        self.asked, self.limit = asked, limit
        self.question, self.key, self.distance = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self.worst = np.full(len(asked), np.inf)

    def add(self, keys: np.ndarray, own: np.ndarray) -> None:
        distance = np.round(1 - own @ self.asked.T, 12)
        distance[np.isnan(distance)] = np.inf
        worst = self.worst
        if len(keys) > self.limit:  # of these rows alone no more than their nearest, ties included
            worst = np.minimum(worst, np.partition(distance, self.limit - 1, axis=0)[self.limit - 1])
        some, question = np.nonzero((distance <= worst) & np.isfinite(distance))
        # without a distance, only the first keys can count, and only where places are left
        first, open_ = np.argsort(keys, kind="stable")[: self.limit], np.flatnonzero(np.isinf(self.worst))
        far, asker = np.nonzero(np.isinf(distance[np.ix_(first, open_)]))
        some, question = np.append(some, first[far]), np.append(question, open_[asker])
        if not len(some):
            return
        key = np.concatenate([self.key, keys[some]])
        distance = np.concatenate([self.distance, distance[some, question]])
        question = np.concatenate([self.question, question])
        order = np.lexsort((np.unique(key, return_inverse=True)[1], distance, question))
        question = question[order]
        rank = np.arange(len(question)) - np.searchsorted(question, question)
        kept = order[rank < self.limit]
        self.question, self.key, self.distance = question[rank < self.limit], key[kept], distance[kept]
        last = rank == self.limit - 1
        self.worst[question[last]] = distance[order[last]]


def nearest_join(rows: DataFrame, questions: DataFrame, key: str = "chunk_id", question: str = "question_id", vector: str = "embedding", limit: int = 5) -> DataFrame:
    """(question, key, distance, rank): the `limit` nearest rows of each question by cosine distance, exact.

    Questions are taken in blocks of ASKED_BYTES, each broadcast and multiplied with the rows batch by batch; a task keeps
    its `limit` nearest of each question, and the tasks' lists are merged by question. So what is shuffled is lists of
    `limit`, never pairs, and however many questions there are, a task holds one block. Distances are rounded to twelve
    places before they rank. Rows and questions without a direction (null, zero, a part that isn't a finite number,
    another length than the longest question) have no distance and come last, by key. Rows without a key are left out.
    """
    spark = rows.sparkSession
    asked = questions.select(F.col(question).alias("question"), F.col(vector).alias("embedding"))
    n, size = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    size = max(0, size or 0)
    blocks = -(-n * 8 * max(1, size) // ASKED_BYTES)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("question", "embedding"), F.lit(max(1, blocks))))
    if blocks > 1:
        asked = written(asked, "asked")
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("embedding"))
    fields = [
        T.StructField("question", questions.schema[question].dataType), T.StructField("asked", T.StringType()), T.StructField("key", rows.schema[key].dataType),
        T.StructField("distance", T.DoubleType()),
    ]
    schema = T.StructType(fields)

    def searched(block: int) -> DataFrame:
        some = asked.where(F.col("block") == block).toArrow()  # ASKED_BYTES, give or take
        shared = spark.sparkContext.broadcast((some.column("question").to_pylist(), _vectors(some.column("embedding").combine_chunks(), size)))

        def run(batches):
            names, vectors = shared.value
            best = [_Best(vectors[at : at + 1024], limit) for at in range(0, len(vectors), 1024)]
            step = max(1, PRODUCT_BYTES // (8 * 1024))
            kind = None
            for batch in batches:
                kind = batch.schema.field("key").type
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    keys, found = np.array(piece.column("key").to_pylist(), object), _vectors(piece.column("embedding"), size)
                    for x in best:
                        x.add(keys, found)
            for i, x in enumerate(best):
                at = x.question + i * 1024
                told = pa.array(np.where(np.isinf(x.distance), np.nan, x.distance), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in at], asked_type), pa.array([f"{block} {k}" for k in at], pa.string()), pa.array(x.key.tolist(), kind), told],
                    ["question", "asked", "key", "distance"],
                )

        asked_type = some.schema.field("question").type
        return own.mapInArrow(run, schema)

    found = reduce(DataFrame.union, map(searched, range(blocks)), spark.createDataFrame([], schema))
    order = Window.partitionBy("asked").orderBy(F.asc_nulls_last("distance"), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(F.col("question").alias(question), F.col("key").alias(key), "distance", "rank")


#: Terms of all questions that are broadcast at most; more meet the words of chunks in a sorted join.
TERMS = 1 << 17


def seen_words(chunk_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, rows, size, seen) of each chunk: its rows, its words, and (term, tf) of those words that are among `terms` (term), ascending.

    Chunks are dealt by chunk_id before they are taken apart; words that nobody asks for are only counted.
    """
    parts = int(chunk_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = chunk_rows.select("chunk_id", "body").repartition(parts, "chunk_id")
    words = texts.select("chunk_id", F.posexplode_outer(tokens(F.col("body"))).alias("at", "word"))
    first = F.coalesce("at", F.lit(0)) == 0  # one a row of chunks, with words or without
    tf = words.join(terms, words["word"] == terms["term"], "left").groupBy("chunk_id", "term").agg(F.count("word").alias("tf"), F.count_if(first).alias("rows"))
    seen = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))
    return tf.groupBy("chunk_id").agg(F.sum("rows").alias("rows"), F.sum("tf").alias("size"), seen.alias("seen"))


def bm25(chunk_rows: DataFrame, questions: DataFrame, k1: float = 1.2, b: float = 0.75, limit: int = 5, broadcast_terms: int = TERMS) -> DataFrame:
    """Keyword search by BM25: (question_id, chunk_id, score, rank). An extension.

    Scores are rounded to nine places before they rank, so that equal ones tie in whatever order their parts were summed.
    Chunks of one size that have the asked words equally often score alike in any question, so a question gets one score
    for all of them, and of each such group only the first `limit` by chunk_id can take a place. The `limit` best chunks
    are among the `limit` best groups.
    """
    asked = written(questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "asked")
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= broadcast_terms else terms.hint("merge")
    own = written(seen_words(chunk_rows, terms), "seen")
    n, mean = own.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.avg(F.when(F.col("size") > 0, F.col("size")))).first()
    mean = mean or 1.0
    found = own.where(F.size("seen") > 0)
    df = found.select(F.explode("seen.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    same = Window.partitionBy("size", "seen").orderBy("chunk_id")
    some = found.where(F.col("chunk_id").isNotNull()).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= limit)  # cut before the shuffle too
    groups = some.groupBy("size", "seen").agg(F.array_sort(F.collect_list("chunk_id")).alias("members"))
    groups = written(groups.select(F.col("members")[0].alias("first"), "size", "seen", "members"), "groups")
    tf = groups.select("first", "size", F.explode("seen").alias("x")).select("first", "size", "x.*")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
    scores = asked.join(df.hint("merge"), "term").join(tf.hint("merge"), "term").groupBy("question_id", "first").agg(F.round(F.sum(part), 9).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "first")
    best = scores.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    rows = best.join(groups.select("first", F.explode("members").alias("chunk_id")).hint("merge"), "first").select("question_id", "chunk_id", "score")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
