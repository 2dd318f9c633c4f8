"""Search over chunks for many questions at once: sparse vectors, lists by weight, and an upper bound that ends the search.

For each question the chunks of its brand (or all) are listed by bucket, heaviest first. A question reads the heads of its
buckets' lists and gets the exact products of the chunks that it finds there. A chunk that it hasn't found yet stands
further down in every list, so its product is at most the sum of the question's weights times the next weights of the
lists. Once that is below the last place of the best ones so far, no other chunk can take a place and the question is
done; the others read on, GROW times as far. Words that all chunks share make long lists, of which only heads are read.

Lists are numbered by a scan (`operators.scan`), since one word may be in all chunks. Equal questions are asked once.
Chunks are taken by what questions can see of them, the weights of the buckets that are asked for: those of one scope that
look alike are as near to any question, so only the first of them is listed, and its place is shared out afterwards. Lists
grow with the variety of the chunks, not with their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.vectors import embedded
from factloom.operators.scan import numbered
from factloom.sources.store import written

#: Entries of a list that are read first, and how many times as many are read next.
HEAD, GROW = 64, 4
#: Places to which distances are rounded before they rank.
PLACES = 9
SLACK = 1e-9

#: (rows, key column, text column) -> (key, bucket, weight), of unit norm, weights not negative.
Embedder = Callable[[DataFrame, str, str], DataFrame]


def scope(brand: Column) -> Column:
    """The chunks that a question is about: those of a brand, or all."""
    return F.when(brand.isNull(), "").otherwise(F.concat(F.lit("="), brand))


def alike(vectors: DataFrame, chunks: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(scope, first, chunk_id, seen): the first `limit` chunks of each scope and seen, by chunk_id; `first` is the first of them.

    vectors: chunk_id, bucket, weight; chunks: chunk_id, scopes; asked: scope, bucket. seen: (bucket, weight) of the
    buckets that are asked for, ascending; chunks without any of them aren't among the rows.
    """
    own = vectors.join(asked.select("bucket").distinct(), "bucket", "left_semi")
    seen = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("seen"))
    rows = chunks.join(seen.hint("merge"), "chunk_id").select("chunk_id", "seen", F.explode("scopes").alias("scope"))  # as many rows as chunks
    rows = rows.join(asked.select("scope").distinct(), "scope", "left_semi")
    same = Window.partitionBy("scope", "seen").orderBy("chunk_id")
    rows = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= limit)  # cut before the shuffle too
    return rows.select("scope", F.min("chunk_id").over(Window.partitionBy("scope", "seen")).alias("first"), "chunk_id", "seen")


def postings(listed: DataFrame, asked: DataFrame, head: int = HEAD, grow: int = GROW) -> DataFrame:
    """(scope, bucket, level, chunk_id, weight) of the lists that are asked for (scope, bucket): the brand counts before any product does.

    listed: scope, chunk_id, bucket, weight. level: 0 for the head, 1 for the next stretch, and so on.
    """
    every = listed.select("scope", "bucket", "chunk_id", "weight")
    rows = every.join(asked.select("scope", "bucket").distinct(), ["scope", "bucket"], "left_semi")
    rows = numbered(rows.withColumn("down", -F.col("weight")), ["scope", "bucket"], ["down", "chunk_id"], "n").drop("down")
    level = F.when(F.col("n") <= head, 0).otherwise(F.ceil(F.log(F.col("n") / head) / F.log(F.lit(float(grow))) - 1e-12)).cast("int")
    return rows.select("scope", "bucket", level.alias("level"), "chunk_id", "weight")


def products(pairs: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (question, chunk_id) with their distance, from whole vectors."""
    q = asked.groupBy("question").agg(F.collect_list(F.struct("bucket", "w")).alias("q"))
    c = vectors.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("c"))
    dot = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.w * F.coalesce(F.try_element_at("c", x.bucket), F.lit(0.0)))
    return pairs.join(q, "question").join(c, "chunk_id").select("question", "chunk_id", F.round(1 - dot, PLACES).alias("distance"))


def best(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` chunks of each question by distance, then chunk_id."""
    order = Window.partitionBy("question").orderBy("distance", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def found(lists: DataFrame, asked: DataFrame, vectors: DataFrame, limit: int, told: list | None = None) -> DataFrame:
    """(question, chunk_id, distance): the best of each question (question, scope, bucket, w) among chunks with a bucket in common.

    told: gets the number of products of each round.
    """
    spark = lists.sparkSession
    tops = lists.groupBy("scope", "bucket", "level").agg(F.max("weight").alias("top"))
    last = lists.agg(F.max("level")).first()[0]
    open_, kept = asked, None
    done = []
    for level in range(0 if last is None else last + 1):
        pairs = open_.join(lists.where(F.col("level") == level), ["scope", "bucket"]).select("question", "chunk_id").distinct()
        if kept is not None:
            pairs = pairs.join(kept.select("question", "chunk_id"), ["question", "chunk_id"], "left_anti")
        fresh = written(products(pairs, open_, vectors), "products")
        if told is not None:
            told.append(fresh.count())
        kept = written(best(fresh if kept is None else fresh.unionByName(kept.select(fresh.columns)), limit), "best")
        # a chunk that none of the lists has shown is below this
        next_ = tops.where(F.col("level") == level + 1)
        bound = open_.join(next_, ["scope", "bucket"]).groupBy("question").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
        worst = kept.where(F.col("rank") == limit).select("question", (1 - F.col("distance")).alias("least"))
        more = bound.join(worst, "question", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("question")
        more = written(more, "open")
        done.append(kept.join(more, "question", "left_anti").select("question", "chunk_id", "distance"))
        if not more.limit(1).count():
            break
        open_ = written(open_.join(more, "question", "left_semi"), "asked")
        kept = kept.join(more, "question", "left_semi")
    out = spark.createDataFrame([], "question string, chunk_id string, distance double")
    for x in done:
        out = out.unionByName(x)
    return out


def search(chunk_rows: DataFrame, questions: DataFrame, limit: int = 5, embed: Embedder = embedded, head: int = HEAD, told: list | None = None) -> DataFrame:
    """The `limit` nearest chunks of each question (question_id, text, brand or null): (question_id, chunk_id, distance, rank), exact.

    Chunks that share no bucket with a question have distance 1, so they only fill up places, by chunk_id. Stale chunks
    aren't searched. told: gets the number of products of each round.
    """
    named = questions.select("question_id", "text", scope(F.col("brand")).alias("scope"))
    named = named.withColumn("question", F.sha2(F.concat("scope", F.lit("\x01"), F.coalesce("text", F.lit(""))), 256))
    each = written(named.groupBy("question", "scope").agg(F.first("text").alias("text")), "questions")
    asked = written(embed(each, "question", "text").select("question", "bucket", F.col("weight").alias("w")).join(each.select("question", "scope"), "question"), "asked")
    fresh = chunk_rows.where(~F.coalesce("stale", F.lit(False)))
    scopes = F.when(F.col("brand").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), scope(F.col("brand"))))
    chunks = written(fresh.select("chunk_id", "body", scopes.alias("scopes")), "chunks")
    groups = written(alike(embed(chunks, "chunk_id", "body"), chunks.select("chunk_id", "scopes"), asked, limit), "alike")
    listed = groups.where(F.col("first") == F.col("chunk_id")).select("scope", "chunk_id", F.explode("seen").alias("x")).select("scope", "chunk_id", "x.*")
    lists = written(postings(listed, asked, head), "lists")
    # one vector a chunk, whichever of its scopes it is listed in
    vectors = written(listed.groupBy("chunk_id", "bucket").agg(F.first("weight").alias("weight")), "vectors")
    near = found(lists, asked, vectors, limit, told)
    # the `limit` nearest chunks are among the first ones of the `limit` nearest groups
    members = groups.select("scope", "first", F.col("chunk_id").alias("member"))
    near = near.join(each.select("question", "scope"), "question").withColumnRenamed("chunk_id", "first").join(members, ["scope", "first"])
    near = near.select("question", F.col("member").alias("chunk_id"), "distance")
    # places left over: the first chunks of the scope
    scopes = chunks.select("chunk_id", F.explode("scopes").alias("scope")).join(each.select("scope").distinct(), "scope", "left_semi")
    first = scopes.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("chunk_id"))).where(F.col("_n") <= limit).select("scope", "chunk_id")
    spare = each.join(first, "scope").select("question", "chunk_id", F.lit(1.0).alias("distance"))
    every = best(near.unionByName(spare).groupBy("question", "chunk_id").agg(F.min("distance").alias("distance")), limit)
    return named.select("question_id", "question").join(every, "question").select("question_id", "chunk_id", "distance", "rank")
