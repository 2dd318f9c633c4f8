"""Hashed term vectors, kept sparse, and cosine distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIZE = 1024


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bucket(token: Column, size: int = SIZE) -> Column:
    return F.conv(F.substring(F.sha1(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % size


def hashed_counts(df: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(key, bucket, n): how often the tokens of a bucket occur."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("token"))
    return words.groupBy(key, bucket(F.col("token"), size).alias("bucket")).agg(F.count("*").alias("n"))


def embedded(df: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(key, bucket, weight): counts over their Euclidean norm. A text without ASCII tokens has no rows: a zero vector.

    Texts are dealt by key before they are taken apart, so nothing is shuffled after it. A null key has no vector.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = hashed_counts(df.select(key, text).where(F.col(key).isNotNull()).repartition(parts, key), key, text, size)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
