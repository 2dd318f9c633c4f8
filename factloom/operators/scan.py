"""Running values along long sequences: parallel prefix scans, for keys that may hold most of a table.

A window over a key puts all of its rows into one task. Here rows are dealt by ranges of (key, order), so that a long
sequence is many ranges. Running values are windows within a range, and what a range needs from those before it, its
carry, comes from one row a range: only keys that stand in several ranges have carries, and there are fewer such keys
than ranges, so carries are at most twice as many as ranges and are broadcast.

    rows = dealt(table, ["domain"], ["at", "id"])          # written, with the range of each row
    sums = totals(rows, ["domain"], n=F.count("*"))        # of the keys that several ranges have
    carry = sums.select(..., F.sum("n").over(before(["domain"])))
    carried(rows.withColumn(..., over(within(...))), carry, ["domain"])

Null keys are one key. Rows that are equal in key and order stay in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from factloom.sources.store import written

RANGE = "factloom_range"


def dealt(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with RANGE, written: ranges ascend with (keys, order), nulls first."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def within(keys: list[str], order: list) -> WindowSpec:
    """The rows of a key in one range up to the current one."""
    return Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys: list[str]) -> WindowSpec:
    """The ranges of a key before the current one, among `totals`."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b["_" + k]) for k in keys))


def _renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: "_" + k for k in keys})


def totals(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """(keys, RANGE, values) of the keys that stand in several ranges: aggregates of each of their ranges."""
    split = rows.groupBy(*keys).agg(F.min(RANGE).alias("a"), F.max(RANGE).alias("b")).where("a < b").select(*keys)
    split = F.broadcast(_renamed(split, keys))
    return rows.join(split, _same(rows, split, keys), "left_semi").groupBy(*keys, RANGE).agg(*(v.alias(k) for k, v in values.items()))


def carried(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of carry (keys, RANGE, values) beside them; null for a key's first range."""
    at = [*keys, RANGE]
    carry = F.broadcast(_renamed(carry, at))
    return rows.join(carry, _same(rows, carry, at), "left").drop(*("_" + k for k in at))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number in their key's order, from 1."""
    own = dealt(rows, keys, order)
    carry = totals(own, keys, n=F.count("*")).select(*keys, RANGE, F.sum("n").over(before(keys)).alias("_n"))
    local = own.withColumn(name, F.row_number().over(within(keys, order)).cast("long"))
    return carried(local, carry, keys).withColumn(name, F.col(name) + F.coalesce("_n", F.lit(0))).drop("_n", RANGE)


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value in their key's order that isn't null, their own included."""
    own = dealt(rows, keys, order)
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = totals(own, keys, _last=latest).select(*keys, RANGE, F.last("_last", ignorenulls=True).over(before(keys)).alias("_before"))
    local = own.withColumn(name, F.last(value, ignorenulls=True).over(within(keys, order)))
    return carried(local, carry, keys).withColumn(name, F.coalesce(name, "_before")).drop("_before", RANGE)
