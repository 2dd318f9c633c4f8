"""The fact log: versions, conflicts between sources, and the current view.

Observations are appended; which of a key's rows is effective, disputed or superseded follows from replaying them in the
order of `seq`. Only the current row of a key can still change, so the replay keeps one row for each key, whatever the
length of its history: rows are dealt by key, sorted, and streamed. A key's history is one sequence and so one task, in
constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.operators.scan import last_known

# Authority of sources, 0 the highest; any other kind ranks 5.
AUTHORITY = {"feed": 0, "api": 0, "json_ld": 1, "cms_adapter": 2, "dom": 3, "llm_text": 4, "llm_vision": 4}
LOWEST = 5

OBSERVED = ["product_id", "attribute_key", "seq", "fact_id", "value_num", "value_text", "canonical_unit", "source_type", "source_url", "source_span", "fetched_at", "confidence"]
FLAGS = [T.StructField("effective", T.BooleanType()), T.StructField("disputed", T.BooleanType()), T.StructField("superseded_by", T.StringType())]


def _value(r: dict) -> tuple:
    return tuple(None if x is None or x != x else x for x in (r["value_num"], r["value_text"], r["canonical_unit"]))


def decide(current: dict, new: dict) -> tuple[bool, bool, bool]:
    """(does the new fact become effective, is it disputed, does it supersede). A page supersedes itself; else authority, freshness, confidence."""
    if current["source_url"] == new["source_url"]:
        return True, False, True
    a, b = (AUTHORITY.get(r["source_type"], LOWEST) for r in (current, new))
    if a != b:
        return b < a, False, False
    wins = new["fetched_at"] > current["fetched_at"] if new["fetched_at"] != current["fetched_at"] else new["confidence"] >= current["confidence"]
    return wins, _value(current) != _value(new), False


Decide = Callable[[dict, dict], tuple[bool, bool, bool]]


def step(current: dict | None, new: dict, decide_: Decide = decide) -> tuple[dict, list[dict]]:
    """The current row after `new`, and the rows that can't change any more. An unchanged repeat leaves nothing."""
    if current is None:
        return new | {"effective": True, "disputed": False, "superseded_by": None}, []
    if _value(current) == _value(new) and current["source_url"] == new["source_url"] and current["source_span"] == new["source_span"]:
        return current, []
    wins, disputed, supersedes = decide_(current, new)
    new = new | {"effective": wins, "disputed": disputed, "superseded_by": None}
    if supersedes:
        return new, [current | {"effective": False, "superseded_by": new["fact_id"]}]
    current = current | {"effective": not wins, "disputed": disputed}
    return (new, [current]) if wins else (current, [new])


def versions(observations: DataFrame, decide_: Decide = decide) -> DataFrame:
    """All versions of all facts, with effective, disputed and superseded_by. observations: OBSERVED and any further columns."""
    schema = T.StructType([*observations.schema.fields, *FLAGS])
    names = observations.columns

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                new = dict(zip(names, row))
                own = (new["product_id"], new["attribute_key"])
                if own != key:
                    if current is not None:
                        out.append(current)
                    key, current = own, None
                current, done = step(current, new, decide_)
                out += done
            yield pd.DataFrame(out, columns=schema.names)
        if current is not None:
            yield pd.DataFrame([current], columns=schema.names)

    keys = ["product_id", "attribute_key"]
    return observations.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(replay, schema)


def is_current() -> Column:
    return F.col("effective") & F.col("superseded_by").isNull()


def current(all_versions: DataFrame) -> DataFrame:
    return all_versions.where(is_current())


def disputed(all_versions: DataFrame) -> DataFrame:
    return all_versions.where("disputed")


def as_of(all_versions: DataFrame, at: Column) -> DataFrame:
    """The rows valid at a time: begun by then, and not superseded by a row begun by then. An extension."""
    later = all_versions.select(F.col("fact_id").alias("superseded_by"), F.col("valid_from").alias("valid_to"))
    spans = all_versions.join(later, "superseded_by", "left")
    return spans.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def as_of_join(
    questions: DataFrame, all_versions: DataFrame, keys: list[str], at: str = "at", since: str = "valid_from", order: str = "seq", until: str | None = None,
) -> DataFrame:
    """questions with `version`: the last of all_versions that had begun at each question's own time, as a struct.

    Of versions that begin at once the last by `order` counts. Null if none had begun, or if that one had ended (`until`)
    by then. Questions and versions are sorted together by (keys, time), and the last version is carried forward
    (`operators.scan`), so a key with a long history, or with most of the questions, is many tasks.
    """
    own = [F.col(k) for k in keys]
    version = F.struct(*all_versions.columns)
    asked = F.struct(*questions.columns)
    rows = all_versions.select(*own, F.col(since).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.col(order).alias("_order"), version.alias("_version"))
    rows = rows.unionByName(questions.select(*own, F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), asked.alias("_asked")), allowMissingColumns=True)
    rows = rows.where(F.col("_at").isNotNull() | F.col("_asked").isNotNull())
    found = last_known(rows, keys, ["_at", "_kind", "_order"], "_version", "version").where(F.col("_asked").isNotNull())
    valid = F.col("_at").isNotNull()
    if until is not None:
        valid &= F.col(f"version.{until}").isNull() | (F.col(f"version.{until}") > F.col("_at"))
    return found.select("_asked.*", F.when(valid, F.col("version")).alias("version"))


def product_facts(facts: DataFrame, product_id: str) -> DataFrame:
    return facts.where(F.col("product_id") == product_id).orderBy("attribute_key")


def product_fact(facts: DataFrame, product_id: str, attribute_key: str) -> DataFrame:
    """The current fact, or no row if it is unknown."""
    return facts.where((F.col("product_id") == product_id) & (F.col("attribute_key") == attribute_key))


def fact_rows(facts: DataFrame) -> DataFrame:
    """What the interface shows of a fact: its value and where it comes from."""
    return facts.select(
        "product_id", "attribute_key", "value_num", "value_text", "canonical_unit", "original_value", "disputed", "confidence",
        "provenance.source_type", "provenance.source_url", "provenance.source_span", "provenance.fetched_at",
    )


def write_current(facts: DataFrame, path: str) -> None:
    """The current view as Parquet, a folder for each attribute: filters and comparisons read only theirs."""
    current(facts).write.mode("overwrite").partitionBy("attribute_key").parquet(path)
