"""Streams: new pages as they arrive, and facts kept current key by key. An extension: the batch operators do the work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from factloom.operators.facts import FLAGS, OBSERVED, decide, step
from factloom.schemas import RAW_ARTIFACT
from factloom.sources import buckets

STATE = "row string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts from a folder that fetchers append to."""
    return spark.readStream.schema(RAW_ARTIFACT).parquet(path)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _First(StatefulProcessor):
    """Lets the first row of a key through: of those that come together the earliest fetch, then the least url."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: (r.fetched_at is None, r.fetched_at, r.url or ""))

    def close(self) -> None:
        pass


def once(artifacts: DataFrame) -> DataFrame:
    """Each artifact id once, however late a repeat or a first page comes: nothing is dropped by time.

    What has been seen is one value a raw_artifact_id in the state store, on disk (RocksDB, set here for the session), so
    it grows with the number of distinct artifacts and is kept over restarts by the query's checkpoint.
    """
    artifacts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return artifacts.groupBy("raw_artifact_id").transformWithState(statefulProcessor=_First(), outputStructType=artifacts.schema, outputMode="append", timeMode="none")


def versions(observations: DataFrame, decide_=decide) -> DataFrame:
    """Changes of the fact log: every row whose flags changed, in the order of the changes within a key (`change`).

    The last change of a fact_id is its state. The state of a key is its current row alone. Rows of a key in one batch
    are replayed by `seq`; across batches, arrival decides.
    """
    names = OBSERVED
    schema = observations.select(*names).schema
    for f in FLAGS:
        schema = schema.add(f)
    schema = schema.add("change", "long")

    def replay(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        current, n = pickle.loads(bytes.fromhex(state.get[0])) if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for row in rows[names].itertuples(index=False, name=None):
            new = dict(zip(names, row))
            before = current
            current, done = step(current, new, decide_)
            for x in [*done, *([current] if current is not before else [])]:
                n += 1
                out.append(x | {"change": n})
        state.update((pickle.dumps((current, n)).hex(),))
        yield pd.DataFrame(out, columns=schema.names)

    return observations.select(*names).groupBy("product_id", "attribute_key").applyInPandasWithState(replay, schema, STATE, "append", "NoTimeout")


def upsert(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a fact log at `path` by a stream of changes; `fact_log` reads it. Trigger options as for `writeStream.trigger`.

    A micro-batch replaces the rows of its fact_ids in the buckets that they are in (`sources.buckets`).
    """

    def write(batch: DataFrame, number: int) -> None:
        buckets.replace(last_changes(batch), path, ["fact_id"], number)

    return changes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fact_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The fact log that `upsert` keeps: each fact_id in its last state. schema: that of `last_changes`."""
    return buckets.table(spark, path, schema)


def last_changes(changes: DataFrame) -> DataFrame:
    """The fact log from its changes."""
    rest = [c for c in changes.columns if c not in ("fact_id", "change")]
    return changes.groupBy("fact_id").agg(F.max_by(F.struct(*rest), "change").alias("x")).select("fact_id", "x.*")
