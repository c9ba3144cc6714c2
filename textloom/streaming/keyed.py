"""Keyed upsert with state: the last row of each key lives in the state store, and only changes are written.

    query = upsert(landing(spark, folder, schema), "user_id", ["ts", "event_id"], target, checkpoint)
    query.awaitTermination()
    current(spark, checkpoint, schema)  # the row of each key as it stands
    changes(spark, target)              # what the last triggers changed

A trigger costs what it brings: keys that it does not mention are neither read nor written.  Rows that come late, or
again, lose against what the state holds.  What is replaced is gone; change files go after `keep` triggers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last"


class Latest(StatefulProcessor):
    """Keeps the row of each key that is last by `order`, and gives it whenever it changes.  Nulls come first in the
    order; of rows that tie the one that came first stays."""

    def __init__(self, schema: T.StructType, order: list[str]):
        self.schema, self.at = schema, [schema.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(STATE, self.schema)

    def _place(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        best = None
        for row in rows:
            if best is None or self._place(row) > self._place(best):
                best = tuple(row)
        held = self.last.get() if self.last.exists() else None
        if held is None or self._place(best) > self._place(held):
            self.last.update(best)
            yield Row(*self.schema.names)(*best)

    def close(self) -> None:
        pass


def newest(key: str, order: list[str]):
    """Of each batch of a task the last row of each key, so that a key of a third of all rows is a few before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # equal places in reverse, so that the last one of a key is the one that came first
            table = pa.table({"__row": pa.array(np.arange(batch.num_rows)[::-1].copy()), **{f"o{i}": batch.column(c) for i, c in enumerate(order)}, "__key": batch.column(key).dictionary_encode(null_encoding="encode").indices})
            sort = [(name, "ascending") for name in ("__key", *[f"o{i}" for i in range(len(order))], "__row")]
            at = pc.sort_indices(table, sort_keys=sort, null_placement="at_start").to_numpy()
            keys = table["__key"].to_numpy()[at]
            yield batch.take(pa.array(np.sort(at[np.append(keys[1:] != keys[:-1], True)])))

    return run


def _packed(rows: DataFrame) -> DataFrame:
    """Points in time as microseconds: Python, which has several notions of them, only compares numbers."""
    return rows.select(*[F.unix_micros(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == T.TimestampType() else F.col(f"`{f.name}`") for f in rows.schema])


def _unpacked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.timestamp_micros(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == T.TimestampType() else F.col(f"`{f.name}`") for f in schema])


def latest_changes(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The stream of rows that become the last of their `key` by `order`; to be written in update mode."""
    packed = _packed(stream)
    few = packed.mapInArrow(newest(key, order), packed.schema)
    last = few.groupBy(key).transformWithState(statefulProcessor=Latest(packed.schema, order), outputStructType=packed.schema, outputMode="update", timeMode="none")
    return _unpacked(last, stream.schema)


def upsert(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str, keep: int = 10) -> StreamingQuery:
    """Start a query that takes in what has landed.  Changes go to a folder for each trigger below `target`, which a
    repeated trigger replaces; folders of more than `keep` triggers ago are deleted."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings it starts with
    try:

        def write(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{target}/trigger={number}")
            _delete(rows.sparkSession, f"{target}/trigger={number - keep}")

        out = latest_changes(stream, key, order).writeStream.foreachBatch(write).outputMode("update")
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The rows as the state holds them, one for each key; `schema` is that of the stream."""
    return _unpacked(spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint).select("value.*"), schema)


def changes(spark: SparkSession, target: str) -> DataFrame:
    """What the last triggers changed, with the number of each `trigger`."""
    return spark.read.parquet(target).withColumn("trigger", F.col("trigger").cast("long"))
