"""Landing folders as streams: keyed upsert of what arrives, each trigger exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.archive import latest


def landing(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert(stream: DataFrame, target: str, key: str, order: list[str], checkpoint: str):
    """Start a query that keeps the latest row of each key below `target`: every trigger writes a new version beside
    the old one, and the name of the version tells its batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            before = batch.sparkSession.read.parquet(f"{target}/version={number - 1}")
            rows = rows.unionByName(before.select(*batch.columns))
        latest(rows, key, *order).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest version."""
    versions = spark.read.parquet(target)
    newest = versions.agg({"version": "max"}).first()[0]
    return versions.where(versions.version == newest).drop("version")
