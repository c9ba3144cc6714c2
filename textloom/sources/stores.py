"""Files that runs leave for one another: part lines, batch files, pruned parts, document lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

PART_SCHEMA = "id string, tokens string, split string, level int, part_name string"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below `spark.checkpoint.dir`; in one process, of the machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to a folder of their own and read from it, for plans that many passes read."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    found._kept = path  # for `spent`
    return found


def spent(rows: DataFrame) -> None:
    """Deletes the files of `kept` rows that nothing reads any more."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(rows._kept)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lookup(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The stored document of each wanted key, once for each time it is asked; keys not stored give none.

    The store is scanned once and never asked row by row; Catalyst picks the side to send."""
    return wanted.select(key).join(store, key)


def write_lines(parts: DataFrame, path: str, gzip: bool = True) -> None:
    """Rows (id, tokens, split, level, part_name) as text lines `id tokens`, a folder for each split, level
    and part; a rerun replaces the folders it writes and no other."""
    lines = parts.select(F.concat_ws(" ", "id", F.coalesce("tokens", F.lit(""))).alias("value"), "split", "level", "part_name")
    out = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "level", "part_name")
    out.option("compression", "gzip" if gzip else "none").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, rest, split, level, part_name) of such folders, compressed or not.  A filter on split, level or
    part reads their folders only."""
    lines = spark.read.schema("value string, split string, level int, part_name string").text(path)
    return archive.token_lines(lines, "split", "level", "part_name")


def full_documents(parts: DataFrame) -> DataFrame:
    """K5: the parts that are whole documents, each once."""
    return parts.where("level = 1")


def write_batches(rows: DataFrame, path: str, key: str, size: int) -> None:
    """Rows by batches of `size` keys, in folders called by the first key of each; keys are numbers."""
    first = (F.floor(F.col(key) / size) * size).cast("long")
    rows.withColumn("batch", first).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def batches_from(spark: SparkSession, path: str, first: int) -> DataFrame:
    """The batches from the number `first` on; earlier folders are not read."""
    return spark.read.parquet(path).where(F.col("batch") >= first)


def data_files(spark: SparkSession, path: str, split: str, level: int) -> DataFrame:
    """The arrays of one split and level; folders of others are not read."""
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("level") == level))


def files_in_order(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """K8: (name, n_bytes, place) of the files below a folder, runs of digits in their names ordered by value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"))
    return natural_order(named, "name")


def natural_order(rows: DataFrame, column: str) -> DataFrame:
    """K8: rows with their `place` from 1 on, in ranges of names."""
    from ..operators.ranks import ordinals

    return ordinals(rows, "place", archive.natural_key(F.col(column)), F.col(column), first=1)
