"""What the operators share: tables, shared storage, Arrow batches, key filters and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are ordered: smaller than any other.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All rows of a table; one that is cut into fewer tasks than there are cores is dealt out to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share.

    A session that names none gets a folder of the machine if all of it runs in one process; on a cluster that is an
    error, for executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and return a scan of it.  A lost executor loses nothing of it.

    What a result still reads stays until `clean`; tables that are spent go with `discard`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path  # for `discard`
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables.  Only for those of which everything made is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._written)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has materialized, once its results are written."""
    _delete(spark, shared_folder(spark))


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, th, text): null ids as NULL_ID, null texts as empty.  (id, th) names a row; rows that agree in both are
    the same text under the same id and always fare alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(row_id().alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def slices(batch: pa.RecordBatch, column: str, budget: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `budget` bytes in `column`, one row at least."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def later_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` whose `keys` also occur under a smaller `id`.  The first id of a key is pre-aggregated before the
    shuffle, so that a key in a third of all rows sends one row a task; the join can be split by adaptive execution."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    first = first.where("first_id < last_id").drop("last_id")
    return rows.join(first, keys).where("id > first_id").drop("first_id")


class KeyFilter:
    """A bit array over hashed keys: says no only for keys that aren't in the set.

    It has 64 bits or more for each key, so that one other key in 64 passes at most, up to 2**MOST_BITS bits, which is
    what may be broadcast.  For a set of more than an eighth of that there is no filter: every row may hold a key, and
    the join that follows does the work."""

    LEAST_BITS, MOST_BITS = 23, 30

    def __init__(self, keys: DataFrame, hashed: Column):
        """hashed: a long that is spread evenly, made of the columns of `keys` and of the rows tested later."""
        self.hashed, spark = hashed, keys.sparkSession
        n = max(keys.count(), 1)
        self.bits = int(min(self.MOST_BITS, max(self.LEAST_BITS, np.ceil(np.log2(64 * n)))))
        if 8 * n > 2**self.MOST_BITS:
            self.bits, self.shared = 0, spark.sparkContext.broadcast(np.full(1, 255, np.uint8))
            return
        slot = self._slot()
        parts = (
            keys.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
        )
        found = parts.toLocalIterator()  # 2**bits / 8 bytes
        whole = np.zeros(2**self.bits // 8 + 4096, np.uint8)
        for bucket, bitmap in found:
            at = (bucket - 1) * 4096
            whole[at : at + len(bitmap)] = np.frombuffer(bitmap, np.uint8)
        self.shared = spark.sparkContext.broadcast(whole)

    def _slot(self) -> Column:
        return self.hashed.bitwiseAND(2**self.bits - 1) + 1

    def may_hold(self) -> Column:
        """True for each row whose key may be in the set."""
        if not self.bits:
            return F.lit(True)
        shared, bits = self.shared, self.bits

        @F.pandas_udf("boolean")
        def test(hashed: pd.Series) -> pd.Series:
            return pd.Series(holds(shared.value, bits, hashed.to_numpy()))

        return test(self.hashed)


def holds(bitmap: np.ndarray, bits: int, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashed keys a filter's bitmap may hold."""
    at = hashed.astype(np.int64) & (2**bits - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Edges of which the centres' minima may be broadcast (24 bytes each).
BROADCAST_EDGES = 200_000
#: A centre with more edges than this, and than one in HEAVY_SHARE of all, is heavy; so there are under HEAVY_SHARE.
HEAVY, HEAVY_SHARE = 100_000, 10_000


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (u, v), n of them, with m: the smallest v of their u.

    The minima are pre-aggregated.  They come to the rows by broadcast where the rows are few; else those of heavy
    centres do, of which there are few, and only the rows of the others are shuffled, so that no task gets a centre."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if n <= BROADCAST_EDGES:
        return rows.join(F.broadcast(least.drop("n")), "u")
    limit = max(HEAVY, n // HEAVY_SHARE)
    heavy = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("heavy_m")))
    marked = rows.join(heavy, "u", "left")
    light = marked.where("heavy_m is null").drop("heavy_m").join(least.where(F.col("n") <= limit).drop("n"), "u")
    return light.unionByName(marked.where("heavy_m is not null").withColumnRenamed("heavy_m", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in `edges` (a, b); the component id is the smallest id that can be reached.

    Alternates large and small stars until the edges stay as they are, each round written to the shared folder and
    the one before deleted.  Neighbourhoods are only ever reduced to their minimum (`_with_least`)."""

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def few_files(rows: DataFrame, n: int) -> DataFrame:
        return rows.coalesce(8) if n <= BROADCAST_EDGES else rows

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = materialize(now, "edges")
    mark = state(now)
    for _ in range(most_rounds if mark[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialize(few_files(large.distinct(), mark[0]), "edges")
        small = _with_least(large, mark[0]).select("u", "v", "m")
        # a centre links with its minimum, its other neighbours do too
        linked = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(few_files(linked.distinct(), mark[0]), "edges")
        discard(before, large)
        if (said := state(now)) == mark:
            break
        mark = said
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
