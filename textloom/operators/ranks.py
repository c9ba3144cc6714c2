"""Places in an order without a task that sees all rows: ordinals by ranges, and the k-th row of each group by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stores import kept

#: Values of a hash that one bucket of `kth` holds.
BUCKET = 1024


def ordinals(rows: DataFrame, name: str, *order: Column, first: int = 0) -> DataFrame:
    """`rows` with their place in the order as a long, from `first` on.

    Rows are cut into ranges, which are written so that they stay as they are, and counted; a range begins where the
    counts of those before it end.  Only a number for each range goes to the driver.  Rows that tie in all of `order` are
    in one range: give a column that tells them apart, or their places among each other are any."""
    keys = [f"__by{i}" for i in range(len(order))]
    ranged = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")
    starts, at = [], first
    for r in sorted(ranged.groupBy("__range").count().collect()):  # a row for each range
        starts.append((r["__range"], at))
        at += r["count"]
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "__range int, __begin long"))
    place = F.col("__begin") + F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranged.join(begins, "__range").withColumn(name, place).drop("__range", "__begin", *keys)


def _cut(counts: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    """(group, k, value, left): the value of (group, value, n) in which the k-th of each group lies, and its place there."""
    listed = counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("all"))
    kind = counts.schema["value"].dataType
    start = F.struct(F.col("left").alias("left"), F.lit(None).cast(kind).alias("value"), F.lit(False).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        here = ~acc["found"] & (acc["left"] <= x["n"])
        left = F.when(acc["found"] | here, acc["left"]).otherwise(acc["left"] - x["n"])
        return F.struct(left.alias("left"), F.when(here, x["value"]).otherwise(acc["value"]).alias("value"), (acc["found"] | here).alias("found"))

    found = listed.join(wanted, group).select(group, "k", F.aggregate("all", start, step).alias("cut")).where("cut.found")
    return found.select(group, "k", F.col("cut.value").alias("value"), F.col("cut.left").alias("left"))


def kth(rows: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """(group, k, spread, id): of `rows` (group, spread, id) the k-th of each group of `wanted` (group, k), by spread, then
    id; none where a group has fewer, or for k < 1.

    A group is never in one task: first its buckets of hashes are counted, then the hashes of the bucket in which the
    k-th lies, and only the ids of one hash are listed."""
    wanted = wanted.where("k > 0").distinct().withColumn("left", F.col("k"))
    bucketed = rows.withColumn("bucket", F.floor(F.col("spread") / BUCKET))
    counted = lambda r, value: r.groupBy(group, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    buckets = _cut(counted(bucketed, "bucket"), wanted, group)
    inside = bucketed.join(buckets.select(group, F.col("value").alias("bucket")).distinct(), [group, "bucket"])
    # a bucket that holds two of the wanted is counted once; both go on from the start of their own bucket
    per = counted(inside.withColumn("both", F.struct("bucket", "spread")), "both").select(group, "value.bucket", F.col("value.spread").alias("value"), "n")
    hashes = _within(per, buckets, group, "bucket")
    ids = inside.join(hashes.select(group, F.col("value").alias("spread")).distinct(), [group, "spread"]).select(group, "spread", F.col("id").alias("value"), F.lit(1).cast("long").alias("n"))
    found = _within(ids, hashes, group, "spread", keep=True)
    return found.select(group, "k", "spread", F.col("value").alias("id"))


def _within(counts: DataFrame, cuts: DataFrame, group: str, outer: str, keep: bool = False) -> DataFrame:
    """The next finer cut: `counts` (group, outer, value, n) inside the values of `cuts`."""
    named = cuts.withColumnRenamed("value", outer)
    both = F.struct(group, outer)
    wanted = named.select(both.alias("__group"), "k", "left")
    found = _cut(counts.select(both.alias("__group"), "value", "n"), wanted, "__group")
    return found.select(f"__group.{group}", *([f"__group.{outer}"] if keep else []), "k", "value", "left")
