"""Document collections: pages, key ranges, and what a filter on the key opens."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith

from textloom.sources import collection as C


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('store')}/c"
    rows = spark.range(1000).select((F.col("id") * 3).alias("k"), F.concat(F.lit('é"\n\\ '), F.col("id")).alias("t"), F.array(F.col("id")).alias("l"))
    C.write_collection(rows, folder, "k", pageRows=20, fileBytes=6000)
    return folder


def data_files(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".jsonl") and f[0] != "_")


def test_scan(spark, stored):
    rows = C.read_collection(spark, stored).select("key", F.from_json("document", "k long, t string, l array<long>").alias("v")).collect()
    assert sorted((r["key"], r["v"]["k"], r["v"]["t"], r["v"]["l"][0]) for r in rows) == [(3 * i, 3 * i, f'é"\n\\ {i}', i) for i in range(1000)]
    assert len(data_files(stored)) > 5 and not [f for f in os.listdir(stored) if f.startswith("_") and "-_pages" in f]
    assert spark.read.json([f"{stored}/{f}" for f in data_files(stored)]).count() == 1000  # lines that anyone can read


def test_filter_reads_its_ranges_only(spark, stored, tmp_path):
    """Files outside the range are gone and pages outside it are overwritten: nobody has looked at them."""
    import shutil

    folder = f"{tmp_path}/copy"
    shutil.copytree(stored, folder)
    low, high = 900, 1000
    reader = C.CollectionReader({"path": folder})
    assert list(reader.pushFilters([IsNotNull(("key",)), GreaterThanOrEqual(("key",), low), LessThan(("key",), high)])) == []
    chosen = {p.path for p in reader.partitions()}
    everything = {f"{folder}/{f}" for f in data_files(folder)}
    assert 0 < len(chosen) < len(everything) / 2
    for path in everything - chosen:
        os.remove(path)
        os.remove(C._index(path))
    spoiled = 0
    for path in chosen:
        with open(C._index(path)) as f:
            pages = json.load(f)
        with open(path, "r+b") as f:
            for first, last, at, size in pages:
                if last < low or first >= high:
                    f.seek(at)
                    f.write(b"\xff" * size)
                    spoiled += 1
    assert spoiled
    found = C.read_collection(spark, folder).where(f"key >= {low} and key < {high}")
    assert sorted(r["key"] for r in found.collect()) == [k for k in range(0, 3000, 3) if low <= k < high]
    assert found.rdd.getNumPartitions() == len(chosen)


@pytest.mark.parametrize(
    "where",
    ["key = 300", "key in (3, 4, 2997)", "key > 2900", "key <= 9 and key > 3", "key <=> 6", "key is null", "key = 6 or key = 9", "key = 5", "key between 30 and 60 and document like '%1%'", "key is not null and key < 7"],
)
def test_filters_agree_with_spark(spark, stored, where):
    every = spark.range(1000).select((F.col("id") * 3).alias("key"), F.to_json(F.struct((F.col("id") * 3).alias("k"), F.concat(F.lit('é"\n\\ '), F.col("id")).alias("t"), F.array("id").alias("l"))).alias("document"))
    assert sorted(map(tuple, C.read_collection(spark, stored).where(where).collect())) == sorted(map(tuple, every.where(where).collect()))


def test_limits_by_hand():
    limits = lambda *f: C.Limits(list(f))
    key = ("key",)
    assert limits(StringStartsWith(key, "ab")).meets("aa", "ac") and not limits(StringStartsWith(key, "ab")).meets("ac", "b")
    assert limits(StringStartsWith(key, "ab")).holds("abc") and not limits(StringStartsWith(key, "ab")).holds("a")
    for f in (EqualTo(key, 5), EqualNullSafe(key, 5), In(key, (1, 5)), GreaterThan(key, 4), LessThan(key, 6), LessThanOrEqual(key, 5)):
        assert limits(f).holds(5) and limits(f).meets(0, 9)
    assert not limits(In(key, (1, 9))).meets(2, 8) and not limits(EqualTo(key, None)).holds(5)
    reader = C.CollectionReader({"path": "/nowhere"})
    other = StringContains(("document",), "x")
    assert list(reader.pushFilters([other])) == [other]


def test_strings_nulls_and_repeated_keys(spark, tmp_path):
    folder = f"{tmp_path}/s"
    rows = [("b", 1, "keep"), ("b", 2, None), (None, 3, "x"), ("é", 4, "x"), ("a\"\n", 5, "x"), ("", 6, "x")]
    docs = spark.createDataFrame(rows, "name string, v int, key string")
    C.write_collection(docs, folder, "name")
    found = C.read_collection(spark, folder, "string").select("key", F.get_json_object("document", "$.v").cast("int"))
    assert sorted(map(tuple, found.collect())) == [("", 6), ('a"\n', 5), ("b", 1), ("b", 2), ("é", 4)]
    assert [r["key"] for r in C.read_collection(spark, folder, "string").where("key like 'é%'").collect()] == ["é"]
    C.write_collection(docs.where("v = 4"), folder, "name")  # appended
    assert C.read_collection(spark, folder, "string").count() == 6
    C.write_collection(docs.where("v = 4"), folder, "name", overwrite=True)
    assert C.read_collection(spark, folder, "string").count() == 1 and len(data_files(folder)) == 1
    assert C.read_collection(spark, f"{tmp_path}/absent").count() == 0
    C.write_collection(docs.where("v > 99"), folder, "name", overwrite=True)
    assert C.read_collection(spark, folder, "string").count() == 0


def test_failed_job_leaves_nothing(tmp_path):
    folder = f"{tmp_path}/f"
    writer = C.CollectionWriter({"path": folder}, False)
    message = writer.write(iter([pa.RecordBatch.from_pydict({"key": [1, 2], "document": ["{}", "{\n}"]})]))
    assert len(message.files) == 2 and C.CollectionReader({"path": folder}).partitions()[0].path == ""
    writer.abort([message, None])
    assert os.listdir(folder) == []
