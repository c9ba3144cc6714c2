"""Keyed upsert with state: late and repeated rows, nulls, what a trigger touches, and what is left behind."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.archive import latest
from textloom.streaming import ingest, keyed

SCHEMA = "k long, at timestamp, n long, v string"


@pytest.fixture
def feed(spark, tmp_path):
    """land(rows) takes rows in by one trigger and returns the query."""
    base = str(tmp_path)

    def land(rows, keep=10):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        query = keyed.upsert(ingest.landing(spark, f"{base}/landing", land.schema), "k", ["at", "n"], f"{base}/changes", f"{base}/checkpoint", keep)
        query.awaitTermination()
        return query

    land.base, land.schema = base, T._parse_datatype_string(SCHEMA)
    return land


def at(day):
    import datetime

    return None if day is None else datetime.datetime(2024, 1, day)


def test_as_in_one_batch(spark, feed):
    """Rows in any order over several triggers give what one grouping of all of them gives."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), at(rng.choice([None, 1, 2, 3])), n, f"v{n}") for n in range(300)]
    rng.shuffle(rows)
    for a in range(0, 300, 100):
        feed(rows[a : a + 100] + rows[:10])
    want = latest(spark.createDataFrame(rows, SCHEMA), "k", "at", "n").collect()
    key = lambda r: (r["k"] is not None, r["k"] or 0)
    assert sorted(keyed.current(spark, f"{feed.base}/checkpoint", feed.schema).collect(), key=key) == sorted(want, key=key)


def test_a_trigger_touches_its_keys_only(spark, feed):
    feed([(k, at(5), 1, "old") for k in range(200)])
    query = feed([(7, at(6), 1, "new"), (8, at(4), 1, "late"), (9, at(5), 1, "again"), (500, at(1), 1, "first")])
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] == 2  # of 200 keys
    last = keyed.changes(spark, f"{feed.base}/changes").where("trigger = 1")
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [(7, "new"), (500, "first")]
    now = {r["k"]: r["v"] for r in keyed.current(spark, f"{feed.base}/checkpoint", feed.schema).collect()}
    assert len(now) == 201 and (now[7], now[8], now[9], now[500]) == ("new", "old", "old", "first")


def test_old_changes_go(spark, feed):
    for n in range(4):
        feed([(1, at(1), n, f"v{n}")], keep=2)
    assert sorted(f for f in os.listdir(f"{feed.base}/changes") if f.startswith("trigger")) == ["trigger=2", "trigger=3"]
    assert [r["v"] for r in keyed.current(spark, f"{feed.base}/checkpoint", feed.schema).collect()] == ["v3"]
    assert spark.conf.get(keyed.PROVIDER, None) != keyed.ROCKSDB  # other queries keep their provider


def test_newest_of_a_batch():
    rows = {"k": [1, None, 1, 2, None, 1, 1], "o": [3, 1, None, 1, 2, 3, 2], "v": list("abcdefg")}
    batch = pa.RecordBatch.from_pydict(rows)
    (found,) = keyed.newest("k", ["o"])(iter([batch, batch.slice(0, 0)]))
    assert found.column("v").to_pylist() == ["a", "d", "e"]  # of ties the first


def test_a_hot_key_shrinks_before_the_shuffle(spark, feed):
    rows = [(1, at(1 + n % 28), n, "x") for n in range(3000)] + [(k, at(1), 0, "y") for k in range(2, 20)]
    query = feed(rows)
    assert query.lastProgress["numInputRows"] == 3018
    assert keyed.current(spark, f"{feed.base}/checkpoint", feed.schema).where("k = 1").first()["n"] == max(n for n in range(3000) if n % 28 == 27)
    plan = query._jsq.explainInternal(False) if hasattr(query._jsq, "explainInternal") else ""
    assert not plan or plan.index("MapInArrow") > plan.index("Exchange")  # below it, so before it


def test_columns_may_be_called_anything(spark, tmp_path):
    """Names of the operator's own columns, and one that needs quoting, clash with nothing."""
    schema = "__key long, o0 long, __row string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    keyed.upsert(stream, "__key", ["o0"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [tuple(r) for r in keyed.current(spark, f"{tmp_path}/state", stream.schema).collect()] == [(1, 2, "b")]
    assert keyed.changes(spark, f"{tmp_path}/out").select(F.count(F.lit(1))).first()[0] == 1
