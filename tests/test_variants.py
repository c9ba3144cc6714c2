"""JSON as variants: schemas by aggregation, typed leaves, and what does not fit."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import variants

ROWS = [
    {"a": 1, "b": {"c": "x", "d": [1, 2]}, "m": 1},
    {"a": 2.5, "b": {"c": None, "e": True}, "m": "text"},
    {"a": None, "b": {}, 'q"q': "quoted", "s p": "space"},
    {"l": [{"k": 1}, {"k": 2}]},
]


def frame(spark):
    docs = [(i, json.dumps(r)) for i, r in enumerate(ROWS)] + [(10, None), (11, "{broken"), (12, ""), (13, "[1]"), (14, "null")]
    return variants.parsed(spark.createDataFrame(docs, "id long, doc string"), "doc")


def test_schema_is_merged(spark):
    found = variants.nested_schema(frame(spark).where("id < 10"))
    assert isinstance(found, T.StructType) and {f.name for f in found} == {"a", "b", "m", "l", 'q"q', "s p"}
    assert isinstance(found["b"].dataType["e"].dataType, T.BooleanType) and isinstance(found["m"].dataType, T.VariantType)
    assert variants.nested_schema(frame(spark).where("id = 10")).simpleString() in ("void", "variant")


def test_typed_values(spark):
    rows = {r["id"]: r for r in variants.typed(frame(spark).where("id < 13"), "id", schema=variants.nested_schema(frame(spark).where("id < 10"))).withColumn("m", F.to_json("m")).collect()}
    assert [rows[i]["a"] for i in range(4)] == [1.0, 2.5, None, None]
    assert [rows[i]["b_c"] for i in range(4)] == ["x", None, None, None] and rows[0]["b_d"] == [1, 2] and rows[1]["b_e"] is True
    assert [rows[i]["m"] for i in (0, 1)] == ["1", '"text"']
    assert rows[2]['q"q'] == "quoted" and rows[2]["s p"] == "space" and [x["k"] for x in rows[3]["l"]] == [1, 2]
    assert all(v is None for i in (10, 11, 12) for k, v in rows[i].asDict().items() if k != "id")


def test_entries(spark):
    found = variants.entries(frame(spark), "id").where("id in (0, 3, 10, 11, 13)")
    assert sorted((r["id"], r["key"], r["kind"]) for r in found.collect()) == [(0, "a", "BIGINT"), (0, "b", "OBJECT<c: STRING, d: ARRAY<BIGINT>>"), (0, "m", "BIGINT"), (3, "l", "ARRAY<OBJECT<k: BIGINT>>")]
