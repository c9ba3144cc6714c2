"""Postings and parts that are made inside the row of a document: the same results, without shuffles of postings."""

import re
from collections import Counter

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import parts
from textloom.operators import postings as P

TEXTS = ["green tea, green tea", "black tea", "", "   ", "milk", "green milk tea milk", "tea " * 40]


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def documents(spark, ids=None):
    rows = [(i if ids is None else ids[i], t, ("en", "de")[i % 2], None if i == 3 else "web") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_counted_runs(spark):
    rows = spark.createDataFrame([(["b", "a", "b", ""],), ([],), (None,)], "t array<string>").select(X.counted(F.col("t")).alias("c")).collect()
    assert [r["c"] and [tuple(x) for x in r["c"]] for r in rows] == [[("", 1), ("a", 1), ("b", 2)], [], None]


def test_postings_are_not_shuffled(spark):
    rows = P.postings(documents(spark))
    assert "Exchange" not in plan_of(rows)
    found = {(r["term"], r["doc_id"]): r["tf"] for r in rows.collect()}
    assert found[("tea", 0)] == 2 and found[("green tea", 0)] == 2 and found[("tea green", 0)] == 1 and found[("tea tea", 6)] == 39


def test_rows_that_share_an_id_are_one_document(spark):
    shared = P.postings(documents(spark, [0, 0, 2, 3, 4, 5, None])).collect()
    assert len(shared) == len({(r["term"], r["doc_id"]) for r in shared})
    assert Counter({r["term"]: r["tf"] for r in shared if r["doc_id"] == 0})["tea"] == 3


def test_chi_squared_once_is_chi_squared(spark):
    docs = documents(spark).withColumn("class", F.concat_ws("-", "lang", "source"))
    n, rows, classes = docs.count(), P.postings(docs), docs.select("doc_id", "class")
    for once, joined in ((P.chi_squared_once, P.chi_squared), (P.chi_squared_dense_once, P.chi_squared_dense)):
        got, want = ({r["term"]: (r["df"], round(r["chi"], 9)) for r in x.collect()} for x in (once(docs, n, 1), joined(rows, classes, n, 1)))
        assert got == want and len(want) > 2


def test_a_class_of_all_documents_is_left_out(spark):
    docs = documents(spark).withColumn("class", F.lit("one"))
    assert P.chi_squared_once(docs, docs.count(), 1).count() == P.chi_squared_dense_once(docs, docs.count(), 1).count() == 0


def test_weights_shuffle_postings_once_or_not_at_all(spark):
    docs = P.sized(documents(spark))
    rows = P.postings(docs, carry=("len", "split"))
    assert "Exchange hash" not in plan_of(P.weights(rows, docs, ("tf", "sublinear_tf")))
    assert plan_of(P.weights(rows, docs, ("bm25",))).count("Exchange hash") == 1


def test_chunks_make_their_tokens_once(spark):
    made = parts.chunks(X.words(F.col("text")), 23)
    assert len(re.findall(r"split\(", plan_of(documents(spark).select(made.alias("c"))))) == 1


def test_level_parts_read_documents_once(spark):
    own = documents(spark).select("doc_id", *[X.words(F.col("text")).alias(n) for n in parts.PART_COUNTS])
    rows = parts.level_parts(own)
    assert "Union" not in plan_of(rows)
    assert rows.count() == len(TEXTS) * (1 + 3 + 30)
    assert {r["part_no"] for r in rows.where("level = 3 AND part_name = 'claims'").collect()} == {1, 2, 3, 4}
