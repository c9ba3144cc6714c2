"""The registered queries on whole test tables against DuckDB or brute force, and the pipeline."""

import os

import duckdb
import pandas as pd
import pytest

from textloom.llm import queries

from . import helpers as H


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_bytes_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == H.removed_bytes(rows)


def test_near_duplicates_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.QUERIES["op9_minhash_dedup"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == H.minhash_expected(rows, 4)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "line_stage", "near_dedup_stage", "mixing_stage", "encoding_stage"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = done.collect()
    assert 0 < len(rows) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name", ["op3_mix_sources", "op7_line_dedup", "op8_exact_dedup"])
def test_sql_on_edge_cases(spark, tmp_path, name):
    """Nulls, empty texts and repeated rows fare in the queries as in their SQL."""
    rows = H.edge_rows()
    rows = rows if name != "op8_exact_dedup" else [r for r in rows if r[0] is not None]  # its SQL has no order for null ids
    spark.createDataFrame(rows, H.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert [r.replace(".0,", ",") for r in key(got)] == [r.replace(".0,", ",") for r in key(want)]


def test_vector_sql_on_edge_cases(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [2.0, 0.0, 0.0]), (10, [0.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.QUERIES["op2_vector_dedup"](spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.ORACLE_SQL['op2_vector_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_encoding_query_against_the_library(spark, sf_dir):
    """Every column of the registered query over a whole table."""
    from tokenizers import Tokenizer

    from textloom.llm import bpe

    own = Tokenizer.from_file(bpe.vocabulary_path())
    own.no_truncation()
    own.no_padding()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), H.sha(" ".join(map(str, ids))), H.sha(own.decode(ids, skip_special_tokens=False))))
    got = queries.QUERIES["op6_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_quality_query_by_hand(spark):
    """The registered query: who is held out, what is predicted, that only allowed labels count, and how well it does."""
    import zlib

    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_quality"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    by_text = {}
    for r in rows:
        assert abs(by_text.setdefault(docs[r["doc_id"]], r["score"]) - r["score"]) < 1e-9  # only the text is an input
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(judged) > 50 and sum(p == q for p, q in judged) / len(judged) > 0.93


def test_quality_ignores_labels_held_out(spark):
    from pyspark.sql import functions as F

    from textloom.llm import quality

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r["doc_id"], r["score"]) for r in quality.classify(docs, x).collect()) for x in (labels, turned))
    assert one == two


def _stage(number):
    import corpus_pipeline

    return corpus_pipeline.STAGES[number][1]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder whose labels are all of one kind, so that every score is their smoothed share."""
    folder = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame([(i, 1) for i in range(1, 17)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _clashing(spark, rows=None):
    from pyspark.sql import functions as F

    return H.frame(spark, rows).withColumns({c: F.lit(c) for c in ("n_removed", "shuffle_key", "component", "held_out", "__id", "__th", "ids2")})


@pytest.mark.parametrize("number", range(5))
def test_stages_on_edge_cases(spark, labelled, number):
    """Nulls, empty and repeated rows, clashing columns, and an empty table in every stage."""
    docs = _clashing(spark)
    rows = _stage(number)(spark, docs, labelled).collect()
    none = _stage(number)(spark, _clashing(spark, []), labelled)
    assert none.count() == 0
    if number == 4:
        assert none.columns == ["doc_id", "n_tokens", "ids", "decoded"] and len(rows) == len(H.edge_rows())
        assert all(r["n_tokens"] == len(r["ids"]) for r in rows) and {r["decoded"] for r in rows if r["doc_id"] in (5, 6)} == {""}
        return
    assert none.columns == docs.columns and none.schema == docs.schema
    assert all(r[c] == "extra" for r in rows for c in H.CLASHING if c in docs.columns)
    assert all(r[c] == c for r in rows for c in ("n_removed", "shuffle_key", "component", "__id", "__th"))
    ids, given = [H.ordered(r["doc_id"]) for r in rows], [H.ordered(r[0]) for r in H.edge_rows()]
    if number == 0:  # no label of the other kind: every score is the smoothed share, above the threshold
        assert sorted(ids) == sorted(given)
    elif number == 1:
        assert sorted(ids) == sorted(given) and {r["doc_id"]: r["text"] for r in rows}[14] == "a\nb"
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    elif number == 2:
        component = {(i, n): c for i, n, c in H.minhash_expected(H.edge_rows(), 5)}
        want = sorted(H.ordered(r[0]) for r in H.edge_rows() if component[H.ordered(r[0]), len(H.shingles(r[1], 5))] == H.ordered(r[0]))
        assert sorted(ids) == want and ids.count(18) == 2  # repeated rows stay or go together
    else:
        counts = {}
        for i in ids:
            counts[i] = counts.get(i, 0) + 1
        assert set(counts) <= set(given)


def test_near_dedup_stage_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, _, c in H.minhash_expected(rows, 5) if i == c}
    assert {r["doc_id"] for r in _stage(2)(spark, docs, "").collect()} == want


def test_long_texts(spark):
    """One text of 20 MB beside others that repeat parts of it."""
    import numpy as np

    from textloom.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup, suffix_dedup

    words = np.char.add("w", np.random.default_rng(6).integers(0, 10**6, 2_700_000).astype(str)).tolist()
    long_text = " ".join(words)
    rows = [(1, long_text, "en", "a", 1), (2, " ".join(words[500_000:500_200]), "en", "a", 1), (3, "other " * 3, "en", "a", 1)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    assert len(long_text) > 19_000_000
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 200, 3: 0}
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert gone[1] == (len(long_text), 0) and gone[2][0] == gone[2][1] and gone[3] == (18, 0)
    assert minhash_dedup.minhash_dedup(docs).where("kept").count() == 3
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 3
    assert line_dedup.line_dedup(docs).agg({"n_lines": "sum"}).first()[0] == 3
