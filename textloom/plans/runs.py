"""Queries over what runs leave on shared storage, whole documents as XML, sequences of all levels, and trained searches."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..models import linear, topics, trials
from ..operators import extract, labels, parts
from ..sources import archive, stores
from .catalog import _DIM, _LEVELS, _SPLIT, _WORDED, _WORDS, docs, order_labels, query, sequences, table, three_fields
from .models import SIZE, TRAINING_ROWS, _arrays, _features, held_out, training_rows

# ---- sources and sinks


@query("q_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def q_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The customer of every order."""
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return stores.lookup(wanted, table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@query(
    "q_token_lines",
    f"SELECT doc_id::VARCHAR AS id, coalesce(lang, 'none') AS split, 1::INT AS level, coalesce(source, 'none') AS part_name, md5(array_to_string({_WORDS.format('text')}, ' ')) AS digest FROM documents",
)
def q_token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Token lines written compressed by folder, and read again."""
    own = docs(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.array_join(X.words(F.col("text")), " ").alias("tokens"), F.coalesce("lang", F.lit("none")).alias("split"), F.lit(1).alias("level"), F.coalesce("source", F.lit("none")).alias("part_name")
    )
    path = stores.scratch(spark, "token-lines")
    stores.write_lines(stores.full_documents(own), path)
    return stores.read_lines(spark, path).select("id", "split", "level", "part_name", F.md5(F.col("rest").cast("binary")).alias("digest"))


@query("q_batch_files", "SELECT o_orderkey // 10000 * 10000 AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL")
def q_batch_files(spark: SparkSession, d: str) -> DataFrame:
    """Numbered batches, all of them."""
    path = stores.scratch(spark, "batches")
    stores.write_batches(table(spark, d, "orders").select("o_orderkey"), path, "o_orderkey", 10_000)
    found = stores.batches_from(spark, path, 0).groupBy(F.col("batch").cast("long").alias("batch"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


_THREE = ("training", "validation", "test")


@query("q_data_files", "SELECT ['training', 'validation', 'test'][label % 3 + 1] AS split, 1::INT AS level, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE label IS NOT NULL GROUP BY ALL")
def q_data_files(spark: SparkSession, d: str) -> DataFrame:
    """Arrays by split and level, each split from its own folders."""
    names = F.array(*[F.lit(x) for x in _THREE])
    path = stores.scratch(spark, "arrays")
    archive.write_parts(table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", "embedding", F.get(names, F.col("label") % 3).alias("split"), F.lit(1).alias("level")), path)
    each = [stores.data_files(spark, path, split, 1).groupBy("split", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")) for split in _THREE]
    return reduce(DataFrame.unionByName, each)


@query("q_natural_order", "SELECT 'file-' || n_nationkey || '.gz' AS name, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def q_natural_order(spark: SparkSession, d: str) -> DataFrame:
    """K8: file-2 before file-10."""
    return stores.natural_order(table(spark, d, "nation").select(F.concat(F.lit("file-"), F.col("n_nationkey").cast("string"), F.lit(".gz")).alias("name")), "name")


@query("q_not_landed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q_not_landed(spark: SparkSession, d: str) -> DataFrame:
    """What is wanted and not there yet."""
    return archive.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---- extraction

#: Elements that stand around values: field, opening tags, value in SQL, closing tags.
_BIBLIO_4 = [
    ("patent_country", "<publication-reference><document-id><country>", "lang", "</country>"),
    ("patent_doc_number", "<doc-number>", "'A' || doc_id", "</doc-number>"),
    ("patent_kind", "<kind>", "source", "</kind>"),
    ("patent_date", "<date>", "'2005' || doc_id", "</date></document-id></publication-reference>"),
    ("application_country", "<application-reference><document-id><country>", "lang", "</country>"),
    ("application_doc_number", "<doc-number>", "'B' || doc_id", "</doc-number>"),
    ("application_date", "<date>", "'2004' || doc_id", "</date></document-id></application-reference>"),
    ("classification_national_main", "<classification-national><main-classification>", "'4 ' || doc_id", "</main-classification>"),
    ("classification_national_further", "<further-classification>", "'5 ' || doc_id", "</further-classification></classification-national>"),
    ("invention_title", "<invention-title>", "'title ' || doc_id", "</invention-title>"),
]
_BIBLIO_2 = [
    ("patent_kind", "<B100><B130><PDAT>", "source", "</PDAT></B130>"),
    ("patent_doc_number", "<B110><DNUM><PDAT>", "'A' || doc_id", "</PDAT></DNUM></B110>"),
    ("patent_date", "<B140><DATE><PDAT>", "'2003' || doc_id", "</PDAT></DATE></B140>"),
    ("patent_country", "<B190><PDAT>", "lang", "</PDAT></B190></B100>"),
    ("classification_ipc", "<B500><B510><B511><PDAT>", "'A01B ' || doc_id", "</PDAT></B511></B510>"),
    ("classification_national_main", "<B520><B521><PDAT>", "'4 ' || doc_id", "</PDAT></B521>"),
    ("classification_national_further", "<B522><PDAT>", "'5 ' || doc_id", "</PDAT></B522></B520>"),
    ("references_cited", "<B560><B561><PCIT><DOC><DNUM><PDAT>", "'C ' || doc_id", "</PDAT></DNUM></DOC></PCIT></B561></B560>"),
    ("us_field_of_search", "<B580><B582><PDAT>", "'6 ' || doc_id", "</PDAT></B582></B580></B500>"),
    ("inventors", "<B700><B720><B721><PDAT>", "'name ' || doc_id", "</PDAT></B721></B720></B700>"),
]


def _fields_sql(biblio: list) -> str:
    """Classifications, searches and references are without white space."""
    squeezed = lambda f: f.startswith("classification") or f in ("references_cited", "us_field_of_search")
    return "SELECT doc_id, " + ", ".join(f"replace({v}, ' ', '') AS {f}" if squeezed(f) else f"{v} AS {f}" for f, _, v, _ in biblio) + " FROM documents"


def _fields(spark: SparkSession, d: str, version: int, biblio: list, opening: str, closing: str) -> DataFrame:
    xml = F.concat(F.lit(opening), *[F.concat(F.lit(a), F.expr(v), F.lit(z)) for _, a, v, z in biblio], F.lit(closing))
    found = extract.fields(docs(spark, d).select("doc_id", xml.alias("xml")), version)
    return found.select("doc_id", *[F.array_join(f, "|").alias(f) for f, *_ in biblio])


@query("q_xpath_v4", _fields_sql(_BIBLIO_4))
def q_xpath_v4(spark: SparkSession, d: str) -> DataFrame:
    """P2, P5, P9."""
    return _fields(spark, d, 4, _BIBLIO_4, "<us-patent-grant><us-bibliographic-data-grant>", "</us-bibliographic-data-grant></us-patent-grant>")


@query("q_xpath_v2", _fields_sql(_BIBLIO_2))
def q_xpath_v2(spark: SparkSession, d: str) -> DataFrame:
    """P3, P5, P9."""
    return _fields(spark, d, 2, _BIBLIO_2, "<PATDOC><SDOBI>", "</SDOBI></PATDOC>")


@query("q_parse_errors", "SELECT doc_id, doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 7 <> 0 THEN '<abstract><p>' || lang || '</p></abstract>' END AS abstract_xml FROM documents")
def q_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document lacks its last tag; all are kept, with the error or the subtree."""
    xml = F.concat(F.lit("<us-patent-grant><abstract><p>"), "lang", F.lit("</p></abstract>"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("</us-patent-grant>"))
    raw = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("seq"), F.lit(4).alias("dtd_version"), xml.alias("xml"))
    return extract.parsed_documents(raw).select(F.col("path").cast("long").alias("doc_id"), F.col("error").isNotNull().alias("failed"), "abstract_xml")


@query("q_json_values", "SELECT event_id, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def q_json_values(spark: SparkSession, d: str) -> DataFrame:
    """P18."""
    return extract.json_values(table(spark, d, "events"), "props", "event_id")


# ---- sequences and label matrices of all levels

_SIZES = f"""WITH {_WORDED}, {_LEVELS}, thirds AS (SELECT doc_id, part_name, p, third, len(w) AS whole, CASE WHEN len(w) < 3 THEN CASE WHEN third = 1 THEN len(w) ELSE 0 END WHEN third < 3 THEN len(w) // 3 ELSE len(w) - 2 * (len(w) // 3) END AS n FROM worded, names),
pieces AS (SELECT *, unnest(range(p)) AS i FROM thirds),
placed AS (SELECT DISTINCT doc_id, 0 AS slot, whole AS n FROM thirds UNION ALL SELECT doc_id, CASE third WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 29 END, n FROM thirds
 UNION ALL SELECT doc_id, CASE third WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 30 END + i, CASE WHEN n < p THEN CASE WHEN i = 0 THEN n ELSE 0 END WHEN i < p - 1 THEN n // p ELSE n - (p - 1) * (n // p) END FROM pieces),
two AS (SELECT DISTINCT doc_id, 0 AS slot, whole AS n FROM thirds UNION ALL SELECT doc_id, third, n FROM thirds)"""


@query(
    "q_fhv_levels",
    f"{_SIZES}, every AS (SELECT 3 AS level, * FROM placed UNION ALL SELECT 2, * FROM two UNION ALL SELECT 1, * FROM two WHERE slot = 0) SELECT doc_id, level::INT AS level, count(*) AS n_slots, string_agg(n::VARCHAR, ',' ORDER BY slot) AS sizes FROM every WHERE doc_id IN (SELECT doc_id FROM worded WHERE len(w) > 0) GROUP BY ALL",
)
def q_fhv_levels(spark: SparkSession, d: str) -> DataFrame:
    """H1-H6: sequences of 1, 4 and 34 slots of one-wide vectors, the words of each part; parts without words have none."""
    rows = parts.level_parts(three_fields(spark, d)).where(F.size("tokens") > 0)
    vectors = stores.kept(rows.select("doc_id", "level", "part_name", "part_no", F.array(F.size("tokens").cast("float")).alias("vec")), "vectors")
    each = []
    for level in (1, 2, 3):
        filled = parts.sequences_of_level(vectors, level, 1)
        sizes = F.transform("seq", lambda v: v[0].cast("long").cast("string"))
        each.append(filled.select("doc_id", F.lit(level).alias("level"), F.size("seq").cast("long").alias("n_slots"), F.array_join(sizes, ",").alias("sizes")))
    return reduce(DataFrame.unionByName, each)


@query(
    "q_label_matrices",
    f"{_SPLIT}, {_DIM} SELECT m.level, done.split, count(DISTINCT m.doc_id) AS n_docs, count(ordinal) AS n_ones, coalesce(sum(ordinal), 0)::BIGINT AS columns FROM m JOIN done USING (doc_id) LEFT JOIN (SELECT * FROM dim WHERE is_valid) v ON v.level = m.level AND v.label = m.label GROUP BY ALL",
)
def q_label_matrices(spark: SparkSession, d: str) -> DataFrame:
    """H7: the matrices of three levels and three splits, as the columns of each row's ones."""
    own = order_labels(spark, d)
    matrix = labels.sparse_matrix(own, labels.label_dim(own), labels.split(own))
    ones = F.aggregate("ones", F.lit(0).cast("long"), lambda s, x: s + x)
    return matrix.groupBy("level", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ones")).alias("n_ones"), F.sum(ones).alias("columns"))


# ---- models on topics and sequences, searches


def _topic_rows(spark: SparkSession, d: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, and their topics by a model that is written and read again under its name."""
    own, found = _features(spark, d)
    features = topics.vectors(found, SIZE)
    where = f"{path or stores.scratch(spark, 'topics')}/{topics.name('bm25', 8, 5, 0.5)}"
    topics.save(topics.fit(features, topics=8, passes=5, batch=256), where)
    return own, stores.kept(topics.transform(topics.load(where), features), "topics")


@query("q_topics_svm")
def q_topics_svm(spark: SparkSession, d: str) -> DataFrame:
    """One-vs-rest classifiers of languages on topics."""
    own, found = _topic_rows(spark, d)
    names = sorted(r["lang"] for r in own.where("lang IS NOT NULL").select("lang").distinct().collect())  # the label dimension
    features = linear.dense(found, "topics")
    return linear.scores(features, linear.fit(features, own.select("doc_id", F.col("lang").alias("label")), names))


def _searched(spark: SparkSession, rows: DataFrame, key: str, column: str, grid: dict, n: int, build, most: int, **fitting):
    """(trial table, best network, labels) of a search over `n` settings on a sample of about `most` rows."""
    known, held, outputs = training_rows(rows, key, most)
    data = (*_arrays(known, column, outputs), *_arrays(held, column, outputs))
    settings = trials.draws(grid, n)
    make = build(data[0].shape[-1], outputs)
    path = stores.scratch(spark, "trials")
    done = trials.run(spark, settings, make, tuple(np.asarray(x) for x in data), path, **fitting)
    return done, _best(done, settings, make)


def _best(done: DataFrame, settings: list[dict], make):
    chosen = trials.best(done).select("model").first()["model"]
    return trials.restored(done, next(s for s in settings if trials.name(s) == chosen), make)


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """With `label`, the place of each value of a small dimension in order."""
    names = sorted(r[0] for r in rows.where(F.col(column).isNotNull()).select(column).distinct().collect())
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column)).cast("int") - 1
    return rows.withColumn("label", place)


@query("q_topics_mlp")
def q_topics_mlp(spark: SparkSession, d: str) -> DataFrame:
    """C11, with C6, C9, C10: a search of perceptrons on the topics of all documents, the best of them applied to all."""
    own, found = _topic_rows(spark, d)
    rows = _numbered(found.join(own.select("doc_id", "lang"), "doc_id"), "lang").select(F.col("doc_id").alias("key"), F.col("topics").alias("x"), "label")
    known, outputs = held_out(rows, "key")
    settings = trials.draws(trials.MLP_GRID, 4)
    make = trials.mlp(len(found.first()["topics"]), outputs, 0.05)
    done = trials.run_whole(spark, settings, make, known, outputs, stores.scratch(spark, "trials"), epochs=10, batch=256)
    return trials.neural.scores(rows.select(F.col("key").alias("doc_id"), "x"), _best(done, settings, make))


def _labelled_sequences(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("doc_id")).agg(F.min_by("label", "vec_id").alias("label"))
    return sequences(spark, d, "true").join(first, "doc_id")


@query("q_fhv_mlp")
def q_fhv_mlp(spark: SparkSession, d: str, most: int = TRAINING_ROWS) -> DataFrame:
    """C12, H8, with C6, C9, C10: a search of perceptrons on flattened sequences."""
    rows = _labelled_sequences(spark, d).select("doc_id", F.flatten("seq").alias("flat"), "label")
    _, model = _searched(spark, rows, "doc_id", "flat", trials.MLP_GRID, 4, lambda a, b: trials.mlp(a, b, 0.05), most, epochs=10, batch=256)
    return trials.neural.scores(rows.select("doc_id", F.col("flat").alias("x")), model)


@query("q_lstm_search")
def q_lstm_search(spark: SparkSession, d: str, most: int = TRAINING_ROWS) -> DataFrame:
    """The history of a search of LSTMs with convolution and recurrent dropout, one row an epoch."""
    rows = _labelled_sequences(spark, d)
    grid = trials.LSTM_GRID | {"filters": [0, 16]}
    done, _ = _searched(spark, rows, "doc_id", "seq", grid, 4, lambda a, b: trials.lstm(a, b, 0.016), most, epochs=3, batch=128)
    return trials.history(done).select("model", "epoch", F.round("val_loss", 6).alias("val_loss"), "best")
