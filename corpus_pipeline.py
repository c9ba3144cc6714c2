"""A training corpus from raw documents: five stages, each written as Parquet and reread before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, line_dedup, minhash_dedup, mixing, quality
from textloom.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts are scored as empty ones; of rows that repeat all stay or all go; a null doc_id is no reason to go.
    Without labels of both kinds every document has the smoothed share of label 1 as its score.  All columns pass
    through; an empty table gives an empty one."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels")).select(*_named(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; documents stay, with their first copies whole.

    A null text stays null, a text may become empty; texts of fewer than three lines stay whole.  A null doc_id comes
    before all others, and rows that share a doc_id are no earlier than each other.  n_chars is set anew; all other
    columns, whatever their names, pass through; an empty table gives an empty one."""
    return line_dedup.line_dedup(docs, counts=False).select(*_named(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8).

    The smallest doc_id of a group stays, a null one before all others.  Null and empty texts and texts without words
    are in no group and stay; rows that repeat doc_id and text all stay or all go.  All columns pass through; an empty
    table gives an empty one."""
    return minhash_dedup.keep_one_each(docs).select(*_named(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by the target weights of their sources; copies are rows with the same doc_id.

    A null source is a source of its own, a source without characters gets no copies; rows that agree in doc_id and source are
    repeated equally often.  All columns pass through; an empty table gives an empty one."""
    return mixing.mix_sources(docs, marks=False).select(*_named(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids, and what they decode to.

    A null or empty text has no tokens; a null doc_id stays null; each row gives one row, repeated ones too.  Other
    columns are left out; an empty table gives an empty one."""
    return bpe.bpe(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _named(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL cannot express the classifier, near-dedup or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
