"""Label hierarchy, inverted index, valid labels, one-hot (L1-L8, L12-L14) and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import kept
from .ranks import kth, ordinals

LEVELS = ("section", "class", "subclass")


def from_levels(rows: DataFrame, section: Column, class_: Column, subclass: Column) -> DataFrame:
    """L1: (doc_id, level, label), one row for each label of a document; labels hold those above them."""
    one, two = section, F.concat_ws("-", section, class_)
    three = F.concat_ws("-", two, subclass)
    levels = F.array(*[F.struct(F.lit(name).alias("level"), label.alias("label")) for name, label in zip(LEVELS, (one, two, three), strict=True)])
    return rows.select("doc_id", F.inline(levels)).distinct()


def from_ipc(documents: DataFrame) -> DataFrame:
    """L1 over the nested ipc column."""
    parts = documents.select("doc_id", F.inline("ipc"))
    return from_levels(parts, F.col("section"), F.col("class"), F.col("subclass"))


def labels_of(doc_labels: DataFrame) -> DataFrame:
    """L3: (doc_id, labels), sorted."""
    return doc_labels.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def label_index(doc_labels: DataFrame) -> DataFrame:
    """(label, n_docs) over distinct documents; the long form itself is the index."""
    return doc_labels.groupBy("level", "label").agg(F.count("doc_id").alias("n_docs"))


def label_dim(doc_labels: DataFrame, least: int = 3) -> DataFrame:
    """(level, label, n_docs, is_valid, ordinal); ordinals count by length, then text."""
    valid = (F.col("level") == "section") | (F.col("n_docs") >= least)
    counted = ordinals(label_index(doc_labels).withColumn("is_valid", valid), "ordinal", F.length("label"), F.col("label"), F.col("level"))
    return counted.withColumn("ordinal", F.col("ordinal").cast("int"))


def one_hot(doc_labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, ones) with a 0/1 digit for each label of `vocabulary`, in its order."""
    names = vocabulary.agg(F.array_sort(F.collect_list(F.struct("ordinal", "label"))).alias("v"))
    names = names.select(F.transform("v", lambda x: x["label"]).alias("names"))
    joined = labels_of(doc_labels.join(vocabulary.select("level", "label"), ["level", "label"], "left_semi")).join(F.broadcast(names))
    return joined.select("doc_id", F.transform("names", lambda n: F.array_contains("labels", n).cast("tinyint")).alias("ones"))


def sparse_matrix(doc_labels: DataFrame, dim: DataFrame, splits: DataFrame) -> DataFrame:
    """(level, split, doc_id, ones), for each level and split a row a document with the ordinals of its valid
    labels, sorted; a document without one has an empty row.  Dense rows would be as wide as the label scheme."""
    valid = dim.where("is_valid").select("level", "label", "ordinal")
    joined = doc_labels.join(valid, ["level", "label"], "left").groupBy("level", "doc_id").agg(F.array_sort(F.collect_list("ordinal")).alias("ones"))
    return joined.join(splits.select("doc_id", "split"), "doc_id").select("level", "split", "doc_id", "ones")


def split(doc_labels: DataFrame, strata: str = "subclass", part: float = 0.2) -> DataFrame:
    """(doc_id, split).  A document belongs to the first of its labels in order; inside a stratum documents
    rank by a hash, and the ranks are cut into test, validation and training.

    The same as taking labels one after another and drawing from documents not yet assigned, without the loop.  Ranks are
    not counted: the last documents of test and validation are found (`ranks.kth`), and all others compared with them."""
    wanted = doc_labels if strata == "all" else doc_labels.where(F.col("level") == strata)
    first = wanted.groupBy("doc_id").agg(F.min(F.struct(F.length("label").alias("n"), "label")).alias("s")).select("doc_id", F.col("s.label").alias("stratum"))
    spread = F.coalesce(F.col("doc_id") * 2654435761 % 1000003, F.lit(-(2**31)))
    rows = kept(first.select("stratum", spread.cast("long").alias("spread"), F.col("doc_id").alias("id")), "strata")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    share = lambda n: F.when(F.floor(n * part) > 0, F.floor(n * part)).when(n > 1, 1).otherwise(0)
    sizes = sizes.withColumn("n_test", share(F.col("n"))).withColumn("n_val", share(F.col("n") - F.col("n_test")))
    sizes = sizes.select("stratum", F.col("n_test").cast("long").alias("n_test"), (F.col("n_test") + F.col("n_val")).cast("long").alias("n_held"))
    wanted = sizes.select("stratum", F.explode(F.array("n_test", "n_held")).alias("k"))
    last = kth(rows, "stratum", wanted)
    for which in ("test", "held"):
        sizes = sizes.join(last.select("stratum", F.col("k").alias(f"n_{which}"), F.struct("spread", "id").alias(which)), ["stratum", f"n_{which}"], "left")
    joined = rows.join(sizes.select("stratum", "test", "held"), "stratum")
    upto = lambda c: F.coalesce((F.col("spread") < F.col(f"{c}.spread")) | ((F.col("spread") == F.col(f"{c}.spread")) & (F.col("id").isNull() | (F.col("id") <= F.col(f"{c}.id")))), F.lit(False))
    name = F.when(upto("test"), "test").when(upto("held"), "validation").otherwise("training")
    return joined.select(F.col("id").alias("doc_id"), "stratum", name.alias("split"))
