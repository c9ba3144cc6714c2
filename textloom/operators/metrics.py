"""Multi-label metrics over (doc_id, label_id, y_true, y_score, y_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binarised(scores: DataFrame, above: float = 0.0) -> DataFrame:
    """X1."""
    return scores.withColumn("y_pred", (F.col("y_score") > above).cast("int"))


def _ratio(top, bottom):
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(0.0)


def _counts():
    hit = F.sum(F.col("y_true") * F.col("y_pred"))
    return hit.alias("tp"), (F.sum("y_pred") - hit).alias("fp"), (F.sum("y_true") - hit).alias("fn")


def _scores(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def micro(scores: DataFrame) -> DataFrame:
    """X2, X5."""
    return _scores(scores.agg(*_counts())).withColumn("total_positive", F.col("tp") + F.col("fp"))


def per_label(scores: DataFrame) -> DataFrame:
    """A row for each label; nothing is left out above a hundred labels."""
    return _scores(scores.groupBy("label_id").agg(*_counts()))


def macro(scores: DataFrame) -> DataFrame:
    """X6."""
    return per_label(scores).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def average_labels(scores: DataFrame) -> DataFrame:
    """X4."""
    return scores.agg(F.round(F.sum("y_true") / F.countDistinct("doc_id"), 2).alias("avg_labels"))


def coverage_error(scores: DataFrame) -> DataFrame:
    """X3."""
    least = F.min(F.when(F.col("y_true") == 1, F.col("y_score"))).over(Window.partitionBy("doc_id"))
    reached = scores.withColumn("least", least).groupBy("doc_id").agg(F.count(F.when(F.col("y_score") >= F.col("least"), 1)).alias("depth"))
    return reached.agg(F.avg("depth").alias("coverage_error"))


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """Share of true labels in the first max(n, number of true labels) ranks; ties to the higher label."""
    by_doc = Window.partitionBy("doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(by_doc.orderBy(F.desc("y_score"), F.desc("label_id"))))
    ranked = ranked.withColumn("n_true", F.sum("y_true").over(by_doc))
    hits = F.sum(F.when(F.col("rank") <= F.greatest(F.lit(n), F.col("n_true")), F.col("y_true")).otherwise(0))
    return ranked.agg(F.lit(n).alias("n"), _ratio(hits, F.sum("y_true")).alias("share"))


def confusion(scores: DataFrame, pairing: str = "skip") -> DataFrame:
    """(true_label, pred_label, n); null stands for "None".

    The k-th label missed is paired with the false one of rank 2k, which is how a list behaves that loses entries
    while an index moves on; pairing="dense" pairs rank by rank."""
    kind = F.when((F.col("y_true") == 1) & (F.col("y_pred") == 1), "tp").when(F.col("y_true") == 1, "fn").when(F.col("y_pred") == 1, "fp")
    marked = scores.withColumn("kind", kind).where("kind is not null")
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("label_id")) - 1)
    hit = ranked.where("kind = 'tp'").select(F.col("label_id").alias("true_label"), F.col("label_id").alias("pred_label"))
    missed = ranked.where("kind = 'fn'").select("doc_id", F.col("label_id").alias("true_label"), (F.col("rank") * (2 if pairing == "skip" else 1)).alias("at"))
    false = ranked.where("kind = 'fp'").select("doc_id", F.col("label_id").alias("pred_label"), F.col("rank").alias("at"))
    paired = missed.join(false, ["doc_id", "at"], "full").select("true_label", "pred_label")
    return hit.unionByName(paired).groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def confusion_table(counts: DataFrame, labels: list) -> DataFrame:
    """One row for each true label, one column for each predicted one."""
    named = counts.select(F.coalesce(F.col("true_label").cast("string"), F.lit("None")).alias("true_label"), F.coalesce(F.col("pred_label").cast("string"), F.lit("None")).alias("p"), "n")
    return named.groupBy("true_label").pivot("p", [*map(str, labels), "None"]).agg(F.sum("n")).na.fill(0)
