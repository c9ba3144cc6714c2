"""Ordinals by ranges and the k-th of each group, against sorting in one place."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import labels, ranks
from textloom.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_ordinals(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *"abcdef"]), n) for n in range(500)]
    docs = spark.createDataFrame(rows, "v string, id long").withColumn("ordinal2", F.lit("clash"))
    found = ranks.ordinals(docs.repartition(7), "place", F.col("v"), F.col("id"), first=5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["v"], r["id"]) for r in sorted(found.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in found.collect()) == list(range(5, 505))
    assert found.columns == ["v", "id", "ordinal2", "place"] and "SinglePartition" not in plan_of(found)
    assert ranks.ordinals(docs.where("false"), "place", F.col("v")).count() == 0


def test_kth(spark):
    """Groups of all sizes, hashes that tie, hashes in one bucket and in many, several k of a group."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(w), i) for g, n, w in (("hot", 900, 10**6), ("tied", 60, 3), ("narrow", 70, 900), ("one", 1, 5), (None, 9, 9)) for i in range(n)]
    rows += [("tied", 1, None)]
    wanted = [(g, k) for g in ("hot", "tied", "narrow", "one", "absent") for k in (0, 1, 2, 30, 60, 450, 900, 901)]
    got = ranks.kth(spark.createDataFrame(rows, "g string, spread long, id long"), "g", spark.createDataFrame(wanted, "g string, k long"))
    groups = {}
    for g, s, i in rows:
        groups.setdefault(g, []).append((s, i is not None, i))
    want = {(g, k, s, i) for g, k in wanted if 0 < k <= len(groups.get(g, ())) for s, _, i in [sorted(groups[g])[k - 1]]}
    assert {tuple(r) for r in got.collect()} == want
    assert "Window" not in plan_of(got)


def test_split_as_by_ranking(spark):
    """The split by thresholds is the one that ranking each stratum in one place gives; no window in its plan."""
    rng = random.Random(4)
    rows = [(i, "subclass", s) for i in [None, *range(-50, 700)] for s in [rng.choice(["A-1", "A-1", "A-1", "B-2", f"C-{i if i and i % 9 == 0 else 0}"])]]
    docs = spark.createDataFrame(rows, "doc_id long, level string, label string")
    found = labels.split(docs)
    spread = F.col("doc_id") * 2654435761 % 1000003
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(spread, "doc_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label"))).collect()

    def name(r):
        share = lambda n: int(n * 0.2) or int(n > 1)
        test = share(r["n"])
        return "test" if r["rank"] <= test else "validation" if r["rank"] <= test + share(r["n"] - test) else "training"

    assert {(r["doc_id"], r["stratum"], r["split"]) for r in found.collect()} == {(r["doc_id"], r["label"], name(r)) for r in ranked}
    assert "Window" not in plan_of(found) and labels.split(docs.where("false")).count() == 0


def test_plans_without_a_single_task(spark, sf_dir):
    for name in ("q_split", "q_label_order", "q_natural_order"):
        from textloom.plans import runs  # noqa: F401  registers its queries

        assert "SinglePartition" not in plan_of(QUERIES[name](spark, sf_dir))
