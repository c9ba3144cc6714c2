"""Sparse features and SVMs by dual coordinate ascent, against a plain solver."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.models import linear, topics
from textloom.plans import models


def solved(x, y, cost, reg, passes=3000, seed=0):
    """Weights of the hinge loss by coordinate ascent over all rows in one place, to a gap of a hundredth of a per cent."""
    rng = np.random.default_rng(seed)
    n, a, w = len(x), np.zeros(len(x)), np.zeros(x.shape[1])
    squares = (x**2).sum(axis=1)
    for _ in range(passes):
        for i in rng.permutation(n):
            new = min(max(a[i] + (1 - y[i] * (x[i] @ w)) * reg * n / squares[i], 0), cost[i])
            w += (new - a[i]) * y[i] * x[i] / (reg * n)
            a[i] = new
        primal = objective(w, x, y, cost, reg)
        if primal - (a.sum() / n - reg / 2 * w @ w) <= 1e-4 * primal:
            return w
    return w


def objective(w, x, y, cost, reg):
    return reg / 2 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).mean()


@pytest.fixture(scope="module")
def bags(spark):
    own, features = models._features(spark, "/root/testdata/sf0.001")
    return own.select("doc_id", F.col("lang").alias("label")), features


def arrays(features, size):
    rows = features.collect()
    x = np.zeros((len(rows), size + 1))
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r["indices"]] = r["values"]
    return [r["doc_id"] for r in rows], x


@pytest.mark.parametrize(("reg", "balanced", "rows_a_task"), [(0.001, False, linear.ROWS_A_TASK), (0.2, True, 70)])
def test_objective_is_the_best(spark, bags, reg, balanced, rows_a_task):
    """Within 1 % of what a plain solver reaches over the whole table, with rows in one task and in three."""
    doc_labels, features = bags
    names = ["de", "en", "es", "fr"]
    found = linear.fit(features.repartition(3), doc_labels, names, reg, rounds=60, local=20 if reg > 0.1 else 60, balanced=balanced, rows_a_task=rows_a_task)
    ids, x = arrays(features, models.SIZE)
    lang = {r["doc_id"]: r["label"] for r in doc_labels.collect()}
    for name, (w, b) in found.items():
        y = np.array([1 if lang[i] == name else -1 for i in ids])
        share = (y > 0).mean()
        cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(y))
        full = np.zeros(models.SIZE + 1)
        full[: len(w)], full[-1] = w, b
        best = objective(solved(x, y, cost, reg), x, y, cost, reg)
        assert objective(full, x, y, cost, reg) <= 1.01 * best + 1e-9
    got = {(r["doc_id"], r["label"]): (r["y_score"], r["y_pred"]) for r in linear.scores(features, found).collect()}
    for k, i in enumerate(ids):
        for name, (w, b) in found.items():
            score = x[k, : len(w)] @ np.array(w) + b
            assert got[i, name][0] == pytest.approx(score, abs=1e-8) and got[i, name][1] == int(got[i, name][0] > 0)


def test_pairs_and_vectors(spark, tmp_path):
    """Vectors hold what is not 0, in order, and files grow with that and not with the number of terms."""
    weighed = spark.createDataFrame([(1, 5, 2.0), (1, 2, 1.5), (1, 9, 0.0), (2, 0, 0.0)], "doc_id long, term_id long, tf double")
    sparse = topics.pairs(weighed)
    assert sorted(map(tuple, sparse.collect())) == [(1, [2, 5], [1.5, 2.0]), (2, [], [])]
    got = {r["doc_id"]: r["features"] for r in topics.vectors(sparse, 10).collect()}
    assert got[1].size == 10 and got[1].indices.tolist() == [2, 5] and got[1].values.tolist() == [1.5, 2.0] and got[2].numNonzeros() == 0
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 10_000).cast("int")).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    stored = topics.vectors(rows.coalesce(1), 10_000)
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in stored.inputFiles()) < 100_000  # 160 MB if dense


def test_edges(spark):
    """No rows, rows without features or labels, and features that the model has not seen."""
    empty = spark.createDataFrame([], "doc_id long, indices array<int>, values array<double>")
    labels = spark.createDataFrame([(1, "a"), (3, "a")], "doc_id long, label string")
    assert linear.fit(empty, labels, ["a", "b"]) == {"a": ([], 0.0), "b": ([], 0.0)}
    rows = spark.createDataFrame([(1, [0], [1.0]), (2, [], []), (3, [0], [2.0]), (4, [1], [1.0])], empty.schema)
    found = linear.fit(rows, labels, ["a", "b"])
    seen = {(r["doc_id"], r["label"]): r["y_pred"] for r in linear.scores(rows.unionByName(spark.createDataFrame([(5, [7], [9.0])], empty.schema)), found).collect()}
    assert len(seen) == 10 and [seen[i, "a"] for i in (1, 3)] == [1, 1] and [seen[i, "a"] for i in (2, 4)] == [0, 0]
    assert all(seen[i, "b"] == 0 for i in range(1, 6))
    assert linear.scores(empty, found).count() == 0


def test_spent_rounds_leave_the_disk(spark, monkeypatch):
    """Before a round is written only the rows that it reads are there; none is left at the end."""
    from pathlib import Path

    paths, standing, write = [], [], linear.kept

    def kept(rows, label):
        standing.append(sum(Path(p).exists() for p in paths))
        found = write(rows, label)
        paths.append(found._kept)
        return found

    monkeypatch.setattr(linear, "kept", kept)
    rows = spark.createDataFrame([(i, [i % 3], [1.0]) for i in range(30)], "doc_id long, indices array<int>, values array<double>")
    linear.fit(rows, spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "doc_id long, label string"), ["a", "b"], rounds=4, local=1, tolerance=-1)
    assert len(paths) == 5 and standing == [0, 1, 1, 1, 1] and not any(Path(p).exists() for p in paths)


def test_rows_at_rest_are_not_visited(monkeypatch):
    """Most of 500 rows that two clear features tell apart rest at a bound after a pass."""
    import types

    import pandas as pd

    visited, make = [], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.rng = make(seed)

        def permutation(self, rows):
            visited.append(rows if np.isscalar(rows) else len(rows))
            return self.rng.permutation(rows)

    values = make(5).uniform(1, 2, 500)
    batch = pd.DataFrame({"indices": [np.array([i % 2]) for i in range(500)], "values": [np.array([v]) for v in values], "y": [np.array([i % 2]) for i in range(500)], "a": [np.zeros(1)] * 500, "da": [np.zeros(1)] * 500})
    monkeypatch.setattr(np.random, "default_rng", Counted)
    shared = types.SimpleNamespace(value=(np.zeros((3, 1)), np.zeros(1), 0))
    found, told = linear._ascent(shared, 1, 0.001, 500, 20, (np.ones(1), np.ones(1)), 1)(iter([batch]))
    assert sum(visited) < 20 * 500 / 4 and np.stack(found["da"]).max() > 0 and len(told) == 4
