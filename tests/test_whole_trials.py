"""Trials that learn from all rows of a table, share by share."""

import numpy as np
import pytest

from textloom.models import neural, trials
from textloom.plans import models, runs


def test_perceptrons_on_topics_learn_from_every_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["de", "en", None][i % 3]) for i in range(9_000)], "doc_id long, lang string")
    found = docs.selectExpr("doc_id", "array(cast(doc_id % 3 as double), 1.0D) AS topics")
    seen = []

    def run_whole(spark, settings, build, rows, outputs, path, **fitting):
        seen.extend(rows.collect())
        return trials.read(spark, path)

    monkeypatch.setattr(runs, "_topic_rows", lambda spark, d: (docs, found))
    monkeypatch.setattr(trials, "run_whole", run_whole)
    monkeypatch.setattr(runs, "_best", lambda *_: neural.MLP(2, 2))
    assert runs.q_topics_mlp(spark, "").count() == 18_000
    assert sorted(r["key"] for r in seen) == [i for i in range(9_000) if i % 3 < 2]
    assert 0.17 < np.mean([r["held"] for r in seen]) < 0.23


def test_each_label_has_a_row_to_learn_from(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(200)] + [(200, None)], "key long, label int")
    own, labels = models.held_out(rows, "key")
    got = own.collect()
    assert labels == 100 and len(got) == 200 and {r["label"] for r in got if not r["held"]} == set(range(100))


@pytest.mark.parametrize("rows_a_task", [10_000, 500])
def test_whole_trials_learn_and_are_recorded(spark, tmp_path, rows_a_task):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 3_000)
    x = np.eye(3)[label] + rng.normal(size=(3_000, 3)) * 0.2
    rows = spark.createDataFrame([(i, v.tolist(), int(c), i % 5 == 0) for i, (v, c) in enumerate(zip(x, label, strict=True))], "key long, x array<double>, label int, held boolean")
    settings, make = trials.draws(trials.MLP_GRID, 2), trials.mlp(3, 3, 0.1)
    done = trials.run_whole(spark, settings, make, rows, 3, f"{tmp_path}/trials", epochs=8, batch=64, rows_a_task=rows_a_task)
    assert done.count() == 2 and trials.history(done).count() == 16
    for s in settings:
        model = trials.restored(done, s, make)
        held = np.arange(3_000) % 5 == 0
        y = np.eye(3)[label]
        record = done.where(done.model == trials.name(s)).first()
        assert record["val_loss"] == pytest.approx(neural.cross_entropy(model.predict(x[held]), y[held]), rel=1e-9)
        assert record["f1"] == pytest.approx(trials.micro_f1(model.predict(x[held]), y[held]), rel=1e-9) and record["f1"] > 0.9
    again = trials.run_whole(spark, settings, make, rows, 3, f"{tmp_path}/trials", epochs=8, batch=64)
    assert again.count() == 2
