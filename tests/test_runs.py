"""What runs leave for one another, searches that train, and models that go on where they stopped."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.models import neural, topics, trials
from textloom.operators import extract, labels, parts
from textloom.plans import runs
from textloom.sources import archive, stores


def _data(n=240, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 3, n)
    x = np.eye(3)[truth] * 2 + rng.normal(size=(n, 3)) * 0.1
    y = np.eye(3)[truth]
    return x[:180], y[:180], x[180:], y[180:]


def test_trials_are_trained_once_and_found_again(spark, tmp_path):
    settings, data, path = trials.draws(trials.MLP_GRID, 3), _data(), f"{tmp_path}/trials"
    build = trials.mlp(3, 3, 0.01)
    first = trials.run(spark, settings[:2], build, data, path, epochs=30, batch=32, step=0.01)
    kept = {r["model"]: r for r in first.collect()}
    done = trials.run(spark, settings, build, data, path, epochs=30, batch=32, step=0.01)
    rows = {r["model"]: r for r in done.collect()}
    assert set(rows) == {trials.name(s) for s in settings} and done.count() == 3
    assert all(rows[m]["duration"] == r["duration"] for m, r in kept.items())  # not trained again
    best = trials.best(done).first()
    assert best["f1"] == max(r["f1"] for r in rows.values()) > 0.9
    chosen = next(s for s in settings if trials.name(s) == best["model"])
    model = trials.restored(done, chosen, build)
    assert trials.micro_f1(model.predict(data[2]), data[3]) == best["f1"]
    assert neural.cross_entropy(model.predict(data[2]), data[3]) == pytest.approx(best["val_loss"])
    with pytest.raises(LookupError):
        trials.restored(done, {"first": 1}, build)


def test_history_marks_each_new_least_loss(spark, tmp_path):
    done = trials.run(spark, trials.draws(trials.MLP_GRID, 2), trials.mlp(3, 3, 0.01), _data(), f"{tmp_path}/t", epochs=6)
    for name in [r["model"] for r in done.select("model").collect()]:
        least = np.inf
        for r in trials.history(done).where(F.col("model") == name).orderBy("epoch").collect():
            assert r["best"] == (r["val_loss"] < least)
            least = min(least, r["val_loss"])


@pytest.mark.parametrize("front", [{}, {"filters": 4}, {"filters": 3, "kernel": 2, "pool": 3}])
def test_gradients_of_lstm(front):
    """Against differences, with the masks of dropout drawn alike."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(5, 7, 3)), rng.integers(0, 2, (5, 2)).astype(float)
    model = neural.LSTM(3, 2, units=4, layers=2, dropout=0.3, recurrent=0.4, **front)

    def again():
        model.rng = np.random.default_rng(11)

    again()
    got = model.gradients(x, y)
    assert [g.shape for g in got] == [w.shape for w in model.weights]
    for w, g in zip(model.weights, got, strict=True):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)]:
            kept, losses = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = kept + step
                again()
                losses.append(neural.cross_entropy(model.forward(x, training=True)[0], y))
            w[at] = kept
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


def test_recurrent_dropout_acts_in_training_only():
    x, model = np.random.default_rng(1).normal(size=(4, 5, 3)), neural.LSTM(3, 2, units=6, recurrent=0.5)
    assert np.array_equal(model.predict(x), model.predict(x))
    assert not np.array_equal(model.forward(x, training=True)[0], model.forward(x, training=True)[0])


def test_slots_of_all_levels(spark):
    found = {n: parts.slots(n) for n in (1, 2, 3)}
    assert [len(found[n]) for n in (1, 2, 3)] == [1, 4, 34]
    place = {(level, name, no): slot for level, name, no, slot in found[3]}
    assert (place[1, "document", 0], place[2, "abstract", 0], place[3, "abstract", 1], place[2, "description", 0], place[3, "description", 23], place[2, "claims", 0], place[3, "claims", 4]) == (0, 1, 2, 5, 28, 29, 33)
    rows = [(1, 1, None, None, [1.0]), (1, 3, "claims", 4, [2.0]), (1, 3, "claims", 9, [3.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, level int, part_name string, part_no int, vec array<float>")
    seq = [v[0] for v in parts.sequences_of_level(vectors, 3, 1).first()["seq"]]
    assert seq[0] == 1.0 and seq[33] == 2.0 and sum(seq) == 3.0


def test_documents_without_valid_labels_have_empty_rows(spark):
    own = spark.createDataFrame([(1, "class", "a"), (2, "class", "b")], "doc_id long, level string, label string")
    dim = spark.createDataFrame([("class", "a", True, 4), ("class", "b", False, 5)], "level string, label string, is_valid boolean, ordinal int")
    splits = spark.createDataFrame([(1, "test"), (2, "test")], "doc_id long, split string")
    assert {r["doc_id"]: r["ones"] for r in labels.sparse_matrix(own, dim, splits).collect()} == {1: [4], 2: []}


def test_token_lines_round_trip_and_rerun(spark, tmp_path):
    rows = [("1", "a b", "training", 1, "x"), ("2", None, "test", 1, "x"), ("3", "", "test", 2, "y")]
    stores.write_lines(spark.createDataFrame(rows, stores.PART_SCHEMA), str(tmp_path))
    assert list(tmp_path.rglob("*.gz"))
    stores.write_lines(spark.createDataFrame([("4", "c", "training", 1, "x")], stores.PART_SCHEMA), str(tmp_path))  # only its own folder
    got = stores.read_lines(spark, str(tmp_path))
    assert {(r["id"], r["rest"], r["split"]) for r in got.collect()} == {("4", "c", "training"), ("2", "", "test"), ("3", "", "test")}
    plan = got.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_batches_and_files_by_number(spark, tmp_path):
    stores.write_batches(spark.range(25).toDF("id"), f"{tmp_path}/b", "id", 10)
    assert {r["batch"] for r in stores.batches_from(spark, f"{tmp_path}/b", 10).collect()} == {10, 20}
    for n in (10, 9, 1):
        (tmp_path / f"part-{n}.txt").write_text("x" * n)
    files = stores.files_in_order(spark, str(tmp_path), "part-*.txt").orderBy("place").collect()
    assert [(r["name"], r["n_bytes"]) for r in files] == [("part-1.txt", 1), ("part-9.txt", 9), ("part-10.txt", 10)]


def test_lookup_answers_each_question(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(r["v"] for r in stores.lookup(spark.createDataFrame([(1,), (1,), (3,)], "k long"), store, "k").collect()) == ["a", "a"]


def test_latest_write_of_each_key(spark):
    rows = [(1, 5, "a", None), (1, 7, "b", None), (2, 1, "c", [1]), (None, 1, "d", None)]
    got = archive.latest(spark.createDataFrame(rows, "k long, at long, v string, x array<long>"), "k", "at")
    assert got.columns == ["k", "at", "v", "x"] and {r["v"] for r in got.collect()} == {"b", "c", "d"}


def test_broken_documents_are_set_aside(spark):
    rows = [("p", 0, 4, "<us-patent-grant><abstract>x</abstract></us-patent-grant>"), ("p", 1, 4, "<us-patent-grant><abstract>")]
    raw = spark.createDataFrame(rows, "path string, seq int, dtd_version int, xml string")
    bad = extract.rejected(raw).collect()
    assert [(r["seq"], r["xml"]) for r in bad] == [(1, rows[1][3])] and bad[0]["error"]


def test_topics_are_stored_under_their_name(spark, tmp_path, sf_dir):
    _, found = runs._topic_rows(spark, sf_dir, str(tmp_path))
    assert (tmp_path / topics.name("bm25", 8, 5, 0.5)).is_dir()
    assert abs(sum(found.first()["topics"]) - 1) < 1e-6


def _zip(content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.XML", content)
    return out.getvalue()


def test_archives_give_one_document_at_a_time(spark, tmp_path):
    (tmp_path / "2004").mkdir()
    (tmp_path / "2005").mkdir()
    one, two = '<?xml version="1.0"?>\n<a>é</a>\n', '<?xml version="1.0"?><b/>'
    (tmp_path / "2004" / "x.zip").write_bytes(_zip((one + two + "\n" + one).encode()))
    (tmp_path / "2005" / "y.zip").write_bytes(_zip(two.encode()))
    (tmp_path / "2005" / "z.zip").write_bytes(b"broken")
    files = archive.archives(spark, str(tmp_path))
    got = archive.split_archives(files)
    want = archive.documents(archive.unzip(files))
    key = lambda r: (r["path"], r["year"], r["dtd_version"], r["xml"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert sorted((r["year"], r["seq"]) for r in got.collect()) == [(2004, 0), (2004, 1), (2004, 2), (2005, 0)]
