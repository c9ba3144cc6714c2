"""Loops written out plainly against the relational forms, folds on hand-made cases, and invariants of models."""

import zipfile

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.models import neural, trials
from textloom.operators import extract, labels, metrics, parts, passages
from textloom.operators import postings as P
from textloom.sources import archive


def _tokens(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["t"] for r in rows.select("doc_id", X.word_tokens(F.col("text")).alias("t")).orderBy("doc_id").collect()]


def test_word_tokens(spark):
    got = _tokens(spark, ["...", ",,a,b!", "5.", "1,234;", "nan", "$5", "abcdefgh-bcdefghi-cdefg-hij", "x" * 40, "fig.", "", "Hello, (World)"])
    assert got[1:] == [[",,", "a,b", "!"], ["num_indic"], ["num_indic"], ["num_indic"], ["curr_indic"], ["chem_indic"], ["chem_indic"], ["fig."], [], ["hello", ",", "world"]]
    assert "".join(got[0]) == "..."


def test_bigrams_bridge_stopwords(spark):
    rows = spark.createDataFrame([("Deep in the Water, water",), ("the",), ("",)], "text string")
    tokens = X.simple_tokens(F.col("text"))
    assert [list(r) for r in rows.select(tokens, X.bigrams(tokens)).collect()] == [[["deep", "water", "water"], ["deep water", "water water"]], [[], []], [[], []]]


def test_chunks(spark):
    for p in (3, 4, 23):
        rows = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in (0, 1, 2, 3, 4, 22, 23, 24, 100)], "n int, t array<string>")
        for r in rows.select("n", parts.chunks(F.col("t"), p).alias("c")).collect():
            n, q = r["n"], r["n"] // p
            want = [list(range(n))] + [[]] * (p - 1) if n < p else [list(range(i * q, n if i == p - 1 else (i + 1) * q)) for i in range(p)]
            assert [[int(x) for x in c] for c in r["c"]] == want


def test_slots():
    assert [len(parts.slots(level)) for level in (1, 2, 3)] == [1, 4, 34]
    assert [s[3] for s in parts.slots(3) if s[0] == 2] == [1, 5, 29]


def test_split_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), "subclass", f"l{rng.integers(12)}") for d in range(300) for _ in range(rng.integers(1, 4))]
    frame = spark.createDataFrame(sorted(set(rows)), "doc_id long, level string, label string")
    got = {r["doc_id"]: r["split"] for r in labels.split(frame).collect()}
    docs_of, want = {}, {}
    for d, _, label in set(rows):
        docs_of.setdefault(label, set()).add(d)
    for label in sorted(docs_of, key=lambda x: (len(x), x)):
        left = sorted((d for d in docs_of[label] if d not in want), key=lambda d: (d * 2654435761 % 1000003, d))
        n = len(left)
        test = n // 5 or int(n > 1)
        r = n - test
        val = r // 5 or int(r > 1)
        want |= {d: "test" for d in left[:test]} | {d: "validation" for d in left[test : test + val]} | {d: "training" for d in left[test + val :]}
    assert got == want


def _scores(spark, true, pred, score=None):
    rows = [(d, k, int(t), float(score[d][k]) if score is not None else float(pred[d][k]), int(pred[d][k])) for d, row in enumerate(true) for k, t in enumerate(row)]
    return spark.createDataFrame(rows, "doc_id long, label_id int, y_true int, y_score double, y_pred int")


def _ranked_confusion(true, pred):
    """By the stated rule, from ranks: the missed label of rank k pairs with the false one of rank 2 k."""
    n = true.shape[1]
    out = np.zeros((n + 1, n + 1), int)
    hit, missed, false = true & pred, true & ~pred, pred & ~true
    out[np.arange(n), np.arange(n)] = hit.sum(0)
    for m, f in zip(missed, false, strict=True):
        wrong = dict(enumerate(np.flatnonzero(f)))
        pairs = [(label, wrong.pop(2 * rank, n)) for rank, label in enumerate(np.flatnonzero(m))]
        for at in [*pairs, *((n, label) for label in wrong.values())]:
            out[at] += 1
    return out


def _confusion(spark, true, pred):
    n = true.shape[1]
    got = np.zeros((n + 1, n + 1), int)
    for r in metrics.confusion(_scores(spark, true, pred)).collect():
        got[n if r["true_label"] is None else r["true_label"], n if r["pred_label"] is None else r["pred_label"]] = r["n"]
    return got


def test_confusion_by_ranks(spark):
    rng = np.random.default_rng(4)
    golden = (np.array([[1, 0, 0], [1, 0, 1], [0, 1, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1]]) > 0, np.array([[0, 1, 0], [1, 0, 0], [0, 0, 1], [0, 1, 0], [1, 0, 1], [1, 0, 1]]) > 0)
    for true, pred in (golden, (rng.random((60, 7)) < 0.5, rng.random((60, 7)) < 0.5)):
        assert (_confusion(spark, true, pred) == _ranked_confusion(true, pred)).all()


def test_confusion_by_hand(spark):
    """Two missed and three false: the first misses pair with the first and the third false one."""
    true, pred = np.array([[1, 1, 0, 0, 0, 1]]) > 0, np.array([[0, 0, 1, 1, 1, 1]]) > 0
    assert np.argwhere(_confusion(spark, true, pred)).tolist() == [[0, 2], [1, 4], [5, 5], [6, 3]]


def test_top_n_with_ties(spark):
    rng = np.random.default_rng(5)
    true, score = rng.integers(0, 2, (40, 6)), rng.integers(0, 4, (40, 6)) / 4
    for n in (1, 3, 5):
        hits = 0
        for t, s in zip(true, score, strict=True):
            order = sorted(range(6), key=lambda i: (-s[i], -i))
            hits += sum(t[i] for i in order[: max(n, t.sum())])
        got = metrics.top_n(_scores(spark, true, true, score), n).first()["share"]
        assert abs(got - hits / true.sum()) < 1e-12


def test_weights_guard_their_logarithms(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i else "alpha gamma") for i in range(8)], "doc_id long, text string")
    splits = docs.select("doc_id", F.when(F.col("doc_id") < 2, "training").otherwise("test").alias("split"))
    rows = P.weights(P.postings(docs), P.sized(docs, splits)).collect()
    assert all(r["tf_idf"] == 0.0 and r["bm25"] == 0.0 for r in rows if r["term"] == "alpha" and r["split"] == "test")


def _one(spark, expression, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paragraphs_of_trees(spark):
    tree = "<d>\n<heading>Title</heading><p>Text <!-- no -->of\nit.</p> beside <ul><li>one <b>bold</b>\n tail</li><li>two;</li></ul><description-of-drawings>none<heading>H</heading><p>is shown</p><p>fig two</p></description-of-drawings><p> </p></d>"
    rows = spark.createDataFrame([(1, tree), (2, "<broken"), (3, None)], "k long, v string")
    got = [tuple(r) for r in passages.paragraphs_of(rows, "k", "v", join_sentences=False).collect()]
    assert got == [(1, 0, "Title Text of it. one. bold\n tailtwo."), (1, 1, "H is shown fig two. ")]
    page = "<html><script>var p='<p>'</script><h1>A title</h1>x<p>Some <i>text</i> &amp; more<ul><li>one<li>two</ul><p></p></html>"
    found = passages.paragraphs_of(spark.createDataFrame([(1, page)], "k long, v string"), "k", "v", html=True, join_sentences=False)
    assert [r["paragraph"] for r in found.collect()] == ["A title Some text & more one. two."]


def test_sentences(spark):
    assert _one(spark, passages.raw_sentences, ["See fig. 2 for it. Then Go.", "", "One! (Two) U.S. Army. \"Three?\" 4"], "string") == [["See fig. 2 for it.", "Then Go."], [], ["One!", "(Two) U.S. Army.", "\"Three?\"", "4"]]
    x, y = "x" * 60, "y" * 60
    lists = [["1.", x], [], [x, "short", y], ["a", "b"], ["z" * 45, "z" * 10, x], [x, "1.2.3.4 " * 9], ["  ", y]]
    assert _one(spark, passages.enforce_length, lists, "array<string>") == [[" 1. " + x], [], [x + " short", y], [" a b"], [" " + "z" * 45 + " " + "z" * 10, x], [x + " " + ("1.2.3.4 " * 9).strip()], [y]]


def test_single_sentences_are_joined(spark):
    one, two = lambda c: c * 60, lambda c: c.upper() * 60 + ". " + c.upper() * 60 + "."
    lists = [[one("a") + ".", one("b") + "."], [one("a"), two("b"), one("c")], [two("a"), one("b"), two("c"), one("d"), one("e")], [one("a")], [], [two("a"), "", one("b"), two("c")]]
    want = [
        [one("a") + ". " + one("b") + "."],
        [one("a") + ". " + two("b").strip(".") + ". " + one("c")],
        [two("a").strip(".") + ". " + one("b"), two("c"), one("d") + ". " + one("e")],
        [one("a")],
        [],
        [two("a"), "", one("b") + ". " + two("c")],
    ]
    assert _one(spark, passages.joined_singles, lists, "array<string>") == want


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab. AB1", max_size=90), max_size=8), max_size=60))
def test_length_rule_loses_no_word(spark, lists):
    for before, after in zip(lists, _one(spark, passages.enforce_length, lists, "array<string>") if lists else [], strict=True):
        assert "".join("".join(after).split()) == "".join("".join(before).split())


def test_archive_to_patents(spark, tmp_path):
    inner = "us-bibliographic-data-grant"
    one = (
        f"<?xml version='1.0'?><us-patent-grant><{inner}><publication-reference><document-id><country>US</country><doc-number>00{{n}}</doc-number></document-id></publication-reference>"
        "<classifications-ipcr><classification-ipcr><section>A</section><class>01</class><subclass>B</subclass><main-group>12</main-group><subgroup>00</subgroup></classification-ipcr></classifications-ipcr>"
        "<parties><applicants><applicant><addressbook><last-name>Last</last-name><first-name>First</first-name><city>C</city><country>US</country></addressbook></applicant></applicants></parties>"
        f"</{inner}><abstract><p>An <b>abstract</b></p></abstract><description><p>d</p></description><claims><p>c</p></claims></us-patent-grant>\n"
    )
    folder = tmp_path / "2010"
    folder.mkdir()
    with zipfile.ZipFile(folder / "week.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("week.xml", one.replace("{n}", "1") + one.replace("{n}", "2") + "<?xml version='1.0'?><broken>")
    (folder / "bad.zip").write_bytes(b"not a zip")
    raw = archive.documents(archive.unzip(archive.archives(spark, str(tmp_path))))
    assert raw.count() == 3
    rows = extract.patents(raw).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == ["001", "002"]
    assert tuple(rows[0]["ipc"][0]) == ("A", "01", "B") and tuple(rows[0]["inventors"][0]) == ("First", "Last", "C", "US")
    assert "abstract" in rows[0]["abstract_xml"] and "<b>" not in rows[0]["abstract_xml"]


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    for model, x in ((neural.MLP(5, 3, (4,), dropout=0.0), rng.normal(size=(6, 5))), (neural.LSTM(3, 2, units=4, layers=2), rng.normal(size=(4, 5, 3)))):
        y = rng.integers(0, 2, (len(x), 3 if isinstance(model, neural.MLP) else 2)).astype(float)
        for w, g in zip(model.weights, model.gradients(x, y, training=False), strict=True):
            at = tuple(rng.integers(s) for s in w.shape)
            w[at] += 1e-5
            up = neural.cross_entropy(model.predict(x), y)
            w[at] -= 2e-5
            down = neural.cross_entropy(model.predict(x), y)
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    y = (x[:, :2] > 0).astype(float)
    history = neural.fit(neural.MLP(8, 2, (16,), dropout=0.0), x[:200], y[:200], x[200:], y[200:], epochs=40, batch=64, step=5e-3)
    assert history[-1]["val_loss"] < 0.6 * history[0]["val_loss"]


def test_trials_are_seeded():
    assert trials.draws(trials.LSTM_GRID, 10) == trials.draws(trials.LSTM_GRID, 10) and len(trials.draws(trials.LSTM_GRID, 99)) == 24


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    from . import conftest

    shutil.copytree(conftest.ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])"], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.strip().endswith("[]"), said.stderr
