"""Terms that are made, counted and packed in Arrow: as plain Python has them, and not a row a posting in the shuffle."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.operators import packs
from textloom.operators import postings as P

TEXTS = ["Green tea, GREEN tea!", None, "", " \x0b\x1c \x1cmilk\x1c ", "the and", "Éa b c\x85 İx ß", "a" * 5000 + " b", "--milk-- tea\n\ntea\ttea\x00", "tea " * 300] * 3


def plain(text):
    words = [w.decode() for w in (x.strip(K.PUNCTUATION.encode()) for x in (text or "").lower().encode().split())]
    words = [w for w in words if w and w not in K.STOPWORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def documents(spark):
    rows = [(i, t, ("x", "y", None)[i % 3]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, class string")


@pytest.fixture(params=[4_000_000, 10])
def small(request, monkeypatch):
    """Slices of many rows, and of one row each."""
    monkeypatch.setattr(packs.slices, "__defaults__", (request.param,))


def test_counts_are_those_of_plain_python(small):
    lists = pa.array([[(t or "").lower()] if t is not None else [None] for t in TEXTS], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(range(len(TEXTS)))], ["texts", "doc_id"]).slice(2)
    got = {}
    for part in packs.postings(["doc_id"], K.STOPWORDS)(iter([batch])):
        for term, doc, tf in zip(*(c.to_pylist() for c in part.columns), strict=True):
            assert got.setdefault(doc, Counter())[term] == 0
            got[doc][term] = tf
    assert got == {i: c for i, t in enumerate(TEXTS) if i >= 2 and (c := plain(t))}


def test_pairs_do_not_bridge_the_texts_of_a_row():
    found, row = packs.terms(pa.array([["a1 b1", "c1"], ["d1"]]), [])
    assert sorted(zip(found.to_pylist(), row.tolist(), strict=True)) == [("a1", 0), ("a1 b1", 0), ("b1", 0), ("c1", 0), ("d1", 1)]


def test_class_counts(spark):
    want = Counter()
    for i, t in enumerate(TEXTS):
        want.update((w, ("x", "y", None)[i % 3]) for w in plain(t))
    for more_than in (0, 3):
        df = Counter()
        for (w, _), a in want.items():
            df[w] += a
        got = [((r["term"], r["class"]), r["a"]) for r in P.class_counts(documents(spark), more_than).collect()]
        assert dict(got) == {k: a for k, a in want.items() if df[k[0]] > more_than} and len(got) == len(dict(got))


def test_what_is_shuffled_are_packs(spark):
    """Far fewer rows than postings, of terms that are counted where they are made."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("tea milk x"), F.col("id").cast("string")).alias("text"), F.lit("x").alias("class")).coalesce(1)
    plan = P.class_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "hashpartitioning(bucket" in plan
    sized = P.sized(docs.drop("class"))
    plan = P.weights_of(sized, ("tf_idf",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "hashpartitioning(bucket" in plan


def test_weights_of_documents_are_those_of_their_postings(spark):
    docs = P.sized(documents(spark).drop("class")).withColumn("split", F.when(F.col("doc_id") % 4 > 0, F.when(F.col("doc_id") % 4 == 1, "test").otherwise("training")))
    one, two = ({(r["doc_id"], r["term"]): tuple(r) for r in x.collect()} for x in (P.weights_of(docs), P.weights(P.postings(docs), docs)))
    assert one == two and len(one) > 20


def test_packs_of_numbers_are_pressed(spark):
    """Fewer bytes than the numbers of their postings alone take; nulls and columns of other types come back as they were."""
    rows = spark.createDataFrame([(f"w{i % 900}", None if i % 7 == 0 else i // 30, ["a", "b"][i % 2], 10 + i // 30, f"s{i % 5}", 1 + i % 3) for i in range(30_000)], "term string, doc_id long, split string, len long, note string, tf long").coalesce(1)
    columns = ["doc_id", "split", "len", "note", "tf"]
    fixed = P._fixed(rows, columns)
    assert fixed == {"doc_id": "i8", "split": "i4", "len": "i8", "tf": "i8"}
    sent = rows.mapInArrow(packs.packed_rows(columns, 8, fixed), P._pressed(rows, columns, fixed))
    assert sent.agg(F.sum(F.length("pack"))).first()[0] < 30_000 * 28 / 4
    found = P._met(sent, columns, P._kinds(rows, columns), 2, fixed)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.drop("df").collect()), key=key) == sorted(map(tuple, rows.collect()), key=key)
