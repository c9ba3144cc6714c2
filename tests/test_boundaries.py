"""Learned sentence boundaries against a plain version, word by word."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.operators import boundaries, passages
from textloom.plans import learned  # noqa: F401  registers its queries
from textloom.plans.catalog import QUERIES

AROUND = "\"'()[]{}“”‘’"


def words(text):
    out = []
    for piece in re.findall("[^ \t-\r]+[ \t-\r]*", text or ""):
        c = piece.rstrip(" \t\n\x0b\x0c\r").strip(AROUND)
        kind = "dots" if c.endswith("..") else "mark" if re.search("[?!][.?!]*$", c) else "period" if c.endswith(".") else "plain"
        form = re.sub("([.][.]+|[?!][.?!]*|[.])$", "", c).rstrip(",;:").lower()
        first = c[:1]
        case = "none" if first.upper() == first.lower() else "lower" if first == first.lower() else "upper"
        out.append((piece, kind, "##number##" if re.fullmatch("[0-9][0-9.,:/-]*", form) else form, case))
    return out


def likelihood(k, n, p):
    return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)


def association(k, n1, n2, n):
    p, p1, p2 = n2 / n, k / n1, (n2 - k) / max(n - n1, 1)
    if p1 <= p:
        return 0.0
    return -2 * (likelihood(k, n1, p) + likelihood(n2 - k, n - n1, p) - likelihood(k, n1, p1) - likelihood(n2 - k, n - n1, p2))


class Plain:
    """The whole method over a list of texts."""

    def __init__(self, texts, given):
        told = [words(t) for t in texts]
        stop = Counter(w[2] for t in told for w in t if w[1] == "period")
        every = Counter(w[2] for t in told for w in t)
        n = sum(every.values())
        share = sum(stop.values()) / n
        self.short = {}
        for w, k in stop.items():
            if w == "##number##" or not any(c.isalpha() for c in w):
                continue
            dots, c = w.count("."), every[w]
            length = len(w) - dots
            score = -2 * (likelihood(k, c, share) - likelihood(k, c, 0.99)) * math.exp(-length) * (dots + 1) * float(length) ** -(c - k)
            if score >= 0.3:
                self.short[w] = score
        learned = set(self.short)
        self.short = {**dict.fromkeys(given), **self.short}
        self.learned = learned
        self.upper_inside, self.lower_start, self.upper, self.lower, after, pairs = (Counter() for _ in range(6))
        for t in told:
            for i, (_, _, w, case) in enumerate(t):
                _, kind, before, _ = t[i - 1] if i else (None, "start", None, None)
                ends = kind in ("mark", "start") or (kind == "period" and before not in self.short)
                self.upper[w] += case == "upper"
                self.lower[w] += case == "lower"
                self.upper_inside[w] += case == "upper" and kind == "plain"
                self.lower_start[w] += case == "lower" and ends
                if kind == "period":
                    after[w] += before not in self.short
                    initial = len(before) == 1 and before.isalpha()
                    if (before in self.short or initial or before == "##number##") and w[:1].isalpha():
                        pairs[before, w] += 1
        total = sum(after.values())
        self.starters = {w: s for w, k in after.items() if k and w[:1].isalpha() and (s := association(k, total, every[w], n)) >= 30}
        self.goes_on = {p: s for p, k in pairs.items() if k > 1 and p[1] not in self.starters and (s := association(k, every[p[0]], every[p[1]], n)) >= 7.88}

    def ends(self, one, two):
        _, kind, w, _ = one
        _, _, then, case = two
        if kind in ("plain", "mark"):
            return kind == "mark"
        if kind == "period" and (w, then) in self.goes_on:
            return False
        initial = len(w) == 1 and w.isalpha()
        if kind == "dots" or w in self.short:
            if initial and kind == "period":
                return False
            return case == "upper" and ((self.lower[then] > 0 and self.upper_inside[then] == 0) or then in self.starters)
        if initial or w == "##number##":
            return not (case == "lower" and (self.upper[then] > 0 or self.lower_start[then] == 0))
        return True

    def sentences(self, text):
        out, now = [], ""
        told = words(text)
        for i, w in enumerate(told):
            now += w[0]
            if i + 1 == len(told) or self.ends(w, told[i + 1]):
                out.append(now.strip(K.WHITE))
                now = ""
        return [s for s in out if s]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}


def test_query_on_the_whole_table(spark, texts):
    plain = Plain(texts.values(), K.ABBREVIATIONS)
    rows = QUERIES["q_boundaries"](spark, "/root/testdata/sf0.01").collect()
    table = lambda k: {(r["word"], r["next"]) if k == "collocation" else r["word"]: r["score"] for r in rows if r["table"] == k}
    for kind, want in (("abbreviation", plain.short), ("starter", plain.starters), ("collocation", plain.goes_on)):
        got = table(kind)
        assert got.keys() == want.keys()
        assert all((s is None and want[w] is None) or s == pytest.approx(want[w], rel=1e-9) for w, s in got.items())
    found = QUERIES["q_learned_sentences"](spark, "/root/testdata/sf0.01").collect()
    cut = {i: plain.sentences(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_raw"] for r in found} == {i: len(s) for i, s in cut.items()}
    given = spark.createDataFrame(list(cut.items()), "doc_id long, s array<string>").select("doc_id", F.array_join(passages.enforce_length(F.col("s")), "|").alias("s")).collect()
    assert {r["doc_id"]: r["digest"] for r in found} == {r["doc_id"]: hashlib.md5(r["s"].encode()).hexdigest() for r in given}


LEARNING = [
    *["Dr. Smith met Mr. Jones at St. Mary. The door was open. He left. The rain fell." for _ in range(12)],
    *["They saw Dr. Brown and Mr. Green. The end came. He said so... Then it rained! Really? yes. He left the door." for _ in range(12)],
    *["the rain came and fell on so open a mary that all left the door they saw" for _ in range(12)],
    "On p. 5. we read No. 7 of J. Smith et al. The text ends here.\tIt does.  ",
    "the mary then \"he left.\" The (door). lower 3. word 4. Next",
]


def test_what_is_learned_and_cut(spark):
    """Words with full stops that nobody has listed are abbreviations; sentences keep their white space inside."""
    rows = list(enumerate(LEARNING)) + [(100, None), (101, ""), (102, "  "), (103, "one"), (104, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("type", F.lit("clash")).withColumn("at", F.lit(1))
    found = boundaries.learn(docs, given=("al",))
    plain = Plain([t for _, t in rows], ("al",))
    short = {r["type"] for r in found.abbreviations.collect()}
    assert short ^ set(plain.short) == set()
    assert {"dr", "mr", "al"} <= short and not {"open", "left", "fell"} & short
    assert {r["type"] for r in found.starters.collect()} == set(plain.starters)
    assert {(r["type"], r["next"]) for r in found.collocations.collect()} == set(plain.goes_on)
    got = {r["doc_id"]: r["sentences"] for r in boundaries.sentences_of(docs, "doc_id", found).collect()}
    assert got == {i: plain.sentences(t) for i, t in rows}
    assert got[0] == ["Dr. Smith met Mr. Jones at St. Mary.", "The door was open.", "He left.", "The rain fell."]
    assert got[100] == got[101] == got[102] == [] and got[103] == ["one"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = boundaries.learn(docs, given=("fig",))
    assert [r["type"] for r in found.abbreviations.collect()] == ["fig"] and found.starters.count() == found.collocations.count() == 0
    assert boundaries.sentences_of(docs, "doc_id", found).count() == 0


def test_only_words_that_may_end_a_sentence_are_matched(spark):
    """The same tokens as by matching every word, line ends behind marks included."""
    words = ["", "a", "A.", "U.S.", "end..", "end?.", "1.5", "12:30.", "1st", "x.\u2028", "x..\u2028", "x?\x85", "12\u2029", '("Tea.")', ".", "...", "?!", "7,", "\u00e9t\u00e9;", "a.b"]
    rows = spark.createDataFrame([(i, w + tail) for i, w in enumerate(words) for tail in ("", " ", "\n\x0b\t ")], "k int, w string")

    def plain(piece):
        c = F.btrim(F.regexp_replace(piece, "[ \\t-\\r]+$", ""), F.lit(boundaries.MARKS_AROUND))
        kind = F.when(c.rlike("[.][.]$"), "dots").when(c.rlike("[?!][.?!]*$"), "mark").when(c.endswith("."), "period").otherwise("plain")
        form = F.lower(F.rtrim(F.regexp_replace(c, "([.][.]+|[?!][.?!]*|[.])$", ""), F.lit(boundaries.MARKS_BEHIND)))
        return kind, F.when(form.rlike("^[0-9][0-9.,:/-]*$"), boundaries.NUMBER).otherwise(form)

    kind, form = plain(F.col("w"))
    got = rows.withColumn("t", boundaries.token(F.col("w")))
    assert got.where(~(F.col("t.kind").eqNullSafe(kind) & F.col("t.type").eqNullSafe(form))).collect() == []
    assert str(boundaries.token(F.col("w"))).count("regexp_replace") == 1


def test_abbreviations_alone_are_those_of_all_that_is_learned(spark):
    """And no pair of words is made or written for them."""
    docs = spark.createDataFrame([*enumerate(LEARNING), (100, None), (101, " .. x.\u2028 12. ")], "doc_id long, text string")
    got, want = ({tuple(r) for r in x.collect()} for x in (boundaries.learn_abbreviations(docs), boundaries.learn(docs, given=()).abbreviations))
    assert got == want and {"dr", "mr"} <= {r[0] for r in got}
    assert "transform" not in boundaries.type_counts(docs)._jdf.queryExecution().executedPlan().toString()
