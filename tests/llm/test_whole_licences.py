"""Licence labels by brute force; they must not depend on what else a file holds."""

import math
import random
import re

import pytest

from textloom.llm import license_scan, queries

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _heaviest(template, words, idf):
    """Largest weight of a common subsequence, by the plain recurrence."""
    row = [0.0] * (len(words) + 1)
    for t in template:
        before, row = row, [0.0]
        for j, w in enumerate(words):
            row.append(max(before[j + 1], row[j], before[j] + idf[t] if t == w else 0.0))
    return row[-1]


def _stands(phrase, words):
    return f" {' '.join(_words(phrase))} " in f" {' '.join(words)} "


def _lost(label, template, weight, words, low, idf):
    """Whether a larger licence that has the template's words with others between them explains more of the place."""
    whole = sum(idf[w] for w in template)
    for other, passage, keys in license_scan.LICENCES:
        larger = _words(passage)
        if other == label or sum(idf[w] for w in larger) <= whole or _stands(" ".join(template), larger):
            continue
        if _heaviest(template, larger, idf) < license_scan.COVERAGE * whole:
            continue
        here = words[low : low + 2 * license_scan.DRIFT + len(larger)]
        reached = _heaviest(larger, here, idf)
        if reached >= license_scan.COVERAGE * sum(idf[w] for w in larger) and all(_stands(k, here) for k in keys) and reached > weight + 1e-9:
            return True
    return False


def _expected_row(doc_id, text, idf):
    words = _words(text)
    base = [(p, label) for label, phrase in license_scan.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    found, drift = {}, license_scan.DRIFT
    for label, passage, keys in license_scan.LICENCES:
        template = _words(passage)
        whole = sum(idf[w] for w in template)
        if sum(idf[w] for w in template if w in set(words)) < license_scan.COVERAGE * whole - 1e-9:
            continue
        for strip in range(-1 - len(template) // drift, len(words) // drift + 1):
            low = max(0, strip * drift)
            here = words[low : max(low, (strip + 2) * drift + len(template))]
            covered = min(1.0, _heaviest(template, here, idf) / whole)
            if covered >= license_scan.COVERAGE and all(_stands(k, here) for k in keys) and not _lost(label, template, covered * whole, words, low, idf):
                found[label] = max(found.get(label, 0.0), covered)
    starts, names = [p for p, _ in base], {x for _, x in base}
    score = 1.0 if base else max(found.values(), default=0.0)
    return doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | found.keys())), round(score, 9)


def _expected(rows):
    n, sets = len(rows), [set(_words(t)) for _, t in rows]
    idf = {w.decode(): math.log((n + 1) / (sum(w.decode() in s for s in sets) + 1)) + 1 for w in license_scan.template_words()}
    return sorted(_expected_row(i, t, idf) for i, t in rows)


def test_query_by_brute_force(spark):
    """Every column of the registered query over a whole table."""
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((*r[:7], round(r[7], 9)) for r in map(tuple, queries.QUERIES["op1_license_scan"](spark, folder).collect()))
    assert got == _expected(rows)
    assert sum(r[5] != r[6] for r in got) > 10  # labels of the method's own


def test_altered_passages_by_brute_force(spark):
    """Words left out, put in and changed, several licences to a file."""
    rng, rows = random.Random(8), []
    for i in range(60):
        words = []
        for _, passage, _ in rng.choices(license_scan.LICENCES, k=3):
            for w in passage.split():
                chance = rng.random()
                words += [] if chance < 0.02 else ["other", w] if chance < 0.04 else ["changed"] if chance < 0.07 else [w]
            words += ["x"] * rng.randint(0, 30)
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((*r[:7], round(r[7], 9)) for r in map(tuple, license_scan.license_scan(frame).collect()))
    assert got == _expected(rows)


def _weights():
    rng = random.Random(9)
    yield {w: 1.0 for w in license_scan.template_words()}
    for _ in range(6):
        yield {w: 1 + 9 * rng.random() for w in license_scan.template_words()}


def test_each_passage_has_its_own_label_and_those_of_its_parts():
    texts = [(label, _words(text)) for label, text, _ in license_scan.LICENCES]
    for idf in _weights():
        index = license_scan.LicenseIndex({w: x for w, x in idf.items()})
        for label, words in texts:
            parts = {other for other, part in texts if _stands(" ".join(part), words)}
            for before, after in ((0, 0), (5, 40), (200, 3)):
                text = ["x"] * before + words + ["y"] * after
                found = index.scan([w.encode() for w in text])[1]
                assert found.keys() == parts and label in found, (label, found)


def test_licences_of_two_and_three_clauses_side_by_side():
    by = {label: _words(text) for label, text, _ in license_scan.LICENCES if label.startswith("bsd-")}
    for idf in _weights():
        index = license_scan.LicenseIndex(idf)
        for order in (("bsd-2-clause", "bsd-3-clause"), ("bsd-3-clause", "bsd-2-clause")):
            for gap in (0, 1, 7, 15, 40):
                text = by[order[0]] + ["x"] * gap + by[order[1]]
                assert index.scan([w.encode() for w in text])[1].keys() == {*order, "bsd"}


def test_the_start_of_another_licence_is_no_label():
    boost = next(_words(text) for label, text, _ in license_scan.LICENCES if label == "bsl-1.0")
    for idf in _weights():
        index = license_scan.LicenseIndex(idf)
        for n in range(10, len(boost)):
            assert index.scan([w.encode() for w in boost[:n]])[1].keys() <= {"bsl-1.0"}


def test_licences_beside_others():
    """A bundle of all passages keeps every label, whatever the words weigh."""
    rng = random.Random(7)
    bundle = license_scan.words_of(" and then ".join(text for _, text, _ in license_scan.LICENCES).encode())
    for _ in range(5):
        index = license_scan.LicenseIndex({w: 1 + 9 * rng.random() for w in license_scan.template_words()})
        found = index.scan(bundle)[1]
        assert found.keys() == {label for label, _, _ in license_scan.LICENCES} and min(found.values()) == pytest.approx(1.0)


def test_own_templates(spark):
    frame = spark.createDataFrame([(1, "Use it as you like, said Jane B. Doe, but name the makers of this fine work.")], "doc_id long, text string")
    own = [("house", "use it as you like but name the makers of this work", ["name the makers"])]
    assert license_scan.license_scan(frame, own).first()["labels"] == "house"
