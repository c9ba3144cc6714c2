"""License scans by a positional index over rare template words.

Templates are passages of public licences with mandatory key phrases (`licence_texts`, or the caller's own), and the
bare phrases of `PHRASES`.  The words of all templates are weighed by inverse document frequency over the whole table.
Of each template only rare words are indexed, with their positions.  All indexed words of a file are looked up; each
posting votes for the strip of places where the template would have to start, so that postings are intersected by
relative position, give or take some words put in or left out.  Strips that gather the weight without which COVERAGE is
out of reach are compared word by word, in order, and a label is given only if the template's key phrases stand there
word for word.  Where a template is found inside another one that has words in its midst too (a licence of two clauses
in one of three) and that one is verified over the same place with more weight, only the larger keeps the place; a
passage that stands in the other without a gap is a part of it and keeps its label.  What a template gets does not depend
on what a file holds elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8
from .licence_texts import LICENCES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Bare phrases: each place where the words stand consecutively counts.  Fixed values.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Of a passage, so many of its rarest words are indexed, or more until they outweigh what may be missing.
INDEXED_WORDS = 6
#: Share of a passage's IDF weight that must stand in its order.
COVERAGE = 0.8
#: Words by which relative positions of one place may differ: words put in or left out in its midst.
DRIFT = 16

Template = tuple[str, str, list[str]]


class LicenseIndex:
    """Postings of the rare words of all passages."""

    def __init__(self, idf: dict[bytes, float], templates: list[Template] = LICENCES):
        self.idf = idf
        self.phrases = [(label, text.encode().split()) for label, text in PHRASES.items()]
        #: word -> phrases of which it is the rarest word, with its place there
        self.phrase_anchor: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for p, (_, words) in enumerate(self.phrases):
            at = max(range(len(words)), key=lambda i: (idf[words[i]], -i))
            self.phrase_anchor[words[at]].append((p, at))
        self.templates, self.postings = [], defaultdict(list)
        for t, (label, text, keys) in enumerate(templates):
            words = words_of(text.encode())
            weights = np.array([idf[w] for w in words])
            whole, rare = float(weights.sum()), set()
            may_miss = (1 - COVERAGE) * whole
            for w in sorted(set(words), key=lambda w: (-idf[w], w)):
                if len(rare) >= INDEXED_WORDS and sum(idf[w] for w in words if w in rare) >= 2 * may_miss:
                    break
                rare.add(w)
            for i, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, i))
            # a place that reaches COVERAGE has at least this weight of indexed words
            least = sum(idf[w] for w in words if w in rare) - may_miss - 1e-9
            self.templates.append((label, words, weights, [words_of(k.encode()) for k in keys], whole, least))
        self.larger = [self._larger(t) for t in range(len(self.templates))]
        self.looked_up = frozenset(self.phrase_anchor) | frozenset(self.postings)

    def _larger(self, t: int) -> list[int]:
        """Templates of other labels that hold the words of template t in order, but with others between them."""
        label, words, weights, _, whole, _ = self.templates[t]
        others = [u for u, x in enumerate(self.templates) if x[0] != label and x[4] > whole and not stands(words, x[1])]
        return [u for u in others if in_order(words, weights, self.templates[u][1]) >= COVERAGE * whole]

    def _weight(self, t: int, words: list[bytes], low: int) -> float:
        """The weight of template t in the words from `low` on, 0 if it is not verified there."""
        _, template, weights, keys, whole, _ = self.templates[t]
        passage = words[low : low + 2 * DRIFT + len(template)]
        weight = min(whole, in_order(template, weights, passage))
        return weight if weight / whole >= COVERAGE and all(stands(k, passage) for k in keys) else 0.0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of the bare phrases as (start, label), and the best coverage of each label found."""
        present = self.looked_up.intersection(words)
        if not present:
            return [], {}
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        base = []
        for w in present & self.phrase_anchor.keys():
            for p, at in self.phrase_anchor[w]:
                label, phrase = self.phrases[p]
                base += [(i - at, label) for i in places[w] if i >= at and words[i - at : i - at + len(phrase)] == phrase]
        # relative positions are counted in strips of DRIFT; those of one place lie in a strip and the next
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for w in sorted(present & self.postings.keys()):
            for t, at in self.postings[w]:
                for strip in {s for i in places[w] for s in ((i - at) // DRIFT, (i - at) // DRIFT - 1)}:
                    votes[t, strip] += self.idf[w]
        found: dict[str, float] = {}
        for (t, strip), weight in sorted(votes.items()):
            label, template, _, _, whole, least = self.templates[t]
            low, high = max(0, strip * DRIFT), (strip + 2) * DRIFT + len(template)
            if weight < least or high <= low or found.get(label, 0.0) >= 1.0:
                continue
            reached = self._weight(t, words[: max(low, high)], low)
            if reached and not any(self._weight(u, words, low) > reached + 1e-9 for u in self.larger[t]):
                found[label] = max(found.get(label, 0.0), reached / whole)
        return base, found


def stands(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[j : j + len(phrase)] == phrase for j in range(len(words) - len(phrase) + 1))


def in_order(template: list[bytes], weights: np.ndarray, passage: list[bytes]) -> float:
    """The largest weight of template words that stand in the passage in their order."""
    if template == passage[: len(template)]:
        return float(weights.sum())
    numbers = {w: n for n, w in enumerate(dict.fromkeys(template))}
    there = np.array([numbers.get(w, -1) for w in passage])
    best = np.zeros(len(passage) + 1)
    for w, weight in zip(template, weights, strict=True):
        taken = np.where(there == numbers[w], best[:-1] + weight, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1])


def template_words(templates: list[Template] = LICENCES) -> list[bytes]:
    texts = [*PHRASES.values(), *(x for _, text, keys in templates for x in (text, *keys))]
    return sorted({w for text in texts for w in words_of(text.encode())})


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z only


def inverse_document_frequencies(docs: DataFrame, templates: list[Template] = LICENCES) -> dict[bytes, float]:
    """ln((N + 1) / (df + 1)) + 1 of each word of the templates, over all rows of `docs`.

    The result has a row for each of the templates' words, some hundred, however many documents there are."""
    vocabulary = frozenset(template_words(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in utf8(batch, "text"):
                seen.update(vocabulary.intersection(words_of(text)))
        seen[b""] = n
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select(_text()).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.collect()}
    n = found.get(b"", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: list[Template] = LICENCES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of `docs`.

    n_base counts the places of the bare phrases, first_word and last_word are the smallest and largest of their
    starts (null without any).  base_labels names the phrases, labels the templates too.  score is 1 if a bare phrase
    stands in the text, else the best coverage of a verified template, else 0.  A null or empty text has no words and
    no labels; a null doc_id stays null; repeated rows are scanned each; other columns are ignored."""
    idf = inverse_document_frequencies(docs, templates)  # bounded by the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(idf, templates)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                rows = []
                for text in utf8(part, "text"):
                    words = words_of(text)
                    base, found = index.scan(words)
                    starts, labels = [i for i, _ in base], {x for _, x in base}
                    score = 1.0 if base else max(found.values(), default=0.0)
                    rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
