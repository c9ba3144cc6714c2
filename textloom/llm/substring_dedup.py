"""Substring dedup over windows of fifty words, with a count-min prefilter.

Partition sketches of the windows' anchors are merged; they overestimate, so that no repeated window is lost.  A
second pass groups exactly only the windows estimated repeated: first whole runs of them, then, where runs differ,
the windows themselves, both by 128-bit keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed_texts, later_rows, materialize, slices, table
from .repeats import Kind, Part, Repeats, covered_mask, with_spans
from .windows import gram_hashes, mix

WINDOW, GRAM = 50, 25


class _Hashes(dict):
    """word -> 64-bit hash, filled when asked."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def read_words(texts: list[bytes]) -> Part:
    words = [t.split() for t in texts]  # bytes.split() splits at exactly the six ASCII white-space characters
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), np.uint64, int(lengths.sum()))
    return Part(symbols, symbols.tobytes(), 8, lengths)


KIND = Kind(WINDOW, GRAM, read_words, inside=False)


def _windows(rows: pa.RecordBatch, part: Part, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, th, at, w1, w2) of each window of the runs."""
    first = gram_hashes(part.symbols, WINDOW)
    second = gram_hashes(mix(part.symbols ^ np.uint64(0xA0761D6478BD642F)), WINDOW)
    n = found["n"].astype(np.int64)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(found["start"], n) + step
    take = pa.array(np.repeat(found["text"], n))
    at = (np.repeat(found["at"], n) + step).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [rows.column("id").take(take), rows.column("th").take(take), pa.array(at), pa.array(first[start].view(np.int64)), pa.array(second[start].view(np.int64))],
        ["id", "th", "at", "w1", "w2"],
    )


WINDOW_SCHEMA = "id long, th long, at int, w1 long, w2 long"


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, th, at, n): window starts at..at+n-1 of a text whose words also start under a smaller id."""
    size = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    search = Repeats(texts, KIND, size / 6 * 2 / (WINDOW - GRAM + 2))
    whole = search.whole_runs(inside=False)
    windows = search.each_left_over(search.left_over(search.mixed_anchors()), _windows, WINDOW_SCHEMA)
    single = later_rows(windows, ["w1", "w2"]).select("id", "th", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def kept_words(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    words = text.split()
    if spans:
        gone = covered_mask(len(words), spans, WINDOW)
        return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
    return len(words), 0, b" ".join(words)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of `docs` (doc_id, text).

    A null text has no words; a text of fewer than fifty words has no window.  A null doc_id counts as smaller than
    any other; rows that share a doc_id do not make each other's words repeated.  Other columns are ignored."""
    return _finish(docs, "doc_id long, n_words long, n_removed long, kept_text string", lambda kept: kept.decode())


def _finish(docs: DataFrame, schema: str, last) -> DataFrame:
    texts = keyed_texts(docs)
    own = F.when(F.col("id") != NULL_ID, F.col("id"))
    rows = with_spans(texts, own, materialize(repeated_spans(texts), "spans"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                done = [kept_words(t, s) for t, s in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([last(x[2]) for x in done], pa.string())], names)

    return rows.mapInArrow(run, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda kept: hashlib.sha256(kept).hexdigest()
    return _finish(table(spark, sf_dir, "documents"), "doc_id long, n_words long, n_removed long, kept_sha256 string", digest)


SQL = rf"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM worded WHERE len(words) >= {WINDOW}),
windows AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + {WINDOW - 1}], ' ')) AS key FROM starts),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, range({WINDOW}) r(d)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM worded),
kept AS (SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
