"""Line dedup over overlapping three-line windows.

Lines are what stands between line feeds.  Three consecutive lines of one document make a window.  A window whose
three lines also start earlier - under a smaller doc_id, or higher up in the same document - is a later occurrence,
and every line that such a window covers goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_texts, later_rows, row_id, slices, table, utf8

LINES = 3


def window_keys(lines: list[bytes]) -> list[bytes]:
    """128-bit hashes of the windows of a document."""
    each = [xxhash.xxh3_128_digest(x) for x in lines]
    return [xxhash.xxh3_128_digest(b"".join(each[i : i + LINES])) for i in range(len(lines) - LINES + 1)]


def first_windows(lines: list[bytes]) -> tuple[list[tuple[int, bytes]], list[int]]:
    """(start, key) of the first occurrence of each window in a document, and the starts of all others."""
    seen: set[bytes] = set()
    first, later = [], []
    for at, key in enumerate(window_keys(lines)):
        if key in seen:
            later.append(at)
        else:
            seen.add(key)
            first.append((at, key))
    return first, later


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            rows, ats, keys = [], [], []
            for i, text in enumerate(utf8(part, "text")):
                first, _ = first_windows(text.split(b"\n"))
                rows += [i] * len(first)
                ats += [at for at, _ in first]
                keys += [key for _, key in first]
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("th").take(take), pa.array(ats, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["id", "th", "at", "k1", "k2"],
            )


def without_windows(text: bytes, elsewhere: list[int]) -> tuple[bytes, int, int]:
    """The text without the lines covered by windows that start at `elsewhere`, or again in the text itself; the
    number of its lines and of those that went."""
    lines = text.split(b"\n")
    covered = np.zeros(len(lines) + 1, np.int64)
    _, later = first_windows(lines)
    for at in {*elsewhere, *later}:
        covered[at] += 1
        covered[at + LINES] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    if not gone.any():
        return text, len(lines), 0
    return b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            done = [without_windows(t, at or []) for t, at in zip(utf8(part, "text"), part.column("ats").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([x[0].decode() for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
                ["row", "kept_text", "n_lines", "n_removed"],
            )


def line_dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with their text as it stays, its n_chars, and n_lines, n_removed.

    Every row stays, if need be with an empty text.  A null text stays null and has no lines; an empty text is one
    empty line; texts of fewer than three lines have no windows.  A null doc_id counts as smaller than any other.
    Rows that share a doc_id are no earlier or later than each other.  n_chars is set anew where the table has it;
    columns called n_lines or n_removed are replaced, or pass through with `counts` off, when none are added; all others
    pass through.  An empty table gives an empty one."""
    later = later_rows(keyed_texts(docs).mapInArrow(_windows, "id long, th long, at int, k1 long, k2 long"), ["k1", "k2"])
    covered = later.groupBy("id", "th").agg(F.collect_set("at").alias("ats"))  # bounded by the document's lines
    kept = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = F.struct(*[F.col(f"`{c}`") for c in kept if c.lower() != "text"])
    rest = F.struct(others.alias("others"), F.col("text").isNull().alias("no_text"))
    rows = docs.select(row_id().alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), rest.alias("row"))
    rows = rows.join(covered, ["id", "th"], "left").select("row", "text", "ats")
    schema = T.StructType([rows.schema["row"]]).add("kept_text", "string").add("n_lines", "long").add("n_removed", "long")
    done = rows.mapInArrow(_strip, schema)
    none = F.col("row.no_text")
    out = []
    for c in kept:
        if c.lower() == "text":
            out.append(F.when(~none, F.col("kept_text")).alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(none, F.col(f"row.others.`{c}`")).otherwise(F.length("kept_text").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(f"row.others.`{c}`").alias(c))
    if not counts:
        return done.select(*out)
    return done.select(*out, F.when(none, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH numbered AS (SELECT *, row_number() OVER () AS row FROM documents),
lined AS (SELECT row, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM numbered),
each AS (SELECT row, id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM lined),
windows AS (SELECT row, id, text, pos, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(pos, 2) OVER w AS ending
  FROM each WINDOW w AS (PARTITION BY row ORDER BY pos)),
ranked AS (SELECT row, pos, min(id) OVER (PARTITION BY line, line2, line3) < id OR row_number() OVER (PARTITION BY row, line, line2, line3 ORDER BY pos) > 1 AS later FROM windows WHERE ending IS NOT NULL),
covered AS (SELECT DISTINCT row, pos + d AS pos FROM ranked, range(3) r(d) WHERE later),
kept AS (SELECT e.row, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (c.pos IS NULL) AS text, count(*) AS n_lines, count(c.pos) AS n_removed
  FROM each e LEFT JOIN covered c ON e.row = c.row AND e.pos = c.pos GROUP BY e.row)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, d.lang, d.source,
  CASE WHEN d.text IS NULL THEN d.n_chars ELSE length(coalesce(k.text, '')) END AS n_chars, CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, k.n_removed
FROM numbered d JOIN kept k ON d.row = k.row
"""
