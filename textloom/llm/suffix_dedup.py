"""Suffix-array dedup of bytes: which 100-byte strings also start earlier.

The suffix array is built by the difference-cover algorithm: suffixes at places 1 and 2 modulo 3 are sorted by
triples, the triples' names are sorted by recursion, the remaining suffixes are sorted by one symbol and the rank of
what follows, both are merged, and prefixes of neighbouring suffixes are compared.

It is distributed by content.  Every 100-byte window has an anchor, the smallest hash of the grams inside it; equal
windows have equal anchors.  Windows whose anchor occurs once are out, runs of windows with equal content are kept
once (see `repeats`), and the bytes left under one anchor meet in one task, which sorts their suffixes.  Suffixes of
different anchors can share no window, so that this compares the same neighbours as one array over everything.
Anchors with too many different runs for one task go another way: their windows are grouped by 128-bit keys, which
Spark pre-aggregates and splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed_texts, later_rows, materialize, slices, table
from .repeats import Kind, Part, Repeats, covered_mask, with_spans
from .windows import gram_hashes, mix

WINDOW, GRAM = 100, 32
#: Runs of one anchor that one task sorts; each has at most 355 bytes.
RUNS_IN_TASK = 8_000
#: Bytes whose suffixes are sorted at once (whole anchors; one anchor has at most RUNS_IN_TASK runs).
SORTED_AT_ONCE = 1_000_000

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _order(*columns: np.ndarray) -> np.ndarray:
    """Sorted order of tuples of small non-negative integers, the first column first."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if int(key.max(initial=0) + 1) * wide >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + c
    return np.argsort(key, kind="stable")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (integers from 1 on) in sorted order."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    # places, names and ranks take four bytes where they fit; only keys made of several of them need eight
    small = np.int32 if max(int(symbols.max()), n + 5) < 2**31 else np.int64
    text = np.zeros(n + 4, small)
    text[:n] = symbols
    # sampled places; one more past the end if needed, so that places 1 modulo 3 are as many as places 0 modulo 3
    ones, twos = np.arange(1, n + (n % 3 == 1), 3, dtype=small), np.arange(2, n, 3, dtype=small)
    sampled = np.concatenate([ones, twos])
    order = _order(text[sampled], text[sampled + 1], text[sampled + 2])
    placed = sampled[order]
    fresh = np.ones(len(placed), bool)
    fresh[1:] = (text[placed[1:]] != text[placed[:-1]]) | (text[placed[1:] + 1] != text[placed[:-1] + 1]) | (text[placed[1:] + 2] != text[placed[:-1] + 2])
    names = np.empty(len(sampled), small)
    names[order] = np.cumsum(fresh, dtype=small)
    single = bool(fresh.all())
    del ones, twos, fresh  # not held through the recursion
    if not single:
        del order, placed
        order = suffix_array(names)  # places 1 modulo 3 first, then places 2 modulo 3
        placed = sampled[order]
    del names, sampled, order
    rank = np.zeros(n + 4, small)
    rank[placed] = np.arange(1, len(placed) + 1)
    zeros = np.arange(0, n, 3, dtype=small)
    zeros = zeros[_order(text[zeros], rank[zeros + 1])]
    placed = placed[placed < n]
    one, two = placed[placed % 3 == 1], placed[placed % 3 == 2]
    # how many sampled suffixes come before each of the others: compared by one or two symbols and a known rank
    most, widest = np.int64(n + 5), np.int64(int(text.max()) + 1)
    before = np.searchsorted(text[one] * most + rank[one + 1], text[zeros] * most + rank[zeros + 1])
    pairs_two, pairs_zero = (text[x] * widest + text[x + 1] for x in (two, zeros))
    if len(pairs_two) and max(int(pairs_two.max()), int(pairs_zero.max())) * most >= 2**62:
        named = np.unique(np.concatenate([pairs_two, pairs_zero]), return_inverse=True)[1]
        pairs_two, pairs_zero = named[: len(two)], named[len(two) :]
    before = before + np.searchsorted(pairs_two * most + rank[two + 2], pairs_zero * most + rank[zeros + 2])
    out = np.empty(n, small)
    at = np.arange(len(zeros)) + before
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = placed
    return out


def equal_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair of `starts` whether the `length` bytes from there on agree."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.zeros(max(0, len(starts) - 1), bool)
    for a in range(0, len(out), 10_000):
        some = view[starts[a : a + 10_001]]
        out[a : a + 10_000] = (some[1:] == some[:-1]).all(axis=1)
    return out


def repeated_starts(regions: list[bytes], ids: np.ndarray, hashes: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region, offset) of each window of the regions that equals an earlier one: one of a smaller id, or one of the
    same text (id and hash) that starts before it.  Windows at one place of rows that agree in id and text are the same
    window, not earlier ones.  ats: where the regions start in their texts."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions], np.int64)
    ends = np.cumsum(sizes)
    valid = np.ones(len(data), bool)
    for e in ends.tolist():
        valid[max(0, e - WINDOW + 1) : e] = False
    array = suffix_array(data.astype(np.int32) + 1)
    starts = array[valid[array]]
    group = np.cumsum(np.r_[False, ~equal_prefixes(data, starts, WINDOW)]) if len(starts) else starts
    region = np.searchsorted(ends, starts, side="right")
    offset = starts - (ends - sizes)[region]
    order = np.lexsort((ats[region] + offset, hashes[region], ids[region], group))
    group, region, offset = group[order], region[order], offset[order]
    own, text = ids[region], hashes[region]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    first = np.repeat(own[begin], np.diff(np.r_[begin, len(group)])) if len(group) else own
    again = np.zeros(len(group), bool)
    place = ats[region] + offset
    again[1:] = (group[1:] == group[:-1]) & (own[1:] == own[:-1]) & (text[1:] == text[:-1]) & (place[1:] > place[:-1])
    gone = (own > first) | again
    return region[gone], offset[gone]


def read_bytes(texts: list[bytes]) -> Part:
    content = b"".join(texts)
    return Part(_TABLE[np.frombuffer(content, np.uint8)], content, 1, np.array([len(t) for t in texts], np.int64))


KIND = Kind(WINDOW, GRAM, read_bytes, inside=True)
REGION_SCHEMA = "id long, th long, v long, at int, region binary"


def _regions(rows: pa.RecordBatch, part: Part, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows of each run cover."""
    regions = [part.content[s : s + n + WINDOW - 1] for s, n in zip(found["start"].tolist(), found["n"].tolist(), strict=True)]
    take = pa.array(found["text"])
    yield pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("th").take(take), pa.array(found["v"]), pa.array(found["at"]), pa.array(regions, pa.binary())], ["id", "th", "v", "at", "region"])


def _windows(rows: pa.RecordBatch, part: Part, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, th, at, w1, w2) of each window of the runs, a few thousand runs at a time."""
    first = gram_hashes(part.symbols, WINDOW)
    second = gram_hashes(mix(part.symbols ^ np.uint64(0xA0761D6478BD642F)), WINDOW)
    n = found["n"].astype(np.int64)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(found["start"], n) + step
    take = pa.array(np.repeat(found["text"], n))
    at = (np.repeat(found["at"], n) + step).astype(np.int32)
    yield pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("th").take(take), pa.array(at), pa.array(first[start].view(np.int64)), pa.array(second[start].view(np.int64))], ["id", "th", "at", "w1", "w2"])


def _spans(region: np.ndarray, offset: np.ndarray, ids, hashes, ats) -> pa.RecordBatch:
    """Neighbouring starts of one region as spans (id, th, at, n)."""
    order = np.lexsort((offset, region))
    region, offset = region[order], offset[order]
    begin = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(region) else region
    n = np.diff(np.r_[begin, len(region)]) if len(region) else region
    of = region[begin]
    return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(hashes[of]), pa.array((ats[of] + offset[begin]).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "th", "at", "n"])


def _sort_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, id, hash and place; whole anchors are gathered to about SORTED_AT_ONCE bytes and
    sorted together.  Of rows that agree in id and text one is looked at, as spans hold for all of them."""
    waiting: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids, hashes, _, ats, regions = zip(*waiting, strict=True)
        ids, hashes, ats = np.array(ids, np.int64), np.array(hashes, np.int64), np.array(ats, np.int64)
        return _spans(*repeated_starts(list(regions), ids, hashes, ats), ids, hashes, ats)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SORTED_AT_ONCE and row[2] != waiting[-1][2]:
                yield out()
                waiting, size = [], 0
            if waiting and row[:4] == waiting[-1][:4]:
                continue
            waiting.append(row)
            size += len(row[4])
    if waiting:
        yield out()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, th, at, n): starts at..at+n-1 of 100-byte strings that also start earlier."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    search = Repeats(texts, KIND, size * 2 / (WINDOW - GRAM + 2))
    whole = search.whole_runs(inside=True)
    mixed = materialize(search.mixed_anchors(), "anchors")
    small, large = mixed.where(F.col("n_classes") <= RUNS_IN_TASK), mixed.where(F.col("n_classes") > RUNS_IN_TASK)
    regions = search.each_left_over(search.left_over(small), _regions, REGION_SCHEMA)
    # what a filter lets through beside its own may be of a large anchor
    regions = regions.join(large.select("v"), "v", "left_anti").select("id", "th", "v", "at", "region") if large.take(1) else regions
    dealt = regions.repartition("v").sortWithinPartitions("v", "id", "th", "at")
    spans = whole.unionByName(dealt.mapInArrow(_sort_regions, "id long, th long, at int, n int"))
    if large.take(1):
        windows = materialize(search.each_left_over(search.left_over(large), _windows, "id long, th long, at int, w1 long, w2 long"), "windows")
        inside = windows.groupBy("w1", "w2", "id", "th").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")).where("first_at < last_at")
        again = windows.join(inside, ["w1", "w2", "id", "th"]).where("at > first_at")
        for found in (later_rows(windows, ["w1", "w2"]), again):
            spans = spans.unionByName(found.select("id", "th", "at", F.lit(1).alias("n")))
    return spans


def kept_bytes(text: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, maximal removed runs, the rest)."""
    if not spans:
        return len(text), 0, 0, text
    gone = covered_mask(len(text), spans, WINDOW)
    n_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), n_runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of `docs` (doc_id, text).

    What is kept is binary, for a cut may fall inside a character.  A null text counts as empty; texts under 100
    bytes lose nothing.  A null doc_id counts as smaller than any other; of rows that share a doc_id none is earlier
    than the other, and rows that agree in text too fare alike.  Other columns are ignored."""
    return _finish(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", lambda kept: kept)


def _finish(docs: DataFrame, schema: str, last) -> DataFrame:
    texts = keyed_texts(docs)
    own = F.when(F.col("id") != NULL_ID, F.col("id"))
    rows = with_spans(texts, own, materialize(repeated_spans(texts), "spans"))
    names = [x.split()[0] for x in schema.split(", ")]
    kind = pa.binary() if schema.endswith("binary") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                done = [kept_bytes(t, s) for t, s in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True)]
                columns = [pa.array([x[i] for x in done], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array([last(x[3]) for x in done], kind)], names)

    return rows.mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda kept: hashlib.sha256(kept).hexdigest()
    return _finish(table(spark, sf_dir, "documents"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
