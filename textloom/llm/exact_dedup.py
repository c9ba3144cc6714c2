"""Exact dedup: counting quotient filters built per partition, merged losslessly, then byte verification.

A fingerprint of 64 bits is split into a quotient (its high bits) and a remainder.  A filter keeps, for each
quotient that occurs, the sorted remainders with a count each, so that quotient and remainder together give the
fingerprint back: merging two filters loses nothing.  Fingerprints with a count above one go on to verification,
where whole normalised texts are grouped byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, materialize, table

#: Filters are cut into ranges of quotients, the unit of merging: so many that each gets about SHARD fingerprints.
SHARD, FEWEST_BITS = 2**20, 5


def shard_bits(fingerprints: int) -> int:
    return max(FEWEST_BITS, int(np.ceil(np.log2(max(fingerprints, 1) / SHARD))))


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints: occupied bits over quotients, run ends, sorted remainders and counters."""

    def __init__(self, quotient_bits: int, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: sorted and distinct."""
        self.quotient_bits = quotient_bits
        self.remainder_bits = np.uint64(64 - quotient_bits)
        quotients = (fingerprints >> self.remainder_bits).astype(np.int64)
        self.remainders = fingerprints & ((np.uint64(1) << self.remainder_bits) - np.uint64(1))
        self.counts = counts.astype(np.int64)
        occupied = np.zeros(2**quotient_bits, bool)
        occupied[quotients] = True
        ends = np.ones(len(quotients), bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        self.occupied, self.run_ends = np.packbits(occupied), np.packbits(ends)

    @classmethod
    def build(cls, quotient_bits: int, values: np.ndarray) -> CountingQuotientFilter:
        found, counts = np.unique(values, return_counts=True)
        return cls(quotient_bits, found, counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        ends = np.unpackbits(self.run_ends, count=n).astype(np.int64)
        run = np.cumsum(ends) - ends
        return (quotients[run] << self.remainder_bits) | self.remainders, self.counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sum of all: their remainders are sorted runs, which a stable sort merges in one go."""
        each = [f.items() for f in filters]
        both, counts = (np.concatenate([x[i] for x in each]) for i in (0, 1))
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(first)
        return cls(max(f.quotient_bits for f in filters), both[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.run_ends, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
        new = cls.__new__(cls)
        new.quotient_bits, new.remainder_bits = quotient_bits, np.uint64(64 - quotient_bits)
        at = 16
        for name, kind, size in (("occupied", np.uint8, -(-(2**quotient_bits) // 8)), ("run_ends", np.uint8, -(-n // 8)), ("remainders", np.uint64, n), ("counts", np.int64, n)):
            setattr(new, name, np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return new


def _build(bits: int):
    """One filter for each shard of quotients that this partition fills.  Inside a shard the shard's own bits are cut
    off, so that quotients stay dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(values)) if values else np.zeros(0, np.uint64)
        if not len(values):
            return
        shard = (values >> np.uint64(64 - bits)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b in zip(begin, np.r_[begin[1:], len(shard)], strict=True):
            own = values[a:b] << np.uint64(bits)
            made = CountingQuotientFilter.build(min(20, max(3, int(len(own)).bit_length())), own)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return run


def _repeated(bits: int):
    """Merge the filters of each shard (rows come sorted by shard) and give the fingerprints counted more than once."""

    def out(shard: int, filters: list[CountingQuotientFilter]) -> Iterator[pa.RecordBatch]:
        values, counts = CountingQuotientFilter.merged(filters).items()
        values = (values >> np.uint64(bits)) | (np.uint64(shard) << np.uint64(64 - bits))
        values = values[counts > 1].view(np.int64)
        for at in range(0, len(values), 100_000):
            yield pa.RecordBatch.from_pydict({"fp": pa.array(values[at : at + 100_000])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filters = None, []
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard and filters:
                    yield from out(shard, filters)
                    filters = []
                shard = s
                filters.append(CountingQuotientFilter.from_bytes(data))
        if filters:
            yield from out(shard, filters)

    return run


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp) of those values of the only column of `fingerprints` that occur more than once.  A shard holds different
    fingerprints and their counts: copies, however many, are one entry of each partition's filter."""
    bits = shard_bits(fingerprints.count())
    filters = fingerprints.mapInArrow(_build(bits), "shard long, filter binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(_repeated(bits), "fp long")


def normalised() -> Column:
    """Each run of the six ASCII white-space characters as one space; a null text as empty."""
    return F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t-\\r]+", " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs` (doc_id, text).

    A null text counts as empty, and empty texts form a group like any other.  The smallest doc_id of a group stays;
    a null doc_id stays only if its group has no other.  Rows that repeat with their doc_id are counted each and are
    kept or dropped alike.  Columns beside doc_id and text are ignored.  An empty table gives an empty result."""
    norm = normalised()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    base = base.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    base = materialize(base, "fingerprints")
    repeated = materialize(repeated_fingerprints(base.select("fp")), "repeated")
    may = KeyFilter(repeated, F.col("fp"))
    candidates = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    candidates = candidates.withColumn("fp", F.xxhash64("norm")).where(may.may_hold())
    groups = candidates.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "n")
    joined = base.join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
