"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A filter is a direction put together from one codeword for each half of the vector, in each of a few
randomly turned codes; a vector belongs to every filter whose direction it exceeds a threshold in.  The product structure
lets each vector list its filters without looking at them all: only codewords that can reach the threshold with the
best codeword of the other half are combined.  Vectors are joined on filters, and each pair of a filter's members is
verified in double precision, in the first filter that the two share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, components, materialize, table

#: Codes, and filters that a vector is expected to have in each of them.
CODES, EXPECTED = 8, 8.0
SEED = 5
#: Members of a filter that one task compares with each other; larger filters are compared in pairs of such blocks.
BLOCK = 1024
COSINE = 0.95


def codewords_for(vectors: int) -> int:
    """Codewords of a half: enough that a filter holds about half an unrelated vector."""
    return int(min(2**15, max(2**9, 2 ** np.ceil(np.log2(np.sqrt(2 * EXPECTED * max(vectors, 1)))))))


@lru_cache(8)
def threshold(words: int) -> float:
    low, high = 0.0, 9.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if words * words * 0.5 * erfc(middle / sqrt(2)) > EXPECTED else (low, middle)
    return low


@lru_cache(4)
def code(number: int, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For both halves of a randomly turned vector, the matrix that gives its products with Gaussian codewords.

    Vectors are turned by a random isometry, into at least 32 dimensions, so that narrow or sparse ones are spread
    over both halves too; the same wherever it is made."""
    rng = np.random.default_rng([SEED, number, width])
    wide = max(width, 32)
    turn = np.linalg.qr(rng.normal(size=(wide, width)))[0]
    half = wide // 2
    return turn[:half].T @ rng.normal(size=(half, words)), turn[half:].T @ rng.normal(size=(wide - half, words))


def list_decode(unit: np.ndarray, words: int) -> list[np.ndarray]:
    """The filters of each row of `unit` (unit vectors), as sorted numbers."""
    n, width = unit.shape
    limit = threshold(words)
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for c in range(CODES):
        first, second = code(c, width, words)
        one, two = unit @ first, unit @ second
        best_one, best_two = one.max(axis=1), two.max(axis=1)
        for r in range(n):
            i, j = np.flatnonzero(one[r] >= limit - best_two[r]), np.flatnonzero(two[r] >= limit - best_one[r])
            p, q = np.nonzero(one[r, i][:, None] + two[r, j] >= limit)
            found[r].append((c * words + i[p]) * words + j[q])
    return [np.sort(np.concatenate(x)) for x in found]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_width(batch: pa.RecordBatch, column: str, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vector that occurs, `most` rows at a time."""
    lists = batch.column(column)
    sizes = np.asarray(pa.compute.list_value_length(lists))
    values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        for at in range(0, len(rows), most):
            some = rows[at : at + most]
            yield some, values[offsets[some][:, None] + np.arange(width)]


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, vh, vec, copies): each different usable vector once, under the smallest id that has it.

    Usable are vectors with at least one component, all components finite, not all zero."""
    return vectors.where("usable").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", F.xxhash64("vec").alias("vh"), "vec", "copies")


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, vec, vh, usable) for each row of `vectors` (vec_id, embedding)."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    usable = F.coalesce((F.size(vec) > 0) & finite & some, F.lit(False))
    return vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), vec.alias("vec"), F.xxhash64(vec).alias("vh"), usable.alias("usable"))


def packed_as(words: int) -> np.dtype:
    """The numbers of filters, as they go along with a vector."""
    return np.dtype(np.uint32 if CODES * words * words <= 2**32 else np.int64)


def _filters(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_width(batch, "vec"):
                found = list_decode(unit_rows(vectors), words)
                width = vectors.shape[1]
                numbers = pa.array([x + width * (CODES * words * words) for x in found], pa.list_(pa.int64()))
                packed = pa.array([x.astype(packed_as(words)).tobytes() for x in found], pa.binary())
                take = pa.array(rows.astype(np.int32))
                columns = [batch.column(c).take(take) for c in ("rep", "vh", "vec", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, numbers, packed], ["rep", "vh", "vec", "copies", "filters", "packed"])

    return run


#: Members up to which all filters of a batch are looked through together; larger ones are multiplied one at a time.
FEW = 64


def _linked_groups(unit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the groups (rows starts..starts+sizes-1 of `unit`) hold a pair of vectors that link."""
    has = np.zeros(len(starts), bool)
    group = np.repeat(np.arange(len(starts)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(unit))  # rows of its group from a row on
    rows = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    for apart in range(1, FEW):
        rows = rows[(left[rows] > apart) & ~has[group[rows]]]
        if not len(rows):
            break
        close = np.einsum("ij,ij->i", unit[rows], unit[rows + apart]) >= cosine
        has[group[rows[close]]] = True
    for g in np.flatnonzero(sizes > FEW):
        some = unit[starts[g] : starts[g] + sizes[g]]
        close = some @ some.T >= cosine
        np.fill_diagonal(close, False)
        has[g] = close.any()
    return has


def _verify(cosine: float, words: int):
    """Rows come sorted by (filter, b1, b2): the members of a filter, or of two blocks of it."""

    kind = packed_as(words)

    def compare(crossed: bool, reps: np.ndarray, hashes: np.ndarray, copies: np.ndarray, blocks: np.ndarray, unit: np.ndarray, earlier: pa.Array) -> tuple | None:
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        if crossed:
            linked &= blocks[:, None] != blocks[None, :]
        member = np.flatnonzero(linked.any(axis=1))
        if not len(member):
            return None
        linked = linked[np.ix_(member, member)]
        # a pair counts in the first filter that both have: earlier ones in common rule it out here
        lists = [np.frombuffer(x, kind) for x in earlier.take(pa.array(member)).to_pylist()]
        columns, owners = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        found, column, times = np.unique(columns, return_inverse=True, return_counts=True)
        shared = np.zeros(linked.shape, bool)
        keep = np.flatnonzero(times > 1)
        for at in range(0, len(keep), 2000):
            number_of = np.full(len(found), -1)
            number_of[keep[at : at + 2000]] = np.arange(len(keep[at : at + 2000]))
            here = number_of[column] >= 0
            table_ = np.zeros((len(member), len(keep[at : at + 2000])), np.float32)
            table_[owners[here], number_of[column[here]]] = 1
            shared |= table_ @ table_.T > 0
        links = (linked & ~shared) @ copies[member]
        # smallest id within reach inside these members
        least = reps[member].copy()
        for _ in range(len(least)):
            near = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
            lower = np.minimum(least, near)
            if (lower == least).all():
                break
            least = lower
        return reps[member], hashes[member], links, least

    def compared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole groups."""
        number, b1, b2, reps, hashes, copies, blocks = (np.asarray(rows.column(c)) for c in ("filter", "b1", "b2", "rep", "vh", "copies", "block"))
        fresh = np.ones(len(number), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
        done = []
        for some, vectors in _by_width(rows, "vec", most=len(number)):  # whole groups, as filters tell the width
            unit = unit_rows(vectors)
            starts = np.flatnonzero(fresh[some])
            sizes = np.diff(np.append(starts, len(some)))
            for g in np.flatnonzero(_linked_groups(unit, starts, sizes, cosine)):
                own = slice(starts[g], starts[g] + sizes[g])
                at = some[own]
                if (found := compare(b1[at[0]] != b2[at[0]], reps[at], hashes[at], copies[at], blocks[at], unit[own], rows.column("earlier").take(pa.array(at)))) is not None:
                    done.append(found)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[i] for d in done])) for i in range(4)], ["rep", "vh", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the last group so far, at most two blocks and a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0]
            last = rows.num_rows - 1
            same = np.ones(rows.num_rows, bool)
            for c in ("filter", "b1", "b2"):
                values = np.asarray(rows.column(c))
                same &= values == values[last]
            begin = rows.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from compared(rows.slice(0, begin)) if begin else ()
            waiting = [rows.slice(begin)]
        for rows in waiting:
            yield from compared(rows)

    return run


def vector_links(distinct: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Of the different vectors (rep, vh, vec, copies): (rep, vh, links), rows other than copies that each links
    with, and (rep, component_id) of those that link at all."""
    words = codewords_for(distinct.count())
    made = "rep long, vh long, vec array<double>, copies long, filters array<long>, packed binary"
    decoded = materialize(distinct.select("rep", "vh", "vec", "copies").mapInArrow(_filters(words), made), "filters")
    filters = decoded.select("rep", "vh", F.posexplode("filters").alias("place", "filter"))
    shared = filters.groupBy("filter").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = filters.join(shared, "filter").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", "vh"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    members = members.withColumn("other", other).withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    # a pair counts in the first filter that both have, so that the earlier ones go along and no task decodes again
    earlier = F.substring("packed", F.lit(1), F.col("place") * packed_as(words).itemsize).alias("earlier")
    full = members.join(decoded.drop("filters"), ["rep", "vh"]).select("filter", "b1", "b2", "rep", "vh", "copies", "vec", "block", earlier)
    dealt = full.repartition("filter", "b1", "b2").sortWithinPartitions("filter", "b1", "b2")
    found = materialize(dealt.mapInArrow(_verify(cosine, words), "rep long, vh long, links long, least long"), "links")
    links = found.groupBy("rep", "vh").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return links, components(edges).withColumnRenamed("id", "rep")


def vector_dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `vectors` (vec_id, embedding).

    Two rows link if their cosine, in double precision, is `cosine` or more.  Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing; vectors of different lengths don't link.  Copies link with
    each other and count singly in n_links.  Rows that share a vec_id are one vertex of the graph; a null vec_id
    counts as smaller than any other.  Other columns are ignored.

    Filters find a pair with a probability: at cosine 0.95 about thirty filters are shared on average."""
    rows = materialize(prepared(vectors), "vectors")
    distinct = materialize(distinct_vectors(rows), "distinct")
    links, reached = vector_links(distinct, cosine)
    info = distinct.select("rep", "vh", "copies", F.col("vec").alias("own"))
    info = info.join(links, ["rep", "vh"], "left").join(reached, "rep", "left")
    joined = rows.join(info.withColumn("ok", F.lit(True)), (rows.vh == info.vh) & (rows.vec == info.own) & rows.usable, "left")
    least = F.coalesce("component_id", "rep", "id")
    show = lambda c: F.when(c != NULL_ID, c)
    n_links = F.when(F.col("ok"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    return joined.select(show(rows.id).alias("vec_id"), n_links.cast("long").alias("n_links"), show(least).alias("component_id"), (rows.id == least).alias("kept"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, e, len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AS usable
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
u AS MATERIALIZED (SELECT * FROM v WHERE usable),
pairs AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {COSINE} ELSE false END),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x AS vec_id, count(*) AS n FROM pairs GROUP BY x)
SELECT l.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN counted c ON l.vec_id = c.vec_id
"""
