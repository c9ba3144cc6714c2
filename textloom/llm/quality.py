"""Quality classifier: random-indexing word vectors pooled per document, then a small two-layer network.

Every word has a sparse random index vector, found by hashing.  A word's vector is its index vector plus the sum of
the index vectors of its neighbours, gathered over all documents (words that share a hash bucket share a vector, so
that the table has a fixed size).  A document is described by means of its words' vectors; a network of two layers,
trained with numpy on a bounded sample of labelled rows, scores it, and a temperature fitted on rows kept back turns
the score into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Runs of letters, of digits, of signs, and line ends: how a text is written matters as much as its words.
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n")
BUCKETS, WIDTH, NONZERO = 2**13, 64, 8
#: Rows of the table of context sums in one piece.
PIECE = 512
#: Labelled rows used for training and calibration, chosen by hash; the bound is a parameter of `fit`.
SAMPLE = 12_000
#: Learning: hidden units, epochs, batch, step.
HIDDEN, EPOCHS, BATCH, STEP = 32, 40, 128, 2e-3
ACCEPT = 0.7


class _Buckets(dict):
    """word -> bucket, filled when asked."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


_buckets = _Buckets()


def word_buckets(text: str) -> np.ndarray:
    words = WORD.findall(text)
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def index_vectors(seed: int = 3) -> np.ndarray:
    """Sparse ternary vectors, the same wherever they are made."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    index = np.zeros((BUCKETS, WIDTH), np.int8)
    np.put_along_axis(index, at, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return index


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors over this partition, in pieces."""
    index, sums = index_vectors(), np.zeros((BUCKETS, WIDTH), np.int64)
    for batch in batches:
        for part in slices(batch, "text", 500_000):
            texts = [word_buckets(t) for t in part.column("text").to_pylist()]
            left = np.concatenate([np.zeros(0, np.int64), *(x[:-1] for x in texts)])
            right = np.concatenate([np.zeros(0, np.int64), *(x[1:] for x in texts)])
            for own, other in ((left, right), (right, left)):
                if len(own):
                    order = np.argsort(own, kind="stable")
                    found = own[order]
                    at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    sums[found[at]] += np.add.reduceat(index[other[order]], at, axis=0, dtype=np.int64)
    pieces = sums.reshape(-1, PIECE * WIDTH)
    yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "sums": pa.array([p.tobytes() for p in pieces], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the pieces, one at a time (rows come sorted by piece)."""
    piece, total = None, None

    def out():
        return pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != piece:
                if piece is not None:
                    yield out()
                piece, total = p, np.zeros(PIECE * WIDTH, np.int64)
            total = total + np.frombuffer(data, np.int64)
    if piece is not None:
        yield out()


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, from all rows of `docs`.  Sums of integers: no order of tasks changes them."""
    parts = docs.select(_text()).mapInArrow(_contexts, "piece int, sums binary")
    parts = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(_add, "piece int, sums binary")
    sums = np.zeros((BUCKETS // PIECE, PIECE * WIDTH))
    for r in parts.collect():  # BUCKETS x WIDTH numbers, whatever the input
        sums[r["piece"]] = np.frombuffer(r["sums"], np.int64)
    sums = sums.reshape(BUCKETS, WIDTH)
    own = index_vectors() / np.sqrt(NONZERO)
    return (own + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, text: str) -> np.ndarray:
    """What the network sees of a text: the mean of its words' vectors, the same with each word counted by the
    logarithm of its number, the mean product of neighbours, and three sizes.  Zeros for a text without words."""
    words = word_buckets(text)
    out = np.zeros(3 * WIDTH + 3, np.float32)
    if not len(words):
        return out
    counts = np.bincount(words, minlength=BUCKETS)
    present = np.flatnonzero(counts)
    counts, own = counts[present].astype(np.float32), vectors[present]
    mean = counts @ own / len(words)
    logs = np.log1p(counts)
    out[:WIDTH], out[WIDTH : 2 * WIDTH] = mean, logs @ own / logs.sum()
    if len(words) > 1:
        product = np.zeros(WIDTH)
        for at in range(0, len(words) - 1, 50_000):  # a very long text in pieces
            some = words[at : at + 50_001]
            product += np.einsum("ij,ij->j", vectors[some[1:]], vectors[some[:-1]])
        out[2 * WIDTH : 3 * WIDTH] = product / (len(words) - 1)
    out[3 * WIDTH :] = np.log1p(len(words)) / 10, len(present) / len(words), mean @ mean
    return out


@dataclass
class Network:
    """Two layers, with the scaling of their input and the temperature of their output."""

    shift: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Minimise the cross entropy by Adam, then fit the temperature on the fifth of the rows kept back.

    Without rows of both labels the network gives their smoothed share, whatever the input."""
    wide = x.shape[1]
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        flat = [np.zeros((wide, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share)))]
        return Network(np.zeros(wide), np.ones(wide), flat)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, rows = order[: len(y) // 5], order[len(y) // 5 :]
    shift, scale = x[rows].mean(0), x[rows].std(0) + 1e-6
    z = (x - shift) / scale
    weights = [rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(rows)
        for at in range(0, len(rows), BATCH):
            some = shuffled[at : at + BATCH]
            hidden = np.maximum(z[some] @ weights[0] + weights[1], 0)
            out = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40)))
            error = (out - y[some]) / len(some)
            inner = np.outer(error, weights[2]) * (hidden > 0)
            slopes = [z[some].T @ inner + 1e-4 * weights[0], inner.sum(0), hidden.T @ error, error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                weights[i] = weights[i] - STEP * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    network = Network(shift, scale, weights)
    logits, truth = network.logits(x[back]), y[back]
    loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean()
    network.temperature = float(min(np.geomspace(0.5, 10, 61), key=loss))
    return network


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.network.probabilities(np.stack([pooled(self.vectors, t) for t in texts]))


def held_out(column: str = "doc_id") -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all of `docs`; the network from at most `sample` rows of `labels` (doc_id, quality), chosen
    by hash from those not held out.  Null ids and null labels are passed over; of several labels of one id the
    largest counts."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = usable.orderBy(F.xxhash64("of", F.lit("sample")), "of").limit(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pooled(shared.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "quality", "pooled"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    rows = rows.select("doc_id", "quality", "text").mapInArrow(describe, "doc_id long, quality int, pooled binary")
    rows = rows.dropDuplicates(["doc_id"]).collect()  # at most `sample` rows of fixed width
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["pooled"], np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, 3 * WIDTH + 3))
    return QualityModel(vectors, train(x, np.array([r["quality"] for r in rows], np.int64)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(row, score): each row of `docs` as a struct, and the probability that it has label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = shared.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text())
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("score", "double"))


def quality_filter(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score `accept` or more, with all their columns."""
    scored = score(docs, fit(docs, labels, sample)).where(F.col("score") >= accept)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs` (doc_id, text).

    Null texts are scored as empty ones; a null doc_id stays null and is not held out; repeated rows score alike;
    other columns are never read.  Without labels of both kinds every score is the smoothed share of label 1."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = fit(only, labels, sample)
    ids = only.withColumn("held_out", held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = shared.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    done = ids.select("doc_id", "held_out", _text()).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return done.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
