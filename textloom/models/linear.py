"""One-vs-rest linear SVMs over sparse features (doc_id, indices, values) and labels (doc_id, label).

The hinge loss is minimised by distributed dual coordinate ascent (Jaggi et al., "Communication-Efficient Distributed Dual
Coordinate Ascent", 2014): every row has a dual variable for each label, which travels with the row, and a task improves
those of its own rows against the shared weights.  What all tasks find is added up and taken as far as the dual objective
rises, which is a quadratic along that line, so that the sum is safe and no smaller than an average.  The gap between the
primal and the dual value says how far the optimum can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import kept, spent

Models = dict[str, tuple[list[float], float]]
_STATE = "label int, indices array<int>, values array<double>, y array<int>, a array<double>, da array<double>"
#: Products that are held at once when rows are scored.
HELD = 2_000_000
#: A row rests if no dual variable would move by more than this share of its cost.
STILL = 1e-9
#: Rows that a task has at least: the fewer tasks, the fewer rounds.
ROWS_A_TASK = 5_000


def dense(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, indices, values) of an array of numbers for each row."""
    return rows.select("doc_id", F.transform(column, lambda x, i: i).alias("indices"), F.col(column).cast("array<double>").alias("values"))


def _products(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """Each row times the weights, some rows at a time; rows (indices, values) are not empty."""
    sizes = np.array([len(i) for i, _ in rows], np.int64)
    ends, out = np.cumsum(sizes), np.empty((len(rows), w.shape[1]))
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + max(1, HELD // w.shape[1]), side="right")))
        i, v = (np.concatenate([r[c] for r in rows[at:stop]]) for c in (0, 1))
        out[at:stop] = np.add.reduceat(w[i] * v[:, None], ends[at:stop] - sizes[at:stop] - (ends[at] - sizes[at]), axis=0)
        at = stop
    return out


def _ascent(shared, labels: int, reg: float, n: int, local: int, costs: tuple, seed: int):
    """One round over the rows of a task, a batch at a time: `local` passes over each batch in random order, each over the
    rows only that would move under the weights that it begins with; most soon rest at a bound.  Gives the rows with their dual variables and the change that is found for them, the change of the weights, and sums: of the
    losses and the dual variables at the start, and of their changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, taken, number = shared.value
        here, rng = start.copy(), np.random.default_rng(seed + number)
        loss, alphas, gains, some = np.zeros(labels), np.zeros(labels), np.zeros(labels), False
        bias = np.array([len(start) - 1])
        for batch in batches:
            if not len(batch):
                continue
            some = True
            rows = [(np.concatenate([i, bias]), np.append(v, 1.0)) for i, v in zip(batch["indices"], batch["values"], strict=True)]
            y = np.stack(batch["y"]) * 2.0 - 1
            before = np.stack(batch["a"]) + taken * np.stack(batch["da"])
            a, cost = before.copy(), np.where(y > 0, *costs)
            rate = reg * n / np.array([v @ v for _, v in rows])
            loss += (cost * np.maximum(0, 1 - y * _products(rows, start))).sum(axis=0)
            alphas += before.sum(axis=0)
            for _ in range(local):
                moves = np.clip(a + (1 - y * _products(rows, here)) * rate[:, None], 0, cost) - a
                moving = np.flatnonzero((np.abs(moves) > STILL * cost).any(axis=1))
                if not len(moving):
                    break
                for k in rng.permutation(moving):
                    (i, v), own, old = rows[k], y[k], a[k]
                    w = here[i]
                    new = np.minimum(np.maximum(old + (1 - own * (v @ w)) * rate[k], 0), cost[k])
                    here[i] = w + v[:, None] * ((new - old) * own / (reg * n))
                    a[k] = new
            found = a - before
            gains += found.sum(axis=0)
            yield batch.assign(a=list(before), da=list(found))
        if some:
            change = here - start
            touched = np.flatnonzero(change.any(axis=1)).astype(np.int32)
            every = np.arange(labels, dtype=np.int32)
            told = [(k, touched, change[touched, k]) for k in range(labels)] + [(labels, every, loss), (labels + 1, every, alphas), (labels + 2, every, gains)]
            yield pd.DataFrame({"label": [t[0] for t in told], "indices": [t[1] for t in told], "values": [t[2] for t in told], "y": None, "a": None, "da": None})

    return run


def fit(features: DataFrame, doc_labels: DataFrame, labels: list[str], reg: float = 0.001, rounds: int = 20, local: int = 20, balanced: bool = False, tolerance: float = 0.005, seed: int = 1234, rows_a_task: int = ROWS_A_TASK) -> Models:
    """Label -> (coefficients, intercept): reg / 2 * |w|^2 + mean hinge loss, the intercept a weight like others.

    All labels learn in one scan of a round.  Rounds end when no label's objective can be above its optimum by more than
    `tolerance` of it, or after `rounds`.  A row's state is its features and a number for each label; the weights, labels
    x features, are what the driver holds.  Rows without features learn the intercept only; without rows all weights are 0."""
    names = F.array_intersect(F.collect_set("label"), F.array(*[F.lit(x) for x in labels]))
    own = doc_labels.groupBy("doc_id").agg(names.alias("own"))
    truth = F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.coalesce(F.array_contains("own", x), F.lit(False)).cast("int"))
    none = F.array_repeat(F.lit(0.0), len(labels))
    rows = features.join(own, "doc_id", "left").select(F.lit(-1).alias("label"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"), truth.alias("y"), none.alias("a"), none.alias("da"))
    rows = before = kept(rows, "duals")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("indices")).alias("most"), *[F.avg(F.col("y")[i]).alias(f"s{i}") for i in range(len(labels))]).first()
    n, size = told["n"], (told["most"] if told["most"] is not None else -1) + 1
    weights, taken = np.zeros((size + 1, len(labels))), np.zeros(len(labels))
    best, lowest = weights.copy(), np.full(len(labels), np.inf)  # the primal value need not fall in each round
    share = np.clip([told[f"s{i}"] or 0.5 for i in range(len(labels))], 1e-6, 1 - 1e-6)
    costs = (0.5 / share, 0.5 / (1 - share)) if balanced else (np.ones(len(labels)), np.ones(len(labels)))
    for number in range(rounds if n else 0):
        shared = rows.sparkSession.sparkContext.broadcast((weights, taken, number))
        step = _ascent(shared, len(labels), reg, n, local, costs, seed)
        rows = rows.coalesce(max(1, -(-n // rows_a_task)))
        written = kept(rows.mapInPandas(step, _STATE), "duals")
        pairs = written.where("label >= 0").select("label", F.inline(F.arrays_zip(F.col("indices").alias("at"), F.col("values").alias("v"))))
        sums = pairs.groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas()  # as large as the weights
        loss, alphas, gains = (sums[sums["label"] == len(labels) + k].sort_values("at")["v"].to_numpy() for k in range(3))
        norm = reg / 2 * (weights**2).sum(axis=0)
        primal, dual = norm + loss / n, alphas / n - norm  # of the weights as the round began
        better = primal < lowest
        best[:, better], lowest[better] = weights[:, better], primal[better]
        if (lowest - dual <= tolerance * lowest).all():
            spent(written)
            break
        change = sums[sums["label"] < len(labels)]
        line = np.zeros_like(weights)
        line[change["at"].to_numpy(), change["label"].to_numpy()] = change["v"].to_numpy()
        rise, bend = gains / n - reg * (weights * line).sum(axis=0), reg * (line**2).sum(axis=0)
        taken = np.clip(np.divide(rise, bend, out=np.zeros_like(rise), where=bend > 0), 0, 1)
        weights = weights + taken * line
        spent(before)  # a round reads no other rows than those of the one before it
        before, rows = written, written.where("label < 0")
    spent(before)
    return {name: (best[:-1, k].tolist(), float(best[-1, k])) for k, name in enumerate(labels)}


def scores(features: DataFrame, models: Models) -> DataFrame:
    """(doc_id, label_id, label, y_score, y_pred), margins as sums over the features that a row has; positive above 0.
    A feature that no model knows counts for nothing."""
    names, matrix = list(models), np.array([[*w, b] for w, b in models.values()]).T
    shared = features.sparkSession.sparkContext.broadcast(matrix)

    def margins(batch: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        sizes = np.array([len(i) for i in batch["indices"]], np.int64)
        out = np.repeat(w[-1:], len(batch), axis=0)
        at, values = (np.concatenate(list(batch[c])) if len(batch) else np.zeros(0) for c in ("indices", "values"))
        row = np.repeat(np.arange(len(batch)), sizes)
        known = at < len(w) - 1
        at, values, row = at[known].astype(np.int64), values[known], row[known]
        if len(at):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(w[at] * values[:, None], first, axis=0)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = np.cumsum([len(i) * len(names) for i in batch["indices"]]) // HELD
            for _, part in batch.groupby(ends, sort=False) if len(batch) else []:
                found = margins(part, shared.value)
                yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), len(names)), "label_id": np.tile(np.arange(len(names)), len(part)), "y_score": found.ravel()})

    rows = features.select("doc_id", "indices", "values").mapInPandas(run, "doc_id long, label_id int, y_score double")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("label_id") + 1)
    return rows.select("doc_id", "label_id", label.alias("label"), "y_score", (F.col("y_score") > 0).cast("int").alias("y_pred"))
