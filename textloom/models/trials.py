"""Parameter search: seeded draws from a grid, trials trained side by side and kept in a table, trials done before, the
best of them (C6, C8-C10, C14, C17)."""

from __future__ import annotations

import json
import pickle
import random
import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import kept, spent
from . import neural

#: A trial with its settings, best epoch, losses, F1 on the validation rows, weights and history.
RECORD = (
    "model string, settings string, epochs int, best_epoch int, loss double, val_loss double, f1 double, duration double, "
    "weights binary, history array<struct<epoch:int,loss:double,val_loss:double,duration:double>>"
)

# The grids searched.
MLP_GRID = {"first": [200, 500, 1000, 2000], "second": [None, 500, 1000, 2000], "input_dropout": [False], "dropout": [True]}
LSTM_GRID = {"units": [500, 1000], "w_dropout": [0.0, 0.5], "u_dropout": [0.0, 0.5], "layers": [1, 2, 3]}


def draws(grid: dict[str, list], n: int, seed: int = 1234) -> list[dict]:
    """`n` different settings (all, if there are fewer)."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def name(settings: dict) -> str:
    return "_".join(f"{k}_{v}" for k, v in settings.items())


def open_trials(spark: SparkSession, settings: list[dict], done: DataFrame) -> DataFrame:
    """(model) not yet among `done` (model, ...)."""
    wanted = spark.createDataFrame([(name(s),) for s in settings], "model string")
    return wanted.join(done.select("model"), "model", "left_anti")


def best(done: DataFrame, metric: str = "f1") -> DataFrame:
    """The trial with the largest metric, ties by name."""
    return done.orderBy(F.desc(metric), "model").limit(1)


Build = Callable[[dict], object]


def mlp(inputs: int, outputs: int, scale: float = 1.0) -> Build:
    """C4 from settings of MLP_GRID: dropouts are 0.7 of the inputs kept out and 0.5 of hidden units where drawn.
    `scale` shrinks the layers for small tables."""

    def build(s: dict):
        hidden = tuple(max(1, round(n * scale)) for n in (s["first"], s["second"]) if n)
        return neural.MLP(inputs, outputs, hidden, input_dropout=0.7 if s["input_dropout"] else 0.0, dropout=0.5 if s["dropout"] else 0.0)

    return build


def lstm(width: int, outputs: int, scale: float = 1.0) -> Build:
    """C13 from settings of LSTM_GRID."""
    return lambda s: neural.LSTM(width, outputs, max(1, round(s["units"] * scale)), s["layers"], s["w_dropout"], recurrent=s["u_dropout"], filters=s.get("filters", 0))


def micro_f1(p: np.ndarray, y: np.ndarray, above: float = 0.5) -> float:
    hit = ((p > above) & (y > above)).sum()
    return float(2 * hit / max(1, (p > above).sum() + (y > above).sum()))


def run(spark: SparkSession, settings: list[dict], build: Build, data: tuple[np.ndarray, ...], path: str, **fitting) -> DataFrame:
    """Train the settings that the trial table at `path` does not have yet, and return the whole table.

    Each open trial is a task of its own over the same bounded training rows `data` (x, y, validation x and y), which are
    broadcast; their number is the caller's documented bound.  A task appends its record, so that a lost one is repeated
    alone and a later call skips what is done."""
    done = read(spark, path)
    named = {name(s): s for s in settings}
    left = sorted(r["model"] for r in open_trials(spark, settings, done).collect())  # as many as were drawn
    if left:
        shared = spark.sparkContext.broadcast(data)

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key in batch["model"]:
                    model = build(named[key])
                    history = neural.fit(model, *shared.value, **fitting)
                    best_ = min(history, key=lambda h: h["val_loss"])
                    x, y = shared.value[2:]
                    record = {
                        "model": key,
                        "settings": json.dumps(named[key]),
                        "epochs": len(history),
                        "best_epoch": best_["epoch"],
                        "loss": best_["loss"],
                        "val_loss": best_["val_loss"],
                        "f1": micro_f1(model.predict(x), y),
                        "duration": sum(h["duration"] for h in history),
                        "weights": pickle.dumps(model.weights),
                        "history": history,
                    }
                    yield pd.DataFrame([record])

        todo = spark.createDataFrame([(m,) for m in left], "model string").repartitionByRange(len(left), "model")
        todo.mapInPandas(train, RECORD).write.mode("append").parquet(path)
        done = read(spark, path)
    return done


#: Rows that a task of a trial has at least: the fewer tasks, the fewer weights to average.
ROWS_A_TASK = 50_000
#: Numbers in a row of weights that a task sends back.
SENT = 10_000
_SUMS = "model string, at int, vec array<double>"


def run_whole(spark: SparkSession, settings: list[dict], build: Build, rows: DataFrame, outputs: int, path: str, epochs: int = 200, batch: int = 2048, patience: int = 15, least: float = 1e-5, step: float = 1e-3, seed: int = 1234, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """As `run`, over all of `rows` (key, x, label, held), which no task and not the driver holds; `held` ones validate.

    An epoch is a scan by tasks for each open trial and share of the rows.  A task takes steps over its share from the
    weights that the epoch began with, a batch of Arrow at a time; what the tasks end with is averaged by their rows.  The
    next scan, and one after the last epoch, measures these weights.  With one share this is plain training."""
    done = read(spark, path)
    named = {name(s): s for s in settings}
    left = sorted(r["model"] for r in open_trials(spark, settings, done).collect())  # as many as were drawn
    if not left:
        return done
    tasks = max(1, -(-rows.count() // rows_a_task))
    data = kept(rows.repartition(tasks, "key").coalesce(tasks).sortWithinPartitions(F.xxhash64("key", F.lit(seed))), "training")
    shapes = {m: [w.shape for w in build(named[m]).weights] for m in left}
    state = {m: (w := build(named[m]).weights, [np.zeros_like(x) for x in w]) for m in left}  # weights, mean squares
    story, best_, records = {m: [] for m in left}, {m: (np.inf, state[m][0], 0, 0.0) for m in left}, []
    for epoch in range(epochs + 1):
        began = time.time()
        shared = spark.sparkContext.broadcast((epoch, {m: state[m] for m in left}))
        parts = reduce(DataFrame.unionByName, [(data.coalesce(tasks) if tasks > 1 else data).withColumn("model", F.lit(m)) for m in left])  # a union of single tasks would be one task
        sent = parts.mapInPandas(_epoch(shared, named, build, outputs, epoch < epochs, batch, step, seed), _SUMS)
        sums = sent.groupBy("model", "at").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
        told = {(r["model"], r["at"]): np.array(r["vec"]) for r in sums.collect()}  # as large as the weights
        for m in list(left):
            n, loss, held, val_loss, hit, positive, true = told.get((m, -1), np.zeros(7))
            if epoch:
                loss = loss / max(1, n * outputs)
                val_loss = val_loss / (held * outputs) if held else loss
                story[m].append({"epoch": epoch - 1, "loss": loss, "val_loss": val_loss, "duration": duration})  # noqa: F821
                if val_loss < best_[m][0] - least:
                    best_[m] = (val_loss, state[m][0], epoch - 1, 2 * hit / max(1, positive + true))
            if epoch == epochs or epoch and epoch - 1 - best_[m][2] >= patience:
                left.remove(m)
                at = best_[m][2]
                told_ = story[m][at] if story[m] else {"loss": np.nan, "val_loss": np.nan}
                weights = pickle.dumps(best_[m][1])
                records.append((m, json.dumps(named[m]), len(story[m]), at, float(told_["loss"]), float(told_["val_loss"]), float(best_[m][3]), sum(h["duration"] for h in story[m]), weights, [{k: int(v) if k == "epoch" else float(v) for k, v in h.items()} for h in story[m]]))
            elif n:
                flat = np.concatenate([told[m, k] for k in range(sum(1 for x, k in told if x == m and k >= 0))]) / n
                cut = np.split(flat, np.cumsum([int(np.prod(x)) for x in shapes[m] * 2])[:-1])
                whole = [v.reshape(x) for v, x in zip(cut, shapes[m] * 2, strict=True)]
                state[m] = (whole[: len(shapes[m])], whole[len(shapes[m]) :])
        duration = time.time() - began
        shared.unpersist()
        if not left:
            break
    spent(data)
    spark.createDataFrame(records, RECORD).coalesce(1).write.mode("append").parquet(path)
    return read(spark, path)


def _epoch(shared, named: dict[str, dict], build: Build, outputs: int, learn: bool, batch: int, step: float, seed: int):
    """A task's rows of one trial, once: (model, at, vec) with sums over them at -1, and from 0 on the weights and mean
    squares that it ends with, times its training rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        epoch, state = shared.value
        own = {}  # of one trial, if tasks are dealt as they were cut
        for rows in batches:
            for m, some in rows.groupby("model", sort=False):
                if m not in own:
                    model, (weights, squares) = build(named[m]), state[m]
                    model.weights, model.rng = list(weights), np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
                    own[m] = model, list(squares), np.zeros(7)
                first = build(named[m])
                first.weights = state[m][0]
                learnt(first, *own[m], some)
        for m, (model, squares, sums) in own.items():
            yield pd.DataFrame({"model": [m], "at": [-1], "vec": [sums]})
            flat = np.concatenate([w.ravel() for w in model.weights + squares]) * sums[0]
            for k in range(-(-len(flat) // SENT) if learn else 0):
                yield pd.DataFrame({"model": [m], "at": [k], "vec": [flat[k * SENT : (k + 1) * SENT]]})

    def learnt(first, model, squares: list[np.ndarray], sums: np.ndarray, rows: pd.DataFrame) -> None:
        x, y, held = np.stack([np.asarray(v, float) for v in rows["x"]]), np.eye(outputs)[rows["label"]], rows["held"].to_numpy(bool)
        p = first.predict(x)
        for at, some in ((0, ~held), (2, held)):
            sums[at : at + 2] += some.sum(), neural.cross_entropy(p[some], y[some]) * y[some].size if some.any() else 0
        sums[4:] += ((p > 0.5) & (y > 0.5))[held].sum(), (p[held] > 0.5).sum(), (y[held] > 0.5).sum()
        order = model.rng.permutation(np.flatnonzero(~held)) if learn else []
        for at in range(0, len(order), batch):
            neural.rmsprop(model, squares, x[order[at : at + batch]], y[order[at : at + batch]], step)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """The trial table; an empty one where none was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(path)


def restored(done: DataFrame, settings: dict, build: Build):
    """The network of the trial with these settings; an error if it was not trained."""
    found = done.where(F.col("model") == name(settings)).select("weights").first()
    if found is None:
        raise LookupError(f"no trial {name(settings)}")
    model = build(settings)
    model.weights = pickle.loads(found["weights"])
    return model


def history(done: DataFrame) -> DataFrame:
    """C17, X11: (model, epoch, loss, val_loss, duration, best), one row an epoch; `best` marks a new least val_loss."""
    before = F.min("val_loss").over(Window.partitionBy("model").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    rows = done.select("model", F.inline("history"))
    return rows.withColumn("best", F.coalesce(F.col("val_loss") < before, F.lit(True)))
