"""Multi-label networks in numpy: a perceptron and a stacked LSTM with sigmoid outputs.

`fit` trains on one worker over a bounded training table; `trials.run_whole` over a whole one.  Scoring is distributed."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cross_entropy(p: np.ndarray, y: np.ndarray) -> float:
    q = np.clip(p, 1e-7, 1 - 1e-7)
    return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


class MLP:
    """C4: dense layers with relu, dropout before each if asked for, sigmoid outputs."""

    def __init__(self, inputs: int, outputs: int, hidden: tuple[int, ...] = (100,), input_dropout: float = 0.0, dropout: float = 0.5, seed: int = 1234):
        self.rng, sizes = np.random.default_rng(seed), (inputs, *hidden, outputs)
        self.drop = [input_dropout] + [dropout] * len(hidden)
        self.weights = []
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            self.weights += [self.rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)]

    def forward(self, x: np.ndarray, training: bool = False):
        kept, masks = [], []
        for i in range(0, len(self.weights), 2):
            rate = self.drop[i // 2] if training else 0.0
            mask = (self.rng.random(x.shape) >= rate) / (1 - rate) if rate else np.ones(1)
            x = x * mask
            masks.append(mask)
            kept.append(x)
            z = x @ self.weights[i] + self.weights[i + 1]
            x = _sigmoid(z) if i + 2 == len(self.weights) else np.maximum(z, 0)
        return x, kept, masks

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, training: bool = True) -> list[np.ndarray]:
        p, kept, masks = self.forward(x, training)
        delta, out = (p - y) / y.size, []
        for i in range(len(self.weights) - 2, -1, -2):
            own = kept[i // 2]
            out = [own.T @ delta, delta.sum(0), *out]
            if i:
                delta = (delta @ self.weights[i].T) * masks[i // 2] * (own > 0)
        return out


class LSTM:
    """One to three LSTM layers over (rows, steps, width), the last state into sigmoid outputs.

    With `filters`, a convolution of `kernel` steps (same length, relu) and max-pooling of `pool` steps come first.
    `dropout` acts on the inputs of each layer, `recurrent` on its state, with one mask for all steps of a row."""

    def __init__(self, width: int, outputs: int, units: int = 32, layers: int = 1, dropout: float = 0.0, seed: int = 1234, recurrent: float = 0.0, filters: int = 0, kernel: int = 3, pool: int = 2):
        self.rng, self.units, self.layers, self.drop, self.recurrent = np.random.default_rng(seed), units, layers, dropout, recurrent
        self.filters, self.kernel, self.pool = filters, kernel, pool
        self.weights, self.front = [], 2 if filters else 0
        if filters:
            self.weights += [self.rng.normal(0, (kernel * width) ** -0.5, (kernel * width, filters)), np.zeros(filters)]
        for layer in range(layers):
            a = (filters or width) if layer == 0 else units
            bias = np.zeros(4 * units)
            bias[units : 2 * units] = 1
            self.weights += [self.rng.normal(0, a**-0.5, (a, 4 * units)), self.rng.normal(0, units**-0.5, (units, 4 * units)), bias]
        self.weights += [self.rng.normal(0, units**-0.5, (units, outputs)), np.zeros(outputs)]

    def _of_layer(self, layer: int) -> list[np.ndarray]:
        return self.weights[self.front + 3 * layer : self.front + 3 * layer + 3]

    def _mask(self, shape: tuple[int, ...], rate: float, training: bool) -> np.ndarray:
        return (self.rng.random(shape) >= rate) / (1 - rate) if training and rate else np.ones(1)

    def _convolved(self, x: np.ndarray):
        """Windows of steps as rows of a matrix product; the largest of each `pool` steps, a short rest pooled too."""
        n, steps, _ = x.shape
        left = (self.kernel - 1) // 2
        padded = np.pad(x, ((0, 0), (left, self.kernel - 1 - left), (0, 0)))
        windows = np.concatenate([padded[:, k : k + steps] for k in range(self.kernel)], axis=2)
        out = np.maximum(windows @ self.weights[0] + self.weights[1], 0)
        groups = -(-steps // self.pool)
        filled = np.pad(out, ((0, 0), (0, groups * self.pool - steps), (0, 0)), constant_values=-1.0).reshape(n, groups, self.pool, -1)
        return filled.max(axis=2), (windows, out, filled.argmax(axis=2))

    def _convolution_gradients(self, kept, upstream: np.ndarray) -> list[np.ndarray]:
        windows, out, where = kept
        n, steps, filters = out.shape
        spread = np.zeros((n, where.shape[1], self.pool, filters))
        np.put_along_axis(spread, where[:, :, None], upstream[:, :, None], axis=2)
        delta = spread.reshape(n, -1, filters)[:, :steps] * (out > 0)
        return [np.einsum("nsk,nsf->kf", windows, delta), delta.sum((0, 1))]

    def _layer(self, x: np.ndarray, w, u, b, mask):
        n, steps, _ = x.shape
        h, c, k = np.zeros((n, self.units)), np.zeros((n, self.units)), self.units
        states, hidden = [], []
        for t in range(steps):
            z = x[:, t] @ w + (h * mask) @ u + b
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            states.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            hidden.append((h, c))
        return np.stack([x_[0] for x_ in hidden], axis=1), states, hidden

    def forward(self, x: np.ndarray, training: bool = False):
        kept, front = [], None
        if self.filters:
            x, front = self._convolved(x)
        for layer in range(self.layers):
            mask, state_mask = self._mask(x.shape, self.drop, training), self._mask((len(x), self.units), self.recurrent, training)
            x = x * mask
            out, states, hidden = self._layer(x, *self._of_layer(layer), state_mask)
            kept.append((x, mask, state_mask, states, hidden))
            x = out
        return _sigmoid(x[:, -1] @ self.weights[-2] + self.weights[-1]), (front, kept), x

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, training: bool = True) -> list[np.ndarray]:
        p, (front, kept), top = self.forward(x, training)
        delta = (p - y) / y.size
        out = [top[:, -1].T @ delta, delta.sum(0)]
        upstream = np.zeros_like(top)
        upstream[:, -1] = delta @ self.weights[-2].T
        for layer in range(self.layers - 1, -1, -1):
            w, u, b = self._of_layer(layer)
            inputs, mask, state_mask, states, hidden = kept[layer]
            gw, gu, gb, gx = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b), np.zeros_like(inputs)
            dh, dc = np.zeros((len(x), self.units)), np.zeros((len(x), self.units))
            for t in range(inputs.shape[1] - 1, -1, -1):
                h0, c0, i, f, o, g = states[t]
                tc = np.tanh(hidden[t][1])
                dh = dh + upstream[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                gw += inputs[:, t].T @ dz
                gu += (h0 * state_mask).T @ dz
                gb += dz.sum(0)
                gx[:, t] = dz @ w.T
                dh, dc = (dz @ u.T) * state_mask, dc * f
            out = [gw, gu, gb, *out]
            upstream = gx * mask
        return [*self._convolution_gradients(front, upstream), *out] if self.filters else out


def rmsprop(model, squares: list[np.ndarray], x: np.ndarray, y: np.ndarray, step: float) -> None:
    """One step over a mini-batch, in place."""
    for i, g in enumerate(model.gradients(x, y)):
        squares[i] = 0.9 * squares[i] + 0.1 * g * g
        model.weights[i] = model.weights[i] - step * g / (np.sqrt(squares[i]) + 1e-7)


def fit(model, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 200, batch: int = 2048, patience: int = 15, least: float = 1e-5, step: float = 1e-3) -> list[dict]:
    """RMSprop on the cross entropy, stopped early by the validation loss; the best weights are put
    back.  Returns the history, one row an epoch.  No empty batch is ever drawn."""
    squares = [np.zeros_like(w) for w in model.weights]
    best, best_weights, waited, history = np.inf, [w.copy() for w in model.weights], 0, []
    for epoch in range(epochs):
        began = time.time()
        order = model.rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            rmsprop(model, squares, x[some], y[some], step)
        loss = cross_entropy(model.predict(xv), yv)
        history.append({"epoch": epoch, "loss": cross_entropy(model.predict(x), y), "val_loss": loss, "duration": time.time() - began})
        if loss < best - least:
            best, best_weights, waited = loss, [w.copy() for w in model.weights], 0
        else:
            waited += 1
            if waited >= patience:
                break
    model.weights = best_weights
    return history


def scores(rows: DataFrame, model, column: str = "x", above: float = 0.5) -> DataFrame:
    """(doc_id, label_id, y_score, y_pred) of rows (doc_id, x); nested arrays for a sequence model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.stack([np.asarray(s, float) for s in v]) if np.ndim(v[0]) else np.asarray(v, float) for v in batch[column]])
            p = shared.value.predict(x)
            n, k = p.shape
            yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), k), "label_id": np.tile(np.arange(k), n), "y_score": p.ravel(), "y_pred": (p.ravel() > above).astype(int)})

    return rows.select("doc_id", column).mapInPandas(run, "doc_id long, label_id int, y_score double, y_pred int")
