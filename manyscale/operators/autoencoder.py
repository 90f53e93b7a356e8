"""Autoencoders trained data-parallel on a vector table, and batch scoring with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.functions import arrays
from manyscale.functions import batches as nb
from manyscale.operators.decomposition import _with_vectors, table_width
from manyscale.plans import workers

# The default decay and stabiliser of RMSProp.
RMS_DECAY = 0.9
RMS_EPSILON = 1e-10


def _sigmoid(v):
    return 0.5 * (1.0 + np.tanh(0.5 * v))


# Each activation with its slope, as a function of the activation's output.
ACTIVATIONS = {
    "relu": (lambda v: np.maximum(v, 0.0), lambda out: (out > 0).astype(float)),
    "sigmoid": (_sigmoid, lambda out: out * (1.0 - out)),
}


@dataclass
class Autoencoder:
    """Weights and biases of all layers, encoder first. Every layer is followed by the activation."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activation: str = "relu"

    @property
    def n_bytes(self) -> int:
        return sum(a.nbytes for a in (*self.weights, *self.biases))

    @staticmethod
    def random(width: int, hidden: Sequence[int], activation: str = "relu", stddev: float = 1.0, seed: int = 0) -> Autoencoder:
        """Layer sizes ``width, hidden..., reversed(hidden)..., width`` with normal weights and biases."""
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}; known are {sorted(ACTIVATIONS)}")
        sizes = [width, *hidden, *list(hidden)[-2::-1], width]
        rng = np.random.default_rng(seed)
        pairs = list(zip(sizes, sizes[1:]))
        return Autoencoder([rng.normal(scale=stddev, size=p) for p in pairs], [rng.normal(scale=stddev, size=p[1]) for p in pairs], activation)

    def outputs(self, x: np.ndarray, layers: slice = slice(None)) -> list[np.ndarray]:
        """The input followed by the output of each layer."""
        act, out = ACTIVATIONS[self.activation][0], [x]
        for w, b in zip(self.weights[layers], self.biases[layers]):
            out.append(act(out[-1] @ w + b))
        return out

    def gradients(self, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean squared reconstruction error of the rows and its gradients, weights before biases."""
        slope = ACTIVATIONS[self.activation][1]
        out = self.outputs(x)
        gap = out[-1] - x
        back = 2.0 * gap / gap.size * slope(out[-1])
        dw, db = [None] * len(self.weights), [None] * len(self.biases)
        for layer in range(len(self.weights) - 1, -1, -1):
            dw[layer], db[layer] = out[layer].T @ back, back.sum(axis=0)
            if layer:
                back = back @ self.weights[layer].T * slope(out[layer])
        return float((gap * gap).mean()), [*dw, *db]

    def parameters(self, spark: SparkSession) -> DataFrame:
        """The model as ``(layer, kind, i, j, v)``."""
        rows = None
        for layer, (w, b) in enumerate(zip(self.weights, self.biases)):
            for kind, m in (("weight", w), ("bias", b[None, :])):
                i, j = np.indices(m.shape).reshape(2, -1)
                part = spark.createDataFrame(pa.table({
                    "layer": np.full(m.size, layer, np.int32), "kind": [kind] * m.size, "i": i, "j": j, "v": m.ravel()}))
                rows = part if rows is None else rows.unionByName(part)
        return rows

    @staticmethod
    def from_parameters(parameters: DataFrame, activation: str) -> Autoencoder:
        table = parameters.toPandas()
        weights, biases = [], []
        for layer in sorted(table.layer.unique()):
            for kind, into in (("weight", weights), ("bias", biases)):
                part = table[(table.layer == layer) & (table.kind == kind)]
                m = np.zeros((part.i.max() + 1, part.j.max() + 1))
                m[part.i, part.j] = part.v
                into.append(m if kind == "weight" else m[0])
        return Autoencoder(weights, biases, activation)


def _stepper(optimizer: str, rate: float):
    """``step(parameters, gradients, state)`` in place; ``state`` holds the running second moments by position."""

    def descend(parameters, gradients, state):
        for p, g in zip(parameters, gradients):
            p -= rate * g

    def rmsprop(parameters, gradients, state):
        for at, (p, g) in enumerate(zip(parameters, gradients)):
            seen = state.setdefault(at, np.ones_like(p))
            seen *= RMS_DECAY
            seen += (1 - RMS_DECAY) * g * g
            p -= rate * g / np.sqrt(seen + RMS_EPSILON)

    known = {"gradient_descent": descend, "rmsprop": rmsprop}
    if optimizer not in known:
        raise ValueError(f"unknown optimizer {optimizer!r}; known are {sorted(known)}")
    return known[optimizer]


def fit_autoencoder(df: DataFrame, hidden: Sequence[int], *, activation: str = "relu", optimizer: str = "rmsprop",
                    lr: float = 0.01, epochs: int = 5, batch: int = 100, stddev: float = 1.0, seed: int = 0,
                    mode: str = "average", n_workers: int | None = None, key: str = "point_id",
                    start: Autoencoder | None = None) -> tuple[Autoencoder, DataFrame]:
    """Train on ``(point_id, x)``; returns the model and ``(epoch, cost)`` rows.

    ``mode='average'``: workers run mini-batch steps of ``batch`` rows on their own rows, and the
    parameters and the optimizer's moments are averaged after every epoch, so that one worker trains as if there were no
    epochs. ``mode='gradient'``: the exact gradient over all rows is summed and one step is taken per epoch. An epoch is
    one job in both. Training begins at ``start`` or at random weights of the ``hidden`` sizes.
    """
    if mode not in ("average", "gradient"):
        raise ValueError("mode must be 'average' or 'gradient'")
    step, spark = _stepper(optimizer, lr), df.sparkSession
    n_workers = n_workers or workers.worker_count(df)
    rows = workers.laid_out(df.select(key, arrays.doubles("x").alias("x")), key, n_workers, seed)
    model = start or Autoencoder.random(table_width(rows), hidden, activation, stddev, seed)
    activation = model.activation
    shapes = [a.shape for a in (*model.weights, *model.biases)]
    moments = [np.ones(s) for s in shapes] if mode == "average" and optimizer == "rmsprop" else []

    def chunks(batches: Iterator[pa.RecordBatch]):
        rest = None
        for b in batches:
            x = nb.to_matrix(b.column("x"))
            x = x if rest is None else np.vstack([rest, x])
            whole = len(x) // batch * batch
            for s in range(0, whole, batch):
                yield x[s : s + batch]
            rest = x[whole:]
        if rest is not None and len(rest):
            yield rest

    def train(batches, shipped: tuple[Autoencoder, list[np.ndarray]]):
        now, seen = shipped
        local = Autoencoder([w.copy() for w in now.weights], [b.copy() for b in now.biases], now.activation)
        state, n, cost = {at: m.copy() for at, m in enumerate(seen)}, 0, 0.0
        sums = [np.zeros(s) for s in shapes]
        for x in chunks(batches):
            loss, grads = local.gradients(x)
            cost += loss * len(x)
            n += len(x)
            if mode == "average":
                step([*local.weights, *local.biases], grads, state)
            else:
                for s, g in zip(sums, grads):
                    s += len(x) * g
        if n == 0:
            return None
        if mode == "average":
            sums = [n * p for p in (*local.weights, *local.biases, *(state[at] for at in range(len(seen))))]
        return n, [np.array([cost]), *sums]

    costs, state = [], {}
    for epoch in range(1, epochs + 1):
        n, (cost, *sums) = workers.train_round(rows, (model, moments), 2 * model.n_bytes, train)
        means = [(s / n).reshape(shape) for s, shape in zip(sums, shapes * 2)]
        if mode == "average":
            model = Autoencoder(means[: len(model.weights)], means[len(model.weights) : len(shapes)], activation)
            moments = means[len(shapes) :]
        else:
            step([*model.weights, *model.biases], means, state)
        costs.append((epoch, float(cost[0] / n)))
    return model, spark.createDataFrame(costs, "epoch int, cost double")


def encode(df: DataFrame, model: Autoencoder, *, x_col: str = "x", out: str = "code") -> DataFrame:
    """The rows with the output of the last encoder layer."""
    half = slice(0, len(model.weights) // 2)
    return _with_vectors(df, x_col, out, lambda x, m: m.outputs(x, half)[-1], (model,), model.n_bytes)


def reconstruct(df: DataFrame, model: Autoencoder, *, x_col: str = "x", out: str = "x_hat") -> DataFrame:
    """The rows encoded and decoded again."""
    return _with_vectors(df, x_col, out, lambda x, m: m.outputs(x)[-1], (model,), model.n_bytes)


def reconstruction_error(df: DataFrame, x_col: str = "x", hat_col: str = "x_hat") -> DataFrame:
    """``(n, total, average)`` squared error over all rows, the average per entry. Lengths must agree."""
    same = F.size(x_col) == F.size(hat_col)
    gap = F.when(same, arrays.squared_distance(arrays.doubles(x_col), arrays.doubles(hat_col))).otherwise(
        F.raise_error(F.lit("a reconstruction differs in length from its input")).cast("double"))
    return df.select(gap.alias("e"), F.size(x_col).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("total"), (F.sum("e") / F.sum("d")).alias("average"))
