"""Classifiers on feature vectors ``(point_id, x, label)``, their scores, and parameter sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.functions import arrays
from manyscale.functions import batches as nb
from manyscale.operators import labels as splits
from manyscale.operators import tree as cells
from manyscale.operators.decomposition import _with_vectors, table_width
from manyscale.operators.neighbours import knn_join, knn_sweep
from manyscale.plans import storage, workers
from manyscale.plans.partials import collect_sums, sum_partials

ALPHA = 0.0001


def knn_classify(train: DataFrame, test: DataFrame, k: int, *, exclude_self: bool = False, **options) -> DataFrame:
    """Majority label of the ``k`` nearest training rows, ties to the smaller label: ``(point_id, prediction)``.

    Labels travel with the neighbours, and a query's at most ``k`` votes meet where they were ranked.
    """
    found = knn_join(test, train, k, payload=["label"], exclude_self=exclude_self, **options)
    return found.groupBy(F.col("q_id").alias("point_id")).agg(F.mode("label", True).alias("prediction"))


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(n, accuracy)`` in percent."""
    return predictions.agg(F.count(F.lit(1)).alias("n"),
                           (F.avg((F.col(prediction) == F.col(label)).cast("double")) * 100).alias("accuracy"))


def class_labels(df: DataFrame, max_classes: int = 10_000) -> list:
    """The labels in order. A model has a vector for each of them, so more than ``max_classes`` are refused."""
    found = [r.label for r in df.select("label").distinct().orderBy("label").limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    if len(found) < 2:
        raise ValueError("training needs at least two classes")
    return found


@dataclass
class LinearModel:
    """One-vs-rest linear scores ``x . weights[c] + bias[c]``."""

    classes: list
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """The rows with a ``prediction`` column; the first of equal scores wins."""
        scored = _with_vectors(df, x_col, "_scores", lambda x, w, b: x @ w.T + b, (self.weights, self.bias), self.weights.nbytes)
        best = F.array_position("_scores", F.array_max("_scores")).cast("int")
        return scored.withColumn("prediction", F.element_at(F.lit(self.classes), best)).drop("_scores")


def _hinge_step(w, x, signs, t):
    """Stochastic hinge loss with an L2 penalty and the usual decreasing step size."""
    typical = math.sqrt(1.0 / math.sqrt(ALPHA))
    rate = 1.0 / (ALPHA * (1.0 / (ALPHA * typical) + t))
    margin = signs * (w @ x)
    w[:, :-1] *= 1.0 - rate * ALPHA
    w += np.where(margin < 1.0, rate * signs, 0.0)[:, None] * x


def _perceptron_step(w, x, signs, t):
    w += np.where(signs * (w @ x) <= 0.0, signs, 0.0)[:, None] * x


def _passive_step(limit: float, soft: float):
    def step(w, x, signs, t):
        loss = np.maximum(0.0, 1.0 - signs * (w @ x))
        w += (np.minimum(limit, loss / (x @ x + soft)) * signs)[:, None] * x

    return step


PASSIVE_C = 1.0
STEPS: dict[str, tuple[Callable, bool]] = {
    "sgd": (_hinge_step, False),
    "asgd": (_hinge_step, True),
    "perceptron": (_perceptron_step, False),
    "passive_aggressive_1": (_passive_step(PASSIVE_C, 0.0), False),
    "passive_aggressive_2": (_passive_step(math.inf, 1.0 / (2 * PASSIVE_C)), False),
}


def parallel_linear(train: DataFrame, algorithm: str, *, rounds: int = 5, n_workers: int | None = None, seed: int = 0,
                    key: str = "point_id", by_key: bool = False) -> LinearModel:
    """A linear classifier trained row by row within workers and averaged over them after every round.

    ``asgd`` also averages over the steps of the later rounds. Rows come in the order of a hash of their key, or with one
    worker ``by_key``. The update of a row needs the weights that the row before it left, so a worker takes them one at a time.
    """
    if algorithm not in STEPS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known are {sorted(STEPS)}")
    step, averaged = STEPS[algorithm]
    classes = class_labels(train)
    n_workers = n_workers or workers.worker_count(train)
    rows = workers.laid_out(train.select(key, arrays.doubles("x").alias("x"), "label"), key, n_workers, seed, by_key)
    width = table_width(rows)

    def epoch(batches: Iterator[pa.RecordBatch], parameters):
        start, t = parameters
        w, total, n = start.copy(), np.zeros_like(start), 0
        for batch in batches:
            x = nb.to_matrix(batch.column("x"))
            x = np.hstack([x, np.ones((len(x), 1))])
            at = {c: i for i, c in enumerate(classes)}
            rows_of = np.array([at[v] for v in batch.column("label").to_pylist()])
            for row, c in zip(x, rows_of):
                signs = np.full(len(classes), -1.0)
                signs[c] = 1.0
                n += 1
                step(w, row, signs, t + n)
                total += w
        return (n, [n * w.ravel(), total.ravel()]) if n else None

    w, mean, seen = np.zeros((len(classes), width + 1)), np.zeros((len(classes), width + 1)), 0
    for turn in range(rounds):
        n, (last, total) = workers.train_round(rows, (w, seen // n_workers), w.nbytes, epoch)
        w = last.reshape(w.shape) / n
        if turn > 0 or rounds == 1:
            mean += total.reshape(w.shape) / n
        seen += n
    final = mean / max(1, rounds - 1) if averaged else w
    return LinearModel(classes, final[:, :-1], final[:, -1])


def random_features(df: DataFrame, size: int = 256, gamma: float | None = None, seed: int = 0, x_col: str = "x") -> DataFrame:
    """Random Fourier features of a Gaussian kernel, added as column ``features``. An approximation."""
    width = table_width(df, x_col)
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * (1.0 / width if gamma is None else gamma)), size=(width, size))
    phase = rng.uniform(0, 2 * math.pi, size)
    return _with_vectors(df, x_col, "features", lambda x, u, p: math.sqrt(2.0 / len(p)) * np.cos(x @ u + p), (w, phase), w.nbytes)


def _indexed(df: DataFrame, classes: list, features: str) -> DataFrame:
    position = F.array_position(F.lit(classes), F.col("label")) - 1
    return df.select("*", array_to_vector(arrays.doubles(features)).alias("_f"), position.cast("double").alias("_c"))


def _library_predict(fitted, classes: list, test: DataFrame, features: str) -> DataFrame:
    """Predictions of a library model, with class positions turned back into labels."""
    scored = fitted.transform(test.withColumn("_f", array_to_vector(arrays.doubles(features))))
    return scored.withColumn("prediction", F.element_at(F.lit(classes), F.col("_p").cast("int") + 1)).select(*test.columns, "prediction")


def svm(train: DataFrame, test: DataFrame, *, size: int = 256, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """Support vector machine with a Gaussian kernel, approximated by random features under linear machines."""
    classes = class_labels(train)
    lift = lambda df: random_features(df, size, gamma, seed)
    machine = LinearSVC(featuresCol="_f", labelCol="_c", predictionCol="_p", maxIter=50, tol=1e-3)
    fitted = OneVsRest(classifier=machine, featuresCol="_f", labelCol="_c", predictionCol="_p", parallelism=4).fit(_indexed(lift(train), classes, "features"))
    return _library_predict(fitted, classes, lift(test), "features").drop("features")


@dataclass
class LogisticModel:
    """Multinomial probabilities ``softmax(x . weights[c] + bias[c])``, fitted by the library."""

    classes: list
    weights: np.ndarray
    bias: np.ndarray
    reg: float

    def predict(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        return LinearModel(self.classes, self.weights, self.bias).predict(df, x_col)

    def slopes(self, df: DataFrame) -> DataFrame:
        """``(label, n, g)``: the gradient of the penalised mean loss over ``(x, label)`` for each class, the last number for the bias; zero at the optimum."""
        shipped = storage.checked_broadcast(df.sparkSession, (self.weights, self.bias), self.weights.nbytes, "the weights")
        rows = _indexed(df, self.classes, "x").select(arrays.doubles("x").alias("x"), F.col("_c").cast("int").alias("c"))

        def extract(batch):
            x, c = nb.to_matrix(batch.column("x")), nb.to_numpy(batch.column("c"))
            score = x @ shipped.value[0].T + shipped.value[1]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(c)), c] -= 1.0
            for k in range(p.shape[1]):
                yield k, 0, len(x), p[:, k] @ np.hstack([x, np.ones((len(x), 1))])

        summed = sum_partials(rows, ["x", "c"], extract)
        pull = {k: np.append(self.reg * w, 0.0) for k, w in enumerate(self.weights)}
        found = [(self.classes[k], n, (s / n + pull[k]).tolist()) for (k, _), (n, s) in sorted(collect_sums(summed).items())]
        schema = T.StructType([T.StructField("label", df.schema["label"].dataType), T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
        return df.sparkSession.createDataFrame(found, schema)


def fit_logistic(train: DataFrame, *, tol: float = 0.1, reg: float = 0.0, max_iter: int = 100, standardize: bool = True) -> LogisticModel:
    """Multinomial logistic regression; ``reg`` weighs half the squared weights, of standardized columns unless told otherwise."""
    classes = class_labels(train)
    machine = LogisticRegression(featuresCol="_f", labelCol="_c", family="multinomial", tol=tol, regParam=reg, maxIter=max_iter, standardization=standardize)
    fitted = machine.fit(_indexed(train, classes, "x"))
    return LogisticModel(classes, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), reg)


def logistic(train: DataFrame, test: DataFrame, *, tol: float = 0.1, reg: float = 0.0) -> DataFrame:
    """Multinomial logistic regression with a loose stopping tolerance."""
    return fit_logistic(train, tol=tol, reg=reg).predict(test)


def _knn_predict(k: int):
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.join(knn_classify(train, test, k), "point_id")

    return run


def _linear_predict(algorithm: str):
    return lambda train, test: parallel_linear(train, algorithm).predict(test)


CLASSIFIERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "knn_3": _knn_predict(3), "knn_7": _knn_predict(7), "knn_30": _knn_predict(30), "svm": svm, "logistic": logistic,
    **{name: _linear_predict(name) for name in STEPS},
}


def classify_split(train: DataFrame, test: DataFrame, classifier: str | Callable) -> DataFrame:
    """Fit on ``train``, predict ``test``: one row ``(classifier, n, accuracy)``."""
    run = CLASSIFIERS[classifier] if isinstance(classifier, str) else classifier
    name = classifier if isinstance(classifier, str) else getattr(classifier, "__name__", "custom")
    return accuracy(run(train, test)).select(F.lit(name).alias("classifier"), "n", "accuracy")


def classify(df: DataFrame, classifier: str | Callable, test_share: float = 0.3, *, method: str = "hash", seed: int = 0) -> DataFrame:
    """As ``classify_split`` on a repeatable split that holds ``test_share`` back."""
    train, test = splits.train_test_split(df, 1 - test_share, method=method, seed=seed)
    return classify_split(train, test, classifier)


def sweep_knn(train: DataFrame, test: DataFrame, ks: Sequence[int], dims: Sequence[int], levels: Sequence[int], widest: int) -> DataFrame:
    """Accuracy of ``k``-neighbour votes for every cut of the features, from one join: ``(classifier, d, r, n, accuracy)``.

    Features hold ``widest`` numbers for each level; see ``knn_sweep``.
    """
    found = knn_sweep(test, train, max(ks), dims, levels, widest, payload=["label"])
    votes = found.groupBy("dim", "levels", F.col("q_id").alias("point_id")).agg(
        *(F.mode(F.when(F.col("rank") <= k, F.col("label")), True).alias(f"knn_{k}") for k in ks))
    judged = votes.join(test.select("point_id", "label"), "point_id")
    hits = judged.groupBy("dim", "levels").agg(
        F.count(F.lit(1)).alias("n"), *((F.avg((F.col(f"knn_{k}") == F.col("label")).cast("double")) * 100).alias(f"knn_{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(f"knn_{k}").alias("classifier"), F.col(f"knn_{k}").alias("accuracy")) for k in ks)))
    return hits.select(F.col("dim").alias("d"), F.col("levels").alias("r"), "n", each.alias("e")).select("e.classifier", "d", "r", "n", "e.accuracy")


def sweep(points: DataFrame, classifiers: Sequence[str], dims: Sequence[int], levels: Sequence[int], *,
          test_share: float = 0.2, tree: cells.CellTree | None = None) -> DataFrame:
    """Accuracy for every manifold dimension and number of levels: ``(classifier, d, r, n, accuracy)``.

    The tree is fitted once at the largest values and its features stored; smaller settings cut them. All neighbour votes come
    from one join, the other classifiers are trained for each setting.
    """
    tree = tree or cells.fit_tree(points, max(dims), max(levels) - 1)
    widest, deepest = max(dims), max(levels)
    full = storage.materialize(cells.feature_vectors(points, tree, deepest, widest, keep=["label"]))
    voting = [int(name.removeprefix("knn_")) for name in classifiers if name.startswith("knn_")]
    out = None
    if voting:
        train, test = splits.train_test_split(full, 1 - test_share)
        out = sweep_knn(train, test, voting, dims, levels, widest)
    for d in dims:
        for r in levels:
            cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda j: F.slice("x", j * widest + 1, d)))
            features = full.select("point_id", cut.alias("x"), "label")
            for name in classifiers:
                if name.startswith("knn_"):
                    continue
                row = classify(features, name, test_share).select("classifier", F.lit(d).alias("d"), F.lit(r).alias("r"), "n", "accuracy")
                out = row if out is None else out.unionByName(row)
    return out
