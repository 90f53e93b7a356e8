"""Covariance, PCA, SVD and affine projections of a vector table ``(point_id, x)``.

Up to ``DENSE_WIDTH`` columns tasks reduce their rows to ``D x D`` or smaller pieces, and only such model-sized results reach the
driver. Wider tables never have a ``D x D`` matrix in one place: covariances are tiles that the JVM adds up, and
leading directions come from iterating a block of ``k + 10`` of them over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.functions import arrays, linear
from manyscale.functions import batches as nb
from manyscale.plans import storage
from manyscale.plans.partials import FLUSH_VALUES, SCHEMA, SEGMENT, collect_sums, merge_partials, partial_rows, sum_partials

#: Columns up to which a ``D x D`` matrix may stand in one task or on the driver.
DENSE_WIDTH = 2048
#: Rows and columns of a tile of a wide covariance, and the values that a task gathers before it adds to its tiles.
TILE = 1024
TILE_ROWS_VALUES = 16_000_000
#: Directions beyond those asked for, the most passes over the rows, and when a block of directions counts as settled.
EXTRA, PASSES, SETTLED = 10, 60, 1e-10
PILOT_ROWS = 256
FAN_IN = 16


def table_width(df: DataFrame, x_col: str = "x") -> int:
    first = df.select(F.size(x_col).alias("d")).first()
    if first is None:
        raise ValueError("the table is empty")
    return first.d


def moments(df: DataFrame, x_col: str = "x", width: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population covariance in one pass.

    Sums are taken around the mean of a few rows. The shift cancels out exactly in the algebra
    and keeps the numbers small, so that one pass loses no digits.
    """
    rows = df.select(arrays.doubles(x_col).alias("x"))
    width = width or table_width(rows)
    shift = np.mean([r.x for r in rows.limit(PILOT_ROWS).collect()], axis=0)

    def extract(batch):
        x = nb.to_matrix(batch.column("x")) - shift
        yield 0, 0, len(x), x.T @ x
        yield 0, 1, len(x), x.sum(axis=0)

    sums = collect_sums(sum_partials(rows, ["x"], extract))
    n, gram = sums[0, 0]
    offset = sums[0, 1][1] / n
    return n, shift + offset, gram.reshape(width, width) / n - np.outer(offset, offset)


def entries(spark, matrix: np.ndarray) -> DataFrame:
    """A model-sized matrix as ``(i, j, v)``."""
    i, j = np.indices(matrix.shape).reshape(2, -1)
    return spark.createDataFrame(pa.table({"i": i, "j": j, "v": matrix.ravel()}))


def column_moments(df: DataFrame, x_col: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population variance of every column, in one pass around the mean of a few rows."""
    rows = df.select(arrays.doubles(x_col).alias("x"))
    table_width(rows)
    shift = np.mean([r.x for r in rows.limit(PILOT_ROWS).collect()], axis=0)

    def extract(batch):
        x = nb.to_matrix(batch.column("x")) - shift
        yield 0, 0, len(x), x.sum(axis=0)
        yield 0, 1, len(x), (x * x).sum(axis=0)

    sums = collect_sums(sum_partials(rows, ["x"], extract))
    n, total = sums[0, 0]
    offset = total / n
    return n, shift + offset, np.maximum(sums[0, 1][1] / n - offset * offset, 0.0)


def covariance_tiles(df: DataFrame, x_col: str = "x", tile: int = TILE) -> DataFrame:
    """Population covariance as ``(bi, bj, row, v)`` with ``bi <= bj``: one row of a tile of ``tile`` columns each.

    A task gathers rows, adds up their products tile by tile, and gives tiles out as soon as they are too many to hold. The
    JVM merges tiles in segments, so neither a task nor the driver holds more than a few of them.
    """
    n, mean, variance = column_moments(df, x_col)
    width = len(mean)
    rows, edges = df.select(arrays.doubles(x_col).alias("x")), [*range(0, width, tile), width]
    count = len(edges) - 1
    shipped = storage.checked_broadcast(df.sparkSession, mean, mean.nbytes, "the column means")

    def task(it: Iterator[pa.RecordBatch]):
        held: dict[tuple[int, int], list] = {}
        waiting: list[np.ndarray] = []

        def add():
            x = np.vstack(waiting)
            waiting.clear()
            for bi in range(count):
                for bj in range(bi, count):
                    part = x[:, edges[bi] : edges[bi + 1]].T @ x[:, edges[bj] : edges[bj + 1]]
                    slot = held.setdefault((bi * count + bj, 0), [0, np.zeros(part.size)])
                    slot[0] += len(x)
                    slot[1] += part.ravel()
                    if sum(s.size for _, s in held.values()) > FLUSH_VALUES:
                        yield from partial_rows(held)
                        held.clear()

        for batch in it:
            step = max(1, TILE_ROWS_VALUES // width)
            for s in range(0, batch.num_rows, step):
                waiting.append(nb.to_matrix(batch.slice(s, step).column("x")) - shipped.value)
                if sum(len(x) for x in waiting) >= step:
                    yield from add()
        if waiting:
            yield from add()
        yield from partial_rows(held)

    merged = merge_partials(rows.mapInArrow(task, SCHEMA))
    # A segment holds a run of a tile's values, which may begin and end within a row of the tile.
    runs = merged.select((F.col("node_id") / count).cast("int").alias("bi"), (F.col("node_id") % count).cast("int").alias("bj"),
                         (F.col("segment").cast("long") * SEGMENT).alias("at"), F.transform("s", lambda v: v / F.lit(float(n))).alias("s"))
    runs = runs.withColumn("w", F.least(F.lit(tile), F.lit(width) - F.col("bj") * tile).cast("long"))
    cut = F.expr("""transform(sequence(at div w, (at + size(s) - 1) div w), row -> named_struct('row', CAST(row AS INT), 'first', greatest(row * w, at),
        'part', slice(s, CAST(greatest(row * w, at) - at + 1 AS INT), CAST(least((row + 1) * w, at + size(s)) - greatest(row * w, at) AS INT))))""")
    pieces = runs.select("bi", "bj", F.explode(cut).alias("p")).select("bi", "bj", "p.*")
    return pieces.groupBy("bi", "bj", "row").agg(F.sort_array(F.collect_list(F.struct("first", "part"))).alias("parts")).select(
        "bi", "bj", "row", F.flatten("parts.part").alias("v"))


def tile_entries(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles on and above the diagonal as the entries ``(i, j, v)`` of the whole symmetric matrix."""
    flat = tiles.select("bi", "bj", (F.col("bi") * tile + F.col("row")).cast("long").alias("i"), F.posexplode("v").alias("at", "v"))
    upper = flat.select("bi", "bj", "i", (F.col("bj") * tile + F.col("at")).cast("long").alias("j"), "v")
    mirrored = upper.where("bi < bj").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return upper.select("i", "j", "v").unionByName(mirrored)


def covariance(df: DataFrame, x_col: str = "x") -> DataFrame:
    """Population covariance as ``(i, j, v)``."""
    width = table_width(df, x_col)
    if width > DENSE_WIDTH:
        return tile_entries(covariance_tiles(df, x_col))
    return entries(df.sparkSession, moments(df, x_col, width)[2])


@dataclass
class PrincipalAxes:
    """``components`` has one direction per row; ``eigenvalues`` holds the largest ones, all of them up to ``DENSE_WIDTH`` columns."""

    components: np.ndarray
    eigenvalues: np.ndarray
    mean: np.ndarray
    n: int
    #: The sum of all eigenvalues.
    total: float

    def scores(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """``x . components`` of the rows as they are, without centering."""
        return project(df, self.components, None, x_col=x_col, out="scores")


def leading_directions(df: DataFrame, k: int, center: np.ndarray, x_col: str = "x", passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the sum of ``(x - center)^T (x - center)`` and their vectors as rows.

    A block of ``k + EXTRA`` directions is multiplied with the rows pass after pass until the leading ones no longer turn; a
    pass ships ``D x (k + EXTRA)`` numbers each way.
    """
    rows, width = df.select(arrays.doubles(x_col).alias("x")), len(center)
    size = min(width, k + EXTRA)
    frame = np.linalg.qr(np.random.default_rng(0).normal(size=(width, size)))[0]
    values, vectors = np.zeros(k), frame.T[:k]
    for _ in range(passes):
        shipped = storage.checked_broadcast(df.sparkSession, (frame, center), frame.nbytes + center.nbytes, "a block of directions")

        def extract(batch):
            x = nb.to_matrix(batch.column("x")) - shipped.value[1]
            yield 0, 0, len(x), (x.T @ (x @ shipped.value[0])).ravel()

        image = collect_sums(sum_partials(rows, ["x"], extract))[0, 0][1].reshape(width, size)
        shipped.unpersist()
        small = frame.T @ image
        found, turn = linear.descending_eigen((small + small.T) / 2)
        values, vectors = np.maximum(found[:k], 0.0), (frame @ turn.T).T[:k]
        off = nb.row_norms((image @ turn[:k].T - frame @ turn[:k].T * found[:k]).T)
        if size == width or (off <= SETTLED * max(found[0], 1e-300)).all():
            break
        frame = np.linalg.qr(image)[0]
    return values, linear.fix_signs(vectors)


def pca(df: DataFrame, k: int = 2, x_col: str = "x") -> PrincipalAxes:
    width = table_width(df, x_col)
    if width > DENSE_WIDTH:
        n, mean, variance = column_moments(df, x_col)
        values, vectors = leading_directions(df, k, mean, x_col)
        return PrincipalAxes(vectors, values / n, mean, n, float(variance.sum()))
    n, mean, cov = moments(df, x_col, width)
    values, vectors = linear.descending_eigen(cov)
    return PrincipalAxes(vectors[:k], values, mean, n, float(values.sum()))


def variance_explained(df: DataFrame, k: int = 1, x_col: str = "x") -> float:
    axes = pca(df, k, x_col)
    return float(axes.eigenvalues[:k].sum() / axes.total)


def ml_pca(df: DataFrame, k: int = 2, x_col: str = "x") -> DataFrame:
    """The library's own PCA: the rows with their projection in ``pca_features``."""
    vectors = df.withColumn("_features", array_to_vector(arrays.doubles(x_col)))
    model = PCA(k=k, inputCol="_features", outputCol="_projected").fit(vectors)
    return model.transform(vectors).withColumn("pca_features", vector_to_array("_projected")).drop("_features", "_projected")


def reduce_rows(df: DataFrame, shrink: Callable[[np.ndarray], np.ndarray], x_col: str = "x") -> np.ndarray:
    """Fold all rows into one small matrix with ``shrink``, which replaces stacked rows by fewer.

    Each task folds its own rows; the pieces are then folded ``FAN_IN`` at a time in the order of
    the partitions, so a task holds ``FAN_IN`` pieces at most.
    """
    rows = df.select(arrays.doubles(x_col).alias("x"))

    def task(it: Iterator[pa.RecordBatch]):
        held = None
        for batch in it:
            if batch.num_rows:
                x = nb.to_matrix(batch.column("x"))
                held = shrink(x if held is None else np.vstack([held, x]))
        if held is not None:
            yield piece(TaskContext.get().partitionId(), held)

    def piece(key: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([m.shape[1]], pa.int32()), nb.from_matrix(m.reshape(1, -1))],
            names=["piece", "width", "m"])

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(nb.to_numpy(table.column("piece")))
        stack = [np.array(table.column("m")[int(i)].as_py()).reshape(-1, table.column("width")[int(i)].as_py()) for i in order]
        key = table.column("piece")[int(order[0])].as_py() // FAN_IN
        return pa.Table.from_batches([piece(key, shrink(np.vstack(stack)))])

    schema = "piece long, width int, m array<double>"
    pieces, left = rows.mapInArrow(task, schema), rows.rdd.getNumPartitions()
    while left > 1:
        pieces = pieces.groupBy(F.floor(F.col("piece") / FAN_IN).alias("group")).applyInArrow(fold, schema)
        left = -(-left // FAN_IN)
    held = [np.array(p.m).reshape(-1, p.width) for p in sorted(pieces.collect(), key=lambda p: p.piece)]
    while len(held) > 1:  # the executed plan had more tasks than the one that was asked
        held = [shrink(np.vstack(held[s : s + FAN_IN])) for s in range(0, len(held), FAN_IN)]
    return held[0] if held else np.zeros((0, 0))


@dataclass
class Factors:
    """``A ~ U diag(s) V^T``; ``v`` holds the right vectors as columns."""

    s: np.ndarray
    v: np.ndarray
    u: DataFrame | None


def _left_vectors(df: DataFrame, s: np.ndarray, v: np.ndarray, x_col: str) -> DataFrame:
    return project(df, (v / s).T, None, x_col=x_col, out="u").drop(x_col)


def truncated_svd(df: DataFrame, k: int, compute_u: bool = False, r_cond: float = 1e-9, x_col: str = "x") -> Factors:
    """The ``k`` largest singular values; those below ``r_cond * s[0]`` are dropped.

    Rows are reduced by orthogonal factorisation, not through a Gram matrix, so small singular
    values keep their accuracy. Beyond ``DENSE_WIDTH`` columns the factors would be too large; leading directions are iterated there.
    """
    width = table_width(df, x_col)
    if width > DENSE_WIDTH:
        found, vectors = leading_directions(df, min(k, width), np.zeros(width), x_col)
        s = np.sqrt(found)
        keep = int((s > r_cond * s[0]).sum()) if s[0] > 0 else 0
        s, v = s[:keep], vectors[:keep].T
        return Factors(s, v, _left_vectors(df, s, v, x_col) if compute_u else None)
    triangle = reduce_rows(df, lambda m: np.linalg.qr(m, mode="r"), x_col)
    _, s, vt = np.linalg.svd(triangle, full_matrices=False)
    keep = int((s[:k] > r_cond * s[0]).sum()) if s[0] > 0 else 0
    s, v = s[:keep], linear.fix_signs(vt[:keep]).T
    return Factors(s, v, _left_vectors(df, s, v, x_col) if compute_u else None)


def incremental_svd(df: DataFrame, k: int, compute_u: bool = False, x_col: str = "x") -> Factors:
    """Rank-``k`` SVD that never keeps more than ``k`` directions between steps.

    Rows are absorbed batch by batch and the pieces merged in partition order, each time cut back
    to rank ``k``. Exact when the data has rank ``k`` or less, otherwise close.
    """

    def cut(m: np.ndarray) -> np.ndarray:
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        return s[:k, None] * vt[:k]

    held = reduce_rows(df, cut, x_col)
    s = nb.row_norms(held)
    some = s > 0
    s, v = s[some], linear.fix_signs(held[some] / s[some, None]).T
    return Factors(s, v, _left_vectors(df, s, v, x_col) if compute_u else None)


@dataclass
class DirectionsSketch:
    """Rows ``b`` that stand for a table ``A``: ``0 <= |A v|^2 - |b v|^2 <= bound`` for every unit vector ``v``."""

    b: np.ndarray
    #: The sum of all squares of the table.
    energy: float
    bound: float

    def top(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Approximate singular values, too small by no more than the bound in their squares, and right vectors as columns."""
        _, s, vt = np.linalg.svd(self.b, full_matrices=False)
        return s[:k], linear.fix_signs(vt[:k]).T


def frequent_directions(df: DataFrame, size: int, x_col: str = "x") -> DirectionsSketch:
    """A sketch of ``size`` rows with a guarantee, whatever the data.

    Each step cuts the squares of all directions by that of the first one that has to go. A cut of ``c`` takes at least ``(size + 1) c`` from
    the sum of squares, so what is missing there in the end bounds the cuts of any direction, in any order of merging. The bound
    is at most ``energy / (size + 1)``, and small if a few directions carry the table.
    """
    if size < 1:
        raise ValueError("a sketch needs at least one row")

    def cut(m: np.ndarray) -> np.ndarray:
        _, s, vt = np.linalg.svd(linear.triangle(m), full_matrices=False)
        gone = s[size] ** 2 if len(s) > size else 0.0
        return np.sqrt(np.maximum(s[:size] ** 2 - gone, 0.0))[:, None] * vt[:size]

    energy = df.select(F.sum(arrays.dot(arrays.doubles(x_col), arrays.doubles(x_col)))).first()[0]
    if energy is None:
        raise ValueError("the table is empty")
    b = reduce_rows(df, cut, x_col)
    return DirectionsSketch(b, float(energy), max(0.0, float(energy) - float((b * b).sum())) / (size + 1))


def _with_vectors(df: DataFrame, x_col: str, out: str, compute: Callable[[np.ndarray], np.ndarray], model, n_bytes: int):
    """The rows with one more vector column computed from ``x`` and a broadcast model."""
    shipped = storage.checked_broadcast(df.sparkSession, model, n_bytes, "the projection")
    wide = df.withColumn("_x", arrays.doubles(x_col))

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                made = nb.from_matrix(compute(nb.to_matrix(batch.column("_x")), *shipped.value))
                yield batch.drop_columns(["_x"]).append_column(out, made)

    return wide.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _checked(df: DataFrame, basis, center, x_col: str) -> tuple[np.ndarray, np.ndarray]:
    basis = np.asarray(basis, dtype=float)
    center = np.zeros(basis.shape[1]) if center is None else np.asarray(center, dtype=float)
    if center.shape != (basis.shape[1],):
        raise ValueError(f"center of length {center.size} does not fit directions of length {basis.shape[1]}")
    if not df.isStreaming:
        first = df.select(F.size(x_col).alias("d")).first()
        if first is not None and first.d != basis.shape[1]:
            raise ValueError(f"vectors of length {first.d} do not fit directions of length {basis.shape[1]}")
    return basis, center


def project(df: DataFrame, basis, center=None, *, x_col: str = "x", out: str = "z") -> DataFrame:
    """``z = basis (x - center)``, with the directions as rows of ``basis``."""
    model = _checked(df, basis, center, x_col)
    return _with_vectors(df, x_col, out, lambda x, b, c: (x - c) @ b.T, model, model[0].nbytes)


def affine_reconstruct(df: DataFrame, basis, center=None, *, x_col: str = "x", out: str = "x_hat") -> DataFrame:
    """``basis^T basis (x - center) + center``; the ``D x D`` projector is never formed."""
    model = _checked(df, basis, center, x_col)
    return _with_vectors(df, x_col, out, lambda x, b, c: (x - c) @ b.T @ b + c, model, model[0].nbytes)


def projector(basis) -> np.ndarray:
    """The ``D x D`` matrix ``basis^T basis`` itself, for small ``D``."""
    basis = np.asarray(basis, dtype=float)
    return basis.T @ basis
