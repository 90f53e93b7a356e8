"""Window labels, slices, splits, and geometric features of frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.functions import batches as nb
from manyscale.sources.frames import fold_frames

WINDOW = 1000
TRAJECTORY = 100_000


def window_of(frame_no: str, window: int = WINDOW) -> Column:
    return F.floor(F.col(frame_no) / window).cast("long")


def midpoint_labels(frames: DataFrame, label: str, window: int = WINDOW, frame_no: str = "frame_no") -> DataFrame:
    """``(window_id, label)``: what the frame in the middle of each window says."""
    return frames.where(F.col(frame_no) % window == window // 2).select(
        window_of(frame_no, window).alias("window_id"), F.col(label).alias("label"))


def expand_window_labels(frames: DataFrame, labels: DataFrame, window: int = WINDOW, frame_no: str = "frame_no") -> DataFrame:
    """Frames with the label of the window they lie in: an equi-join on the window number."""
    return frames.withColumn("window_id", window_of(frame_no, window)).join(labels, "window_id")


def slice_per_trajectory(frames: DataFrame, start: int, stop: int, length: int = TRAJECTORY,
                         frame_no: str = "frame_no") -> DataFrame:
    """The frames ``start <= n < stop`` of every trajectory, counted from its own beginning."""
    at = F.pmod(F.col(frame_no), F.lit(length))
    return frames.where((at >= start) & (at < stop))


def train_test_split(df: DataFrame, train: float, key: str = "point_id", *, method: str = "hash",
                     seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that cover the table.

    ``hash`` and ``modulo`` decide by the row's key and give the same parts on every run and
    partitioning; ``random`` uses the seeded sampler.
    """
    if not 0 < train < 1:
        raise ValueError("train must lie between 0 and 1")
    if method == "random":
        parts = df.randomSplit([train, 1 - train], seed)
        return parts[0], parts[1]
    if method not in ("hash", "modulo"):
        raise ValueError(f"unknown split method {method!r}")
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) if method == "hash" else F.pmod(F.col(key), F.lit(100)) * 100
    chosen = bucket < round(train * 10_000)
    return df.where(chosen), df.where(~chosen)


def superpose(frames: DataFrame, reference: Sequence[Sequence[float]], coords: str = "coords") -> DataFrame:
    """Every frame moved rigidly onto the reference (least squares over atoms, proper rotations only)."""
    target = np.asarray(reference, dtype=float)
    middle = target.mean(axis=0)
    shipped = frames.sparkSession.sparkContext.broadcast((target - middle, middle))

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows == 0:
                continue
            to, at = shipped.value
            xyz = nb.to_matrix(batch.column("_flat")).reshape(batch.num_rows, -1, 3)
            if xyz.shape[1:] != to.shape:
                raise ValueError(f"frames of {xyz.shape[1]} atoms cannot be moved onto a reference of {len(to)}")
            xyz = xyz - xyz.mean(axis=1, keepdims=True)
            u, _, vt = np.linalg.svd(np.einsum("nai,aj->nij", xyz, to))
            flip = np.ones((len(xyz), 3))
            flip[:, 2] = np.sign(np.linalg.det(u @ vt))
            moved = np.einsum("nai,nij->naj", xyz, (u * flip[:, None, :]) @ vt) + at
            yield batch.drop_columns(["_flat"]).append_column("_moved", nb.from_matrix(moved.reshape(len(xyz), -1)))

    kept = [f for f in frames.schema.fields if f.name != coords]
    schema = T.StructType([*kept, T.StructField("_moved", T.ArrayType(T.DoubleType()))])
    flat = frames.withColumn("_flat", F.flatten(F.col(coords)).cast("array<double>")).drop(coords)
    return fold_frames(flat.mapInArrow(task, schema), "_moved", coords)


def pairwise_atom_distances(frames: DataFrame, atoms: Sequence[int], coords: str = "coords") -> DataFrame:
    """Distances among chosen atoms within each frame, in order of ``(a, b)`` with ``a < b``, as column ``x``.

    Works inside the row; the number of chosen atoms sets the width.
    """
    chosen = sorted({int(a) for a in atoms})
    pairs = [(a, b) for at, a in enumerate(chosen) for b in chosen[at + 1 :]]
    if not pairs:
        raise ValueError("at least two atoms are needed")
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])

    def gap(p):
        square = lambda axis: F.pow(F.get(F.get(coords, p["a"]), F.lit(axis)).cast("double")
                                    - F.get(F.get(coords, p["b"]), F.lit(axis)).cast("double"), F.lit(2.0))
        return F.sqrt(square(0) + square(1) + square(2))

    return frames.withColumn("x", F.transform(both, gap))
