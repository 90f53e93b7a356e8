"""Filter on short codes, refine on vectors: for joins whose rows have to meet every block.

A sketch is a row's coordinates along the first directions of an orthonormal basis, in whole steps of 16 bits, with the length of
what the directions leave out and the length of the rounding error. Distances of sketches bound the true distance from
both sides. Only sketches travel to all blocks; full vectors only meet for the pairs that the bounds leave open. Directions are the
principal axes of a few rows; whether and how many of them pay is estimated on those rows, the bounds hold for any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from manyscale.functions import batches as nb
from manyscale.functions.metrics import Metric
from manyscale.plans import storage

LOOK_QUERIES, LOOK_ROWS = 256, 1024
TOP = 32767
#: Bytes of ids and bounds that travel with a pair.
PAIR_BYTES = 48


@dataclass
class Sketch:
    basis: np.ndarray
    middle: np.ndarray
    step: float

    @property
    def row_bytes(self) -> int:
        return 2 * len(self.basis) + 16

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes each: codes, length of the rest, length of the error."""
        x = x - self.middle
        y = x @ self.basis.T
        codes = np.clip(np.rint(y / self.step), -TOP, TOP).astype("<i2")
        error = nb.row_norms(y - codes * self.step)
        rest = nb.row_norms(x - y @ self.basis) if len(self.basis) < x.shape[1] else np.zeros(len(x))
        # Roundoff of the products above, with room to spare.
        error += 1e-13 * np.sqrt(x.shape[1]) * (1.0 + nb.row_norms(x))
        return np.hstack([codes.view(np.uint8).reshape(len(x), -1), np.stack([rest, error], 1).astype("<f8").view(np.uint8).reshape(len(x), -1)])

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates, rest and error as numbers."""
        split = 2 * len(self.basis)
        codes = np.ascontiguousarray(rows[:, :split]).view("<i2") * self.step
        return np.hstack([codes, np.ascontiguousarray(rows[:, split:]).view("<f8")])

    def metric(self) -> Metric:
        """What a block join needs to read sketches; their bounds are worked out by the task."""

        def unpack(column) -> np.ndarray:
            arr = nb.single(column)
            if not len(arr):
                return np.zeros((0, len(self.basis) + 2))
            size = self.row_bytes
            offsets = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
            flat = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            return self.decode(flat.reshape(len(arr), size))

        return Metric("sketch", lambda a, b: bounds(a, b)[:1] + (0.0,), lambda a, b: np.zeros(len(a)), unpack=unpack)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the rows of two decoded sketches."""
    near, other = a[:, :-2], b[:, :-2]
    aa, bb = (near * near).sum(axis=1), (other * other).sum(axis=1)
    square = np.maximum(aa[:, None] + bb[None, :] - 2.0 * (near @ other.T), 0.0)
    # The absolute error of the squares, and its effect on their root.
    slack = 1e-14 * (aa.max(initial=0.0) + bb.max(initial=0.0)) * (4 + near.shape[1] / 16)
    wide = a[:, -1][:, None] + b[:, -1][None, :]
    low = np.maximum(np.sqrt(np.maximum(square - slack, 0.0)) - wide, 0.0)
    high = np.sqrt(square + slack) + wide
    rest, its = a[:, -2][:, None], b[:, -2][None, :]
    apart = np.maximum(np.abs(rest - its) - 1e-12 * (rest + its), 0.0)
    return np.sqrt(low * low + apart * apart) * (1 - 1e-14), np.sqrt(high * high + (rest + its) ** 2) * (1 + 1e-14)


def of_rows(x: np.ndarray, m: int) -> Sketch:
    """A sketch along the first ``m`` principal axes of some rows."""
    middle = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - middle, full_matrices=True)
    basis = axes[:m]
    return Sketch(basis, middle, max(float(np.abs((x - middle) @ basis.T).max(initial=0.0)) * 1.5 / TOP, 1e-300))


def choose(queries: np.ndarray, rows: np.ndarray, copies: float, pairs_of, saving: float = 0.5) -> Sketch | None:
    """The sketch with the fewest bytes, if they are at most ``saving`` of what the vectors alone would take.

    ``copies`` is how many rows travel, of either side; ``pairs_of(lower, upper)`` estimates how many pairs stay open from bounds
    between some queries and rows.
    """
    if len(rows) < 2 or not len(queries):
        return None
    width, best, least = rows.shape[1], None, saving * copies * 8 * rows.shape[1]
    for m in sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2), width}):
        sketch = of_rows(rows, m)
        one, two = (sketch.decode(sketch.encode(x)) for x in (queries, rows))
        cost = copies * sketch.row_bytes + pairs_of(*bounds(one, two)) * (8 * width + PAIR_BYTES)
        if cost < least:
            best, least = sketch, cost
    return best


def encoded(side: DataFrame, sketch: Sketch) -> DataFrame:
    """``side`` with its vectors ``x`` replaced by sketches."""
    shipped = storage.checked_broadcast(side.sparkSession, sketch, sketch.basis.nbytes, "the directions of a sketch")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                rows = shipped.value.encode(nb.to_matrix(batch.column("x")))
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
                at = batch.schema.get_field_index("x")
                yield pa.RecordBatch.from_arrays([packed if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    fields = [T.StructField("x", T.BinaryType()) if f.name == "x" else f for f in side.schema.fields]
    return side.mapInArrow(task, T.StructType(fields))


def refined(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: Metric, i: str, j: str) -> DataFrame:
    """``pairs`` with their exact distance ``d``; ``left(id, x)`` and ``right(id, x)`` give the vectors of ``i`` and ``j``."""
    one = left.select(left["id"].alias(i), left["x"].alias("_one"))
    two = right.select(right["id"].alias(j), right["x"].alias("_two"))
    met = pairs.join(one, i).join(two, j).select(*pairs.columns, "_one", "_two")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                d = metric.rows(nb.to_matrix(batch.column("_one")), nb.to_matrix(batch.column("_two")))
                yield batch.drop_columns(["_one", "_two"]).append_column("d", pa.array(d))

    return met.mapInArrow(task, T.StructType([*pairs.schema.fields, T.StructField("d", T.DoubleType())]))
