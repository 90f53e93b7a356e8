"""Arrow batches to numpy matrices and back, without per-row Python objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def single(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def to_matrix(column) -> np.ndarray:
    """An ``ARRAY<DOUBLE>`` column as an ``(n, D)`` float64 matrix; ragged rows are an error."""
    arr = single(column)
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    if arr.null_count:
        raise ValueError("vector column holds nulls")
    flat = arr.flatten()
    if flat.null_count:
        raise ValueError("vector column holds null entries")
    width = len(flat) // n
    offsets = np.asarray(arr.offsets)
    if width * n != len(flat) or np.any(np.diff(offsets) != width):
        raise ValueError("vectors of one table must all have the same length")
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, width)


def to_numpy(column) -> np.ndarray:
    return single(column).to_numpy(zero_copy_only=False)


def from_matrix(m: np.ndarray) -> pa.ListArray:
    """An ``(n, D)`` matrix as an Arrow ``list<double>`` column."""
    n, width = m.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def from_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of ``values`` as one list per row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def row_norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center and the distance to it; ties go to the smaller index.

    Candidates come from one matrix product. Rows whose runner-up is within rounding
    error of the winner are decided by exact differences, so the answer of a row never
    depends on which other rows share its batch.
    """
    n = len(points)
    cc = (centers * centers).sum(axis=1)
    pp = (points * points).sum(axis=1)
    approx = cc[None, :] - 2.0 * (points @ centers.T)
    best = approx.argmin(axis=1)
    if len(centers) > 1:
        slack = 1e-13 * (pp + cc.max() + 1e-300) * (4 + points.shape[1] / 16)
        close = approx <= approx[np.arange(n), best][:, None] + slack[:, None]
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            options = np.flatnonzero(close[row])
            gaps = ((centers[options] - points[row]) ** 2).sum(axis=1)
            best[row] = options[int(gaps.argmin())]
    return best, row_norms(points - centers[best])
