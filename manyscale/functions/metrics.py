"""Metrics: a Column expression for SQL plans and a block form for Arrow tasks.

``block(A, B)`` returns ``(distances, slack)``: every true distance lies within ``slack``
of the returned one. ``rows(A, B)`` gives exact distances of aligned rows and is used to
settle whatever the block form leaves open. ``flat`` marks Euclidean geometry. ``unpack`` reads points
that are not plain vectors or strings. ``products`` readies a block for comparing squares, which takes less than distances.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from manyscale.functions import arrays

_CHUNK_VALUES = 250_000


@dataclass(frozen=True)
class Metric:
    name: str
    block: Callable
    rows: Callable
    expression: Callable[[Column, Column], Column] | None = None
    textual: bool = False
    flat: bool = False
    unpack: Callable | None = None
    products: Callable | None = None


class Products:
    """Rows of a block, ready for single-precision products with others; candidates from them lose no pair."""

    def __init__(self, points: np.ndarray):
        own = np.einsum("ij,ij->i", points, points)
        self.top = float(own.max(initial=0.0))
        self.columns = np.hstack([-2.0 * points, own[:, None]]).astype(np.float32) if self.top < 1e12 else None

    def within(self, a: np.ndarray, r: float) -> np.ndarray | None:
        """Marks of the pairs that may lie within ``r``, with few others; none if single precision can't tell them apart."""
        own = np.einsum("ij,ij->i", a, a)
        top = self.top + float(own.max(initial=0.0))
        # Four times what rounding the numbers and adding up their products can be off.
        slack = 2.0**-22 * (a.shape[1] + 8) * (top + r * r)
        if not (1e-12 < top < 1e12 and r > 0 and slack <= 1e-3 * r * r):
            return None
        squares = np.hstack([a, np.ones((len(a), 1))]).astype(np.float32) @ self.columns.T
        return squares <= (r * r + slack - own).astype(np.float32)[:, None]


def _euclidean_block(a, b):
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    sq = a @ b.T
    sq *= -2.0
    sq += aa[:, None]
    sq += bb[None, :]
    np.maximum(sq, 0.0, out=sq)
    top = (aa.max(initial=0.0) + bb.max(initial=0.0)) * (4 + a.shape[1] / 16)
    return np.sqrt(sq, out=sq), float(np.sqrt(1e-14 * top))


def _by_differences(reduce):
    """Block form built from chunked coordinate differences; exact, so no slack."""

    def block(a, b):
        out = np.empty((len(a), len(b)))
        step = max(1, _CHUNK_VALUES // max(1, b.size))
        for s in range(0, len(a), step):
            out[s : s + step] = reduce(a[s : s + step, None, :] - b[None, :, :])
        return out, 0.0

    return block


def _l2(diff):
    square = diff * diff
    if not 0 < square.shape[-1] < 8:
        return np.sqrt(square.sum(axis=-1))
    # Few coordinates are added column by column: the same sums, in less time.
    out = square[..., 0].copy()
    for i in range(1, square.shape[-1]):
        out += square[..., i]
    return np.sqrt(out, out=out)


def _l1(diff):
    return np.abs(diff).sum(axis=-1)


def _linf(diff):
    return np.abs(diff).max(axis=-1)


def euclidean() -> Metric:
    return Metric("euclidean", _euclidean_block, lambda a, b: _l2(a - b),
                  lambda x, y: F.sqrt(arrays.squared_distance(x, y)), flat=True, products=Products)


def cityblock() -> Metric:
    return Metric("cityblock", _by_differences(_l1), lambda a, b: _l1(a - b),
                  lambda x, y: arrays.total(F.zip_with(x, y, lambda u, v: F.abs(u - v))))


def chebyshev() -> Metric:
    return Metric("chebyshev", _by_differences(_linf), lambda a, b: _linf(a - b),
                  lambda x, y: F.array_max(F.zip_with(x, y, lambda u, v: F.abs(u - v))))


def periodic(box: float) -> Metric:
    """Euclidean distance in a box whose opposite faces are joined, side length ``box``."""

    # Divided by a power of two, nothing is rounded, and the remainder is as exact as that of a slow division.
    even = np.frexp(box)[0] == 0.5 and 1e-9 < box < 1e9

    def wrapped(diff):
        gap = np.abs(diff)
        gap = gap - np.floor(gap / box) * box if even else np.mod(gap, box)
        return _l2(np.minimum(gap, box - gap))

    def expression(x, y):
        def gap(u, v):
            g = F.abs(u - v) % F.lit(float(box))
            return F.pow(F.least(g, F.lit(float(box)) - g), F.lit(2.0))

        return F.sqrt(arrays.total(F.zip_with(x, y, gap)))

    return Metric(f"periodic({box})", _by_differences(wrapped), lambda a, b: wrapped(a - b), expression)


def _edit_distances(word: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of one word to many words at once, one table row per letter."""
    positions = np.arange(codes.shape[1] + 1)
    row = np.broadcast_to(positions, (len(codes), len(positions))).copy()
    for i, letter in enumerate(word, start=1):
        step = np.empty_like(row)
        step[:, 0] = i
        step[:, 1:] = np.minimum(row[:, :-1] + (codes != ord(letter)), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - positions, axis=1) + positions
    return row[np.arange(len(codes)), lengths]


def levenshtein() -> Metric:
    def block(a, b):
        lengths = np.array([len(w) for w in b], dtype=np.int64)
        codes = np.full((len(b), int(lengths.max(initial=0))), -1, dtype=np.int64)
        for i, w in enumerate(b):
            codes[i, : len(w)] = [ord(c) for c in w]
        return np.array([_edit_distances(w, codes, lengths) for w in a], dtype=float).reshape(len(a), len(b)), 0.0

    def rows(a, b):
        return np.array([block([u], [v])[0][0, 0] for u, v in zip(a, b)], dtype=float)

    return Metric("levenshtein", block, rows, lambda x, y: F.levenshtein(x, y).cast("double"), textual=True)


def custom(function: Callable, *, name: str = "custom", vectorised: bool = False, textual: bool = False,
           expression: Callable[[Column, Column], Column] | None = None) -> Metric:
    """A caller's metric: ``function(p, q) -> float``, or on whole blocks if ``vectorised``."""

    def block(a, b):
        if vectorised:
            return np.asarray(function(a, b), dtype=float), 0.0
        return np.array([[function(p, q) for q in b] for p in a], dtype=float).reshape(len(a), len(b)), 0.0

    def rows(a, b):
        return np.array([block(a[i : i + 1], b[i : i + 1])[0][0, 0] for i in range(len(a))], dtype=float)

    return Metric(name, block, rows, expression, textual)


def named(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    known = {"euclidean": euclidean, "cityblock": cityblock, "chebyshev": chebyshev, "levenshtein": levenshtein}
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}; known are {sorted(known)}, or pass a Metric")
    return known[metric]()
