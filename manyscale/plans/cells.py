"""Nested cells of a metric space, and which of them a point, or another cell, has to be compared with.

Pivots are points of the data in a fixed pseudo-random order. A level of the nest holds the first few of them, the next
level more, and each pivot belongs to the nearest one of the level above. A row belongs to the nearest pivot of the first
level, then to the nearest of that one's children, and so on to a leaf. Every cell knows its covering radius,
its size and the distances of its nearest members, measured over all rows. Placing or routing a row costs a few distances
for each level, and cells that the bounds rule out are not opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyscale.functions import batches as nb
from manyscale.functions.metrics import Metric

TILE_VALUES = 8_000_000
#: Distances that a task works out at a time.
BLOCK_VALUES = 1_000_000
#: Coordinates of chosen pairs that a task works out at a time; few enough to stay in a core's cache.
PAIR_VALUES = 65_536
#: Children of a cell, on average.
FAN = 48
MAX_CELLS = 8192
#: Leaves for which pairs of cells are settled: their pairs are a table on the driver.
MAX_DUAL_CELLS = 2048


def decode(column, metric: Metric) -> np.ndarray:
    if metric.unpack:
        return metric.unpack(column)
    if metric.textual:
        return np.array(nb.single(column).to_pylist(), dtype=object)
    return nb.to_matrix(column)


def exact(metric: Metric, a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact distances of chosen pairs, a bounded number of coordinates at a time."""
    out = np.empty(len(rows))
    step = max(1, PAIR_VALUES // (a.shape[1] if a.ndim > 1 else 64))
    for s in range(0, len(rows), step):
        out[s : s + step] = metric.rows(a[rows[s : s + step]], b[cols[s : s + step]])
    return out


def exact_block(metric: Metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All exact distances; a pair has the same one in any batch."""
    d, slack = metric.block(a, b)
    if not slack:
        return d
    rows, cols = np.indices(d.shape).reshape(2, -1)
    return exact(metric, a, b, rows, cols).reshape(d.shape)


def assign(metric: Metric, points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot (ties: smaller index) and exact distance, the same for a row in any batch."""
    approx, slack = metric.block(points, pivots)
    best = approx.argmin(axis=1)
    if slack and len(pivots) > 1:
        close = approx <= approx[np.arange(len(points)), best][:, None] + 2 * slack
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            options = np.flatnonzero(close[row])
            gaps = metric.rows(np.repeat(points[row : row + 1], len(options), axis=0), pivots[options])
            best[row] = options[int(gaps.argmin())]
    own = exact(metric, points, pivots, np.arange(len(points)), best) if slack else approx[np.arange(len(points)), best]
    return best, own


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places where it stands."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, cuts) if len(keys) else ():
        yield int(keys[places[0]]), places


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``[start, end)``, range by range."""
    sizes = end - start
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)


@dataclass
class Level:
    """Cells of one level, ordered by their parent in the level above; cell ``j`` has the children ``start[j]`` to ``start[j + 1] - 1``.

    ``order`` gives the place of each pivot among those that the nest was made of.
    """

    pivots: np.ndarray
    order: np.ndarray
    start: np.ndarray
    rows: np.ndarray
    weight: np.ndarray
    radius: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, order: np.ndarray, near: int) -> Level:
        n = len(order)
        return cls(pivots[order], order, np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full((n, near), np.inf))


@dataclass
class Cells:
    """The nest. Without levels it is one cell that holds everything and has no bounds."""

    levels: list[Level]
    n: int = 0
    _gaps: dict = field(default_factory=dict)

    @classmethod
    def one(cls, n: int) -> Cells:
        return cls([], n)

    @classmethod
    def nested(cls, metric: Metric, pivots: np.ndarray, near: int = 0) -> Cells:
        """Levels over ``pivots``, which are distinct and in the order of choice; the last level has all of them."""
        depth = max(1, math.ceil(math.log(max(2, len(pivots))) / math.log(FAN)))
        levels: list[Level] = []
        order = np.arange(0)
        for k in range(depth):
            size = len(pivots) if k == depth - 1 else min(len(pivots), math.ceil(len(pivots) ** ((k + 1) / depth)))
            if not levels:
                order = np.arange(size)
                levels.append(Level.of(pivots, order, near))
                continue
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # A pivot that is in both levels is its own child, so no cell is without one.
            parent = np.concatenate([place, assign(metric, pivots[len(order) : size], levels[-1].pivots)[0] if size > len(order) else place[:0]])
            levels[-1].start = np.searchsorted(np.sort(parent), np.arange(len(order) + 1))
            order = np.argsort(parent, kind="stable")
            levels.append(Level.of(pivots, order, near))
        return cls(levels)

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def pivots(self) -> np.ndarray | None:
        return self.levels[-1].pivots if self.levels else None

    @property
    def rows(self) -> np.ndarray:
        return self.levels[-1].rows if self.levels else np.array([self.n])

    def children(self, k: int, parent: int) -> slice:
        if k == 0:
            return slice(0, len(self.levels[0].pivots))
        start = self.levels[k - 1].start
        return slice(int(start[parent]), int(start[parent + 1]))

    def place(self, metric: Metric, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The cell of each point in every level and its exact distance, the same for a point in any batch."""
        path, gaps = [], []
        above = np.zeros(len(points), np.int64)
        for k, level in enumerate(self.levels):
            cell, gap = np.empty(len(points), np.int64), np.empty(len(points))
            for parent, at in grouped(above):
                own = self.children(k, parent)
                best, gap[at] = assign(metric, points[at], level.pivots[own])
                cell[at] = best + own.start
            path.append(cell)
            gaps.append(gap)
            above = cell
        return path, gaps

    def between(self, metric: Metric, k: int, parent: int) -> np.ndarray:
        """Upper estimates of the distances between siblings, worked out once per process."""
        if (k, parent) not in self._gaps:
            pivots = self.levels[k].pivots[self.children(k, parent)]
            d, slack = metric.block(pivots, pivots)
            self._gaps[k, parent] = d + slack
        return self._gaps[k, parent]

    def open(self, metric: Metric, points: np.ndarray, k: int, pairs: Pairs) -> Pairs:
        """The children in level ``k`` of cells of the level above, with bounds on the distance to any member.

        The lower bound is the best of three: the parent's, the covering radius, and the fact that members are nearer to
        their pivot than to the sibling nearest the point. In flat space the last is the distance to the plane between the two.
        """
        level, found = self.levels[k], []
        for parent, at in grouped(pairs.cell):
            own = self.children(k, parent)
            d, slack = metric.block(points[pairs.row[at]], level.pivots[own])
            slack += 1e-9 * (1.0 + d.max(initial=0.0))
            lower = np.maximum(np.maximum(d - slack - level.radius[own], 0.0), pairs.lower[at][:, None])
            nearest = d.argmin(axis=1)
            here = d[np.arange(len(d)), nearest][:, None]
            if metric.flat:
                side = (np.maximum(d - slack, 0.0) ** 2 - (here + slack) ** 2) / (2.0 * (self.between(metric, k, parent)[nearest] + slack))
            else:
                side = (d - here) / 2.0 - slack
            upper = np.minimum(d + slack + level.radius[own], pairs.upper[at][:, None])
            full = np.flatnonzero(level.rows[own] > 0)
            n = len(full)
            found.append(Pairs(np.repeat(pairs.row[at], n), np.tile(full + own.start, len(at)), np.maximum(lower, side)[:, full].ravel(),
                               upper[:, full].ravel(), (d + slack)[:, full].ravel()))
        return Pairs(*(np.concatenate([getattr(f, name) for f in found]) for name in Pairs.__slots__)) if found else pairs


@dataclass(slots=True)
class Pairs:
    """Points (by place in a batch) with cells, bounds, and upper estimates of the distance to the pivot."""

    row: np.ndarray
    cell: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    to_pivot: np.ndarray

    @classmethod
    def roots(cls, n: int) -> Pairs:
        return cls(np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.full(n, np.inf))

    def where(self, keep: np.ndarray) -> Pairs:
        return Pairs(*(getattr(self, name)[keep] for name in self.__slots__))

    def plus(self, more: Pairs) -> Pairs:
        return Pairs(*(np.concatenate([getattr(self, name), getattr(more, name)]) for name in self.__slots__))

    def nearest(self, n: int) -> np.ndarray:
        """Marks one pair of each of ``n`` points, that with the nearest pivot."""
        order = np.lexsort((self.to_pivot, self.row))
        first = np.searchsorted(self.row[order], np.arange(n))
        first = first[first < len(order)]
        marked = np.zeros(len(order), bool)
        marked[order[first]] = True
        return marked


@dataclass
class Within:
    """Cells that may hold a row within ``radius``; those that lie inside are marked to be taken as a whole."""

    radius: float
    eps: float = 0.0

    def walk(self, cells: Cells, metric: Metric, points: np.ndarray, known=None, home=None) -> tuple[Pairs, np.ndarray, np.ndarray]:
        """Leaves to visit, whether to take them whole, and the greatest distance of interest for each point."""
        pairs = Pairs.roots(len(points))
        for k in range(len(cells.levels)):
            pairs = cells.open(metric, points, k, pairs)
            pairs = pairs.where(pairs.lower <= self.radius / (1.0 + self.eps))
        return pairs, (pairs.upper < self.radius * (1.0 + self.eps)).astype(np.int32), np.full(len(points), float(self.radius))


@dataclass
class Nearest:
    """Cells that may hold one of the ``k`` nearest rows.

    The stored smallest pivot distances of the cells of a level, or a distance ``known`` from the query's own leaf, give ``k`` real
    rows no further than ``theta``. With ``eps`` the leaves of these witnesses are always kept, so the k-th answer is at
    most ``theta``; and if the true k-th distance is below ``theta / (1 + eps)``, no leaf of a true neighbour has been dropped.
    """

    k: int
    eps: float = 0.0
    limit: float = np.inf

    def walk(self, cells: Cells, metric: Metric, points: np.ndarray, known=None, home=None) -> tuple[Pairs, np.ndarray, np.ndarray]:
        n = len(points)
        theta = np.full(n, np.inf) if known is None else np.asarray(known, float)
        pairs = Pairs.roots(n)
        for k, level in enumerate(cells.levels):
            if k == 0:
                pairs = cells.open(metric, points, k, pairs)
            else:
                # The nearest cell first: its children tighten the bound before the others are opened.
                ahead = pairs.nearest(n)
                near = cells.open(metric, points, k, pairs.where(ahead))
                theta_near = np.minimum(theta, smallest(near.row, near.to_pivot[:, None] + level.near[near.cell], self.k, n, theta))
                pairs = near.plus(cells.open(metric, points, k, pairs.where(~ahead & (pairs.lower <= np.minimum(theta_near, self.limit)[pairs.row]))))
            last = k == len(cells.levels) - 1
            witness = pairs.to_pivot[:, None] + level.near[pairs.cell]
            best = smallest(pairs.row, witness, self.k, n, np.full(n, np.inf) if last and self.eps else theta)
            # The last level's own witnesses decide there, since their leaves are the ones that are kept.
            theta = np.minimum(best, known if known is not None else np.inf) if last and self.eps else np.minimum(theta, best)
            cut = np.minimum(theta / (1.0 + self.eps if last else 1.0), self.limit)
            keep = pairs.lower <= cut[pairs.row]
            if last:
                keep |= (witness[:, 0] <= theta[pairs.row]) & (pairs.lower <= self.limit)
            if home is not None:
                keep |= pairs.cell == home[k][pairs.row]
            pairs = pairs.where(keep)
        return pairs, np.zeros(len(pairs.row), np.int32), np.minimum(theta, self.limit)


def smallest(row: np.ndarray, values: np.ndarray, k: int, n: int, bound: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest value of each of ``n`` rows among those not above its ``bound``, infinity if there are fewer."""
    out = np.full(n, np.inf)
    if n and len(row) % n == 0 and (row.reshape(n, -1) == np.arange(n)[:, None]).all():
        whole = values.reshape(n, -1)
        if whole.shape[1] >= k:
            out = np.partition(whole, k - 1, axis=1)[:, k - 1]
        return np.where(out <= bound, out, np.inf)
    wanted = (values <= bound[row][:, None]) & np.isfinite(values)
    found, of = values[wanted], row[np.nonzero(wanted)[0]]
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    first = np.searchsorted(of, np.arange(n))
    enough = np.append(first[1:], len(of)) - first >= k
    out[enough] = found[first[enough] + k - 1]
    return out


def measured(data: DataFrame, metric: Metric, cells: Cells) -> Cells:
    """The cells with sizes, covering radii and smallest pivot distances over all rows of ``data(id, x[, w])``.

    A task gives a row for each cell it met; they are merged in two steps.
    """
    near = cells.levels[-1].near.shape[1]
    offsets = np.cumsum([0, *(len(level.pivots) for level in cells.levels)])
    shipped = data.sparkSession.sparkContext.broadcast(cells)

    def task(it: Iterator[pa.RecordBatch]):
        total = int(offsets[-1])
        rows, weight, radius = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total)
        closest = [np.zeros(0) for _ in range(total)]
        for batch in it:
            if batch.num_rows == 0:
                continue
            w = nb.to_numpy(batch.column("w"))
            for cell, gap, first in zip(*shipped.value.place(metric, decode(batch.column("x"), metric)), offsets):
                np.add.at(rows, cell + first, 1)
                np.add.at(weight, cell + first, w)
                np.maximum.at(radius, cell + first, gap)
                for j, at in grouped(cell) if near else ():
                    closest[j + first] = np.sort(np.concatenate([closest[j + first], gap[at]]))[:near]
        keep = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.int32()), pa.array(rows[keep]), pa.array(weight[keep]), pa.array(radius[keep]),
             pa.array([closest[j].tolist() for j in keep], pa.list_(pa.float64()))],
            names=["cell", "n", "w", "radius", "near"])

    def merge(df: DataFrame, *keys) -> DataFrame:
        nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, max(1, near))
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("radius").alias("radius"), nearest.alias("near"))

    weighted = data if "w" in data.columns else data.withColumn("w", F.lit(1).cast("long"))
    partial = weighted.select("x", "w").mapInArrow(task, "cell int, n long, w long, radius double, near array<double>")
    staged = merge(partial.withColumn("part", F.spark_partition_id() % 64), "cell", "part")
    for r in merge(staged, "cell").collect():
        k = int(np.searchsorted(offsets, r.cell, side="right")) - 1
        level, j = cells.levels[k], r.cell - offsets[k]
        level.rows[j], level.weight[j], level.radius[j] = r.n, r.w, r.radius * (1 + 1e-12)
        level.near[j, : min(near, len(r.near))] = r.near[:near]
    return cells


def nest_of(metric: Metric, points: np.ndarray) -> Cells:
    """A nest in which every point is a leaf of its own, measured here; ``order`` of its leaves refers to ``points``."""
    shuffled = np.random.default_rng(0).permutation(len(points))
    cells = Cells.nested(metric, points[shuffled], 1)
    cells.levels[-1].order = shuffled[cells.levels[-1].order]
    for cell, gap, level in zip(*cells.place(metric, points), cells.levels):
        np.add.at(level.rows, cell, 1)
        np.maximum.at(level.radius, cell, gap * (1 + 1e-12))
        np.minimum.at(level.near[:, 0], cell, gap)
    return cells


@dataclass
class CellPairs:
    """Leaves ``a`` with the leaves ``b`` that leave radii ``[lo, hi)`` undecided, by ``a``; ``start`` indexes them."""

    start: np.ndarray
    b: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def n_bytes(self) -> int:
        return self.start.nbytes + self.b.nbytes + self.lo.nbytes + self.hi.nbytes


def cell_pairs(metric: Metric, left: Cells, right: Cells, radii: np.ndarray) -> tuple[list[int], CellPairs]:
    """Cells of two nests against each other, from the top down.

    A pair of cells whose members all lie within a radius, or all beyond it, is settled for that radius by the two sizes; it is
    opened on both sides only for the radii in between. Returns the settled number of pairs of rows for every radius,
    and the pairs of leaves that stay undecided. If both nests are one, a pair of cells is met once and counts twice.
    """
    same, settled = left is right, [0] * len(radii)
    a, b = (np.zeros(1, np.int64) for _ in range(2))
    lo, hi = np.zeros(1, np.int64), np.full(1, len(radii))
    for k in range(max(len(left.levels), len(right.levels))):
        for side, nest in ((0, left), (1, right)):
            if k < len(nest.levels):
                now = (a, b)[side]
                if k == 0:
                    start, end = np.zeros(len(now), np.int64), np.full(len(now), len(nest.levels[0].pivots))
                else:
                    start, end = nest.levels[k - 1].start[now], nest.levels[k - 1].start[now + 1]
                rep, opened = np.repeat(np.arange(len(now)), end - start), spans(start, end)
                a, b = (opened, b[rep]) if side == 0 else (a[rep], opened)
                lo, hi = lo[rep], hi[rep]
        one, two = left.levels[min(k, len(left.levels) - 1)], right.levels[min(k, len(right.levels) - 1)]
        real = (one.rows[a] > 0) & (two.rows[b] > 0) & ((a <= b) | (not same))
        a, b, lo, hi = a[real], b[real], lo[real], hi[real]
        d, reach = np.empty(len(a)), one.radius[a] + two.radius[b]
        for cell, at in grouped(a):
            gap, slack = metric.block(one.pivots[cell : cell + 1], two.pivots[b[at]])
            d[at] = gap[0]
            reach[at] += slack + 1e-9 * (1.0 + gap.max(initial=0.0))
        new_lo = np.maximum(lo, np.searchsorted(radii, d - reach, side="left"))
        new_hi = np.minimum(hi, np.searchsorted(radii, d + reach, side="left"))
        times = np.where(a != b, 2, 1) if same else np.ones(len(a), np.int64)
        for t in range(len(radii)):
            inside = (new_hi <= t) & (t < hi)
            settled[t] += int((one.weight[a[inside]].astype(object) * two.weight[b[inside]] * times[inside]).sum()) if inside.any() else 0
        open_ = new_lo < new_hi
        a, b, lo, hi = a[open_], b[open_], new_lo[open_], new_hi[open_]
    order = np.argsort(a, kind="stable")
    start = np.searchsorted(a[order], np.arange(len(left) + 1))
    return settled, CellPairs(start, b[order].astype(np.int32), lo[order].astype(np.int32), hi[order].astype(np.int32))
