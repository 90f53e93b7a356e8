"""Multi-scale cell tree: nested cells with a rank-``d`` affine approximation in each.

Node ids are heap ids: the root is 0 and the children of ``k`` are ``2k + 1`` and ``2k + 2``.

Fitting never moves the points while cells are large. The split centers found so far are a
small model; a task routes its rows through them, adds up what its cells need with numpy and
ships one partial per cell. Once a cell is small enough for one task, the rows of all such
cells are grouped by cell in a single shuffle and the rest of each subtree is fitted there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from manyscale.functions import arrays, linear
from manyscale.functions import batches as nb
from manyscale.plans import storage
from manyscale.plans.partials import FLUSH_VALUES, collect_sums, sum_partials

ROUNDS = 10
#: Levels below the root whose heap ids fit 64 bits.
MAX_LEVEL = 61
PRUNE = 0.99999
#: The column in which stored vectors keep the cell they have come to, and after how many levels it is noted anew.
NODE, STORED_LEVELS = "_manyscale_node", 3
LOCAL_BYTES = 64 * 1024 * 1024
#: Bytes of triangular factors that a task merges at once.
FACTOR_BYTES = 256 * 1024 * 1024
NODE_SCHEMA = ("node_id long, level int, parent_id long, n long, center array<double>, split_center array<double>, "
               "basis array<array<double>>, svals array<double>, is_leaf boolean")
REP_SCHEMA = "point_id long, level int, node_id long, z array<double>"


def level_of(node_id: int) -> int:
    return (node_id + 1).bit_length() - 1


@dataclass
class Cell:
    """One fitted cell. ``split_center`` is what decided membership among the training rows."""

    node_id: int
    n: int
    center: np.ndarray
    split_center: np.ndarray | None = None
    basis: np.ndarray | None = None
    svals: np.ndarray | None = None


@dataclass
class CellTree:
    d: int
    width: int
    cells: dict[int, Cell] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return max(level_of(k) for k in self.cells)

    def is_leaf(self, node_id: int) -> bool:
        return 2 * node_id + 1 not in self.cells

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table, one row per cell."""
        rows = [(k, level_of(k), (k - 1) // 2 if k else None, int(c.n), c.center.tolist(),
                 None if c.split_center is None else c.split_center.tolist(),
                 c.basis.tolist(), c.svals.tolist(), self.is_leaf(k)) for k, c in sorted(self.cells.items())]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @staticmethod
    def from_nodes(nodes: DataFrame) -> CellTree:
        """A model read back from its table; its size is checked before it is collected."""
        size = nodes.agg(F.sum(F.size("center") * (2 + F.size("basis")) * 8).alias("bytes")).first().bytes
        if size is None:
            raise ValueError("the node table is empty")
        if size > 16 * storage.BROADCAST_LIMIT:
            raise ValueError(f"a model of {size} bytes does not fit the driver")
        cells = {r.node_id: Cell(r.node_id, r.n, np.array(r.center),
                                 None if r.split_center is None else np.array(r.split_center),
                                 np.array(r.basis).reshape(len(r.basis), -1), np.array(r.svals))
                 for r in nodes.collect()}
        root = cells[0]
        return CellTree(len(root.basis), len(root.center), cells)


@dataclass
class Router:
    """Sends rows down binary splits. ``split`` holds the ids of the split nodes in order, ``left``/``right`` the centers of their children.

    Its size follows the cells that exist, however deep or one-sided the tree is.
    """

    split: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def build(centers: dict[int, np.ndarray], width: int) -> Router:
        """From the center of every non-root node."""
        split = sorted({(k - 1) // 2 for k in centers if k})
        stack = lambda side: np.array([centers[2 * k + side] for k in split]).reshape(len(split), width)
        return Router(np.array(split, np.int64), stack(1), stack(2))

    @property
    def n_bytes(self) -> int:
        return self.left.nbytes + self.right.nbytes + self.split.nbytes

    def slots(self, nodes: np.ndarray) -> np.ndarray:
        """The place of each node among the split nodes, -1 for others."""
        if len(self.split) == 0:
            return np.full(len(nodes), -1)
        at = np.minimum(np.searchsorted(self.split, nodes), len(self.split) - 1)
        return np.where(self.split[at] == nodes, at, -1)

    def step(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """One level down; rows in unsplit cells stay. Ties go left."""
        slot = self.slots(nodes)
        moving = np.flatnonzero(slot >= 0)
        if len(moving) == 0:
            return nodes
        s, rows = slot[moving], points[moving]
        near = ((rows - self.left[s]) ** 2).sum(axis=1)
        far = ((rows - self.right[s]) ** 2).sum(axis=1)
        out = nodes.copy()
        out[moving] = 2 * nodes[moving] + 1 + (near > far)
        return out

    def path(self, points: np.ndarray, start: np.ndarray | None = None) -> list[np.ndarray]:
        """The node of every row at each level from ``start`` (the root unless given), as long as any row still moves."""
        levels = [np.zeros(len(points), np.int64) if start is None else start]
        while True:
            deeper = self.step(points, levels[-1])
            if np.array_equal(deeper, levels[-1]):
                return levels
            levels.append(deeper)

    def leaf(self, points: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        return self.path(points, start)[-1]


def grouped_sums(points: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(key, rows, sum)`` of each key present."""
    order = np.argsort(keys, kind="stable")
    found, starts, counts = np.unique(keys[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(points[order], starts, axis=0)
    return zip(found.tolist(), counts.tolist(), sums)


def _vectors(points: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return points.select(F.col("point_id").cast("long").alias("point_id"), arrays.doubles("x").alias("x"), *keep)


def _placed(points: DataFrame) -> tuple[DataFrame, list[str]]:
    """The vectors, with the node that ``_stored`` has noted if it has, and the columns that ``_routed`` reads."""
    noted = [NODE] if NODE in points.columns else []
    return _vectors(points, noted), ["x", *noted]


def _routed(router: Router, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch and the cell that each has come to, from the noted node on."""
    x = nb.to_matrix(batch.column("x"))
    return x, router.leaf(x, nb.to_numpy(batch.column(NODE)) if NODE in batch.schema.names else None)


def _stored(points: DataFrame, tree: CellTree) -> DataFrame:
    """The vectors with the cells that they have come to, stored: later scans read nothing else and route from there."""
    rows, _ = _placed(points)
    routes = _share(points.sparkSession, {k: c.split_center for k, c in tree.cells.items() if k}, tree.width)

    def note(it):
        for batch in it:
            if batch.num_rows:
                _, leaf = _routed(routes.value, batch)
                yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("x"), pa.array(leaf, pa.int64())], names=["point_id", "x", NODE])

    return storage.materialize(rows.mapInArrow(note, f"point_id long, x array<double>, {NODE} long"))


def _share(spark: SparkSession, centers: dict[int, np.ndarray], width: int):
    router = Router.build(centers, width)
    return storage.checked_broadcast(spark, router, router.n_bytes, "the split centers of the tree")


def _extreme(rows: DataFrame, pick) -> dict[int, tuple[np.ndarray, int]]:
    """Per node the row with the smallest ``(score, point_id)``.

    ``pick(batch)`` gives the vectors, node ids (negative: ignore) and scores. Tasks keep one candidate per node.
    """

    def task(it):
        best = {}
        for batch in it:
            if batch.num_rows == 0:
                continue
            ids = nb.to_numpy(batch.column("point_id"))
            x, nodes, score = pick(batch)
            order = np.lexsort((ids, score, nodes))
            found, first = np.unique(nodes[order], return_index=True)
            for k, at in zip(found.tolist(), order[first]):
                if k >= 0 and (k not in best or (score[at], ids[at]) < best[k][:2]):
                    best[k] = (score[at], ids[at], x[at].copy())
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best)), pa.array([b[0] for b in best.values()]), pa.array([b[1] for b in best.values()]),
                 nb.from_matrix(np.array([b[2] for b in best.values()]))], names=["node_id", "score", "point_id", "x"])

    kept = rows.mapInArrow(task, "node_id long, score double, point_id long, x array<double>")
    merged = kept.groupBy("node_id").agg(F.min_by("x", F.struct("score", "point_id")).alias("x"))
    return {r.node_id: np.array(r.x) for r in merged.collect()}


def split_cells(points: DataFrame, tree: CellTree, targets: list[int], rounds: int = ROUNDS) -> dict[int, Cell]:
    """2-means split of all ``targets`` at once; returns the child cells, without bases.

    The first center is the member with the smallest id, the second the member farthest from it
    (distance rounded to 12 decimals, tie: smaller id). ``rounds`` center updates are followed by
    one last assignment, whose members make the child. A point as near to both goes left, an
    emptied side keeps its center. Cells that do not come apart get no children.
    """
    (rows, columns), spark = _placed(points), points.sparkSession
    routes = _share(spark, {k: c.split_center for k, c in tree.cells.items() if k}, tree.width)
    wanted = np.array(sorted(targets))

    def members(batch):
        x, leaf = _routed(routes.value, batch)
        return x, np.where(np.isin(leaf, wanted), leaf, -1)

    first = _extreme(rows, lambda batch: (*members(batch), np.zeros(batch.num_rows)))
    anchor = np.array([first[k] for k in wanted])
    start = storage.checked_broadcast(spark, (wanted, anchor), anchor.nbytes, "the first centers of one level")

    def distance_order(batch):
        x, nodes = members(batch)
        ids, anchors = start.value
        gap = nb.row_norms(x - anchors[np.searchsorted(ids, np.maximum(nodes, ids[0]))])
        return x, nodes, -np.round(gap, 12)

    second = _extreme(rows, distance_order)
    centers = {side: np.array([(first, second)[side][k] for k in wanted]) for side in (0, 1)}
    counts = np.zeros((2, len(wanted)), np.int64)
    used = centers
    for _ in range(rounds + 1):
        used = {side: c.copy() for side, c in centers.items()}
        model = storage.checked_broadcast(spark, (wanted, used), 2 * used[0].nbytes, "the centers of one level")

        def assign(batch):
            x, nodes = members(batch)
            x, nodes = x[nodes >= 0], nodes[nodes >= 0]
            if len(x) == 0:
                return
            ids, now = model.value
            at = np.searchsorted(ids, nodes)
            right = ((x - now[0][at]) ** 2).sum(axis=1) > ((x - now[1][at]) ** 2).sum(axis=1)
            for key, n, s in grouped_sums(x, 2 * at + right):
                yield key // 2, key % 2, n, s

        sums = collect_sums(sum_partials(rows, columns, assign))
        counts = np.zeros((2, len(wanted)), np.int64)
        for (at, side), (n, s) in sums.items():
            counts[side, at] = n
            centers[side][at] = s / n
        if all(np.array_equal(used[s], centers[s]) for s in (0, 1)):
            break
    out = {}
    for at, k in enumerate(wanted.tolist()):
        if counts[0, at] and counts[1, at]:
            for side in (0, 1):
                child = 2 * k + 1 + side
                out[child] = Cell(child, int(counts[side, at]), centers[side][at].copy(), used[side][at].copy())
    return out


def fit_cells(points: DataFrame, tree: CellTree, cells: dict[int, Cell], factor_bytes: int = FACTOR_BYTES) -> None:
    """Bases and singular values of cells whose members and centers are known, for all cells at once.

    Tasks reduce the centered rows of a cell to a triangular factor, factors are stacked and reduced again, as many at a time as
    ``factor_bytes`` allows, and the last one gives the basis. It is the same at every width, and the one that ``basis_from_rows`` finds.
    """
    fit = max(2, storage.BROADCAST_LIMIT // (8 * tree.width) // 2 * 2)
    if len(cells) > fit:
        # Sorted ids keep siblings together, which routing needs.
        ids = sorted(cells)
        for s in range(0, len(ids), fit):
            fit_cells(points, tree, {k: cells[k] for k in ids[s : s + fit]}, factor_bytes)
        return
    (rows, _), spark = _placed(points), points.sparkSession
    known = {**{k: c.split_center for k, c in tree.cells.items() if k},
             **{k: c.split_center for k, c in cells.items() if k}}
    routes = _share(spark, known, tree.width)
    wanted = np.array(sorted(cells))
    middle = np.array([cells[k].center for k in wanted])
    shift = storage.checked_broadcast(spark, middle, middle.nbytes, "the centers of one level")
    d, width = tree.d, tree.width

    def pieces(held: dict[int, list], turn: int) -> Iterator[pa.RecordBatch]:
        for slot, (n, parts, _) in held.items():
            yield factor(slot, TaskContext.get().partitionId(), turn, n, linear.triangle(np.vstack(parts)))
        held.clear()

    def factor(slot: int, piece: int, turn: int, n: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (slot, piece, turn, n)] + [nb.from_matrix(m.reshape(1, -1))],
                                          names=["slot", "piece", "turn", "n", "m"])

    def reduce(it):
        held: dict[int, list] = {}
        size = turn = 0
        for batch in it:
            if batch.num_rows == 0:
                continue
            x, leaf = _routed(routes.value, batch)
            at = np.minimum(np.searchsorted(wanted, leaf), len(wanted) - 1)
            inside = wanted[at] == leaf
            for slot in np.unique(at[inside]):
                xc = x[inside & (at == slot)] - shift.value[slot]
                entry = held.setdefault(int(slot), [0, [], 0])
                entry[0] += len(xc)
                entry[1].append(xc)
                entry[2] += len(xc)
                size += xc.size
                if entry[2] > 4 * width:
                    entry[1] = [linear.triangle(np.vstack(entry[1]))]
                    size -= (entry[2] - len(entry[1][0])) * width
                    entry[2] = len(entry[1][0])
                if size > FLUSH_VALUES:
                    yield from pieces(held, turn)
                    size, turn = 0, turn + 1
        yield from pieces(held, turn)

    def stacked(table: pa.Table) -> tuple[int, np.ndarray]:
        order = np.lexsort((nb.to_numpy(table.column("turn")), nb.to_numpy(table.column("piece"))))
        parts = nb.single(table.column("m"))
        whole = np.vstack([parts[int(k)].values.to_numpy().reshape(-1, width) for k in order])
        return int(nb.to_numpy(table.column("n")).sum()), linear.triangle(whole)

    def merge(table: pa.Table) -> pa.Table:
        n, m = stacked(table)
        return pa.Table.from_batches([factor(table.column("slot")[0].as_py(), table.column("group")[0].as_py(), 0, n, m)])

    def solve(table: pa.Table) -> pa.Table:
        n, m = stacked(table)
        basis, svals = linear.basis_from_triangle(m, d, n)
        return pa.table({"slot": table.column("slot").slice(0, 1), "basis": nb.from_matrix(basis.reshape(1, -1)), "svals": nb.from_matrix(svals.reshape(1, -1))})

    schema = "slot long, piece long, turn long, n long, m array<double>"
    factors, left, fan = rows.mapInArrow(reduce, schema), rows.rdd.getNumPartitions(), max(2, factor_bytes // (8 * width * width))
    while left > fan:
        factors = factors.withColumn("group", F.floor(F.col("piece") / fan)).groupBy("slot", "group").applyInArrow(merge, schema)
        left = -(-left // fan)
    solved = factors.groupBy("slot").applyInArrow(solve, "slot long, basis array<double>, svals array<double>")
    for r in solved.collect():
        cell = cells[int(wanted[r.slot])]
        cell.basis, cell.svals = np.array(r.basis).reshape(d, width), np.array(r.svals)


def keeps_split(parent: Cell, left: Cell, right: Cell, prune: float | None, against: str) -> bool:
    """Whether a split adds anything: its subspaces differ by more than ``prune`` allows."""
    if prune is None:
        return True
    if against == "parent":
        return min(linear.subspace_cosine(parent.basis, c.basis) for c in (left, right)) < prune
    return linear.subspace_cosine(left.basis, right.basis) < prune


def _split_local(ids: np.ndarray, x: np.ndarray, rounds: int):
    """The split of one in-memory cell; the same rule as ``split_cells``."""
    start = x[ids.argmin()]
    gap = np.round(nb.row_norms(x - start), 12)
    other = x[np.lexsort((ids, -gap))[0]]
    centers = [start.copy(), other.copy()]
    for _ in range(rounds + 1):
        used = [c.copy() for c in centers]
        right = ((x - used[0]) ** 2).sum(axis=1) > ((x - used[1]) ** 2).sum(axis=1)
        for side, mask in enumerate((~right, right)):
            if mask.any():
                centers[side] = x[mask].mean(axis=0)
        if np.array_equal(used, centers):
            break
    return right, used, centers


def _grow_local(root: Cell, ids, x, d: int, levels: int, rounds: int, prune, against: str) -> list[Cell]:
    """All descendants of one in-memory cell."""
    out, queue = [], [(root, ids, x, levels)]
    while queue:
        parent, ids, x, left = queue.pop()
        if left == 0 or len(ids) < 2:
            continue
        right, used, centers = _split_local(ids, x, rounds)
        if right.all() or not right.any():
            continue
        children = []
        for side, mask in enumerate((~right, right)):
            child = Cell(2 * parent.node_id + 1 + side, int(mask.sum()), centers[side], used[side])
            child.basis, child.svals = linear.basis_from_rows(x[mask] - child.center, d)
            children.append((child, ids[mask], x[mask], left - 1))
        if keeps_split(parent, children[0][0], children[1][0], prune, against):
            out += [c[0] for c in children]
            queue += children
    return out


def _grow_small(points: DataFrame, tree: CellTree, small: dict[int, int], rounds, prune, against) -> list[Cell]:
    """Subtrees of all cells that fit a task, with one shuffle by cell. A root that has not been
    fitted yet is fitted there too and returned with the rest. More cells than fit a broadcast are
    taken in several passes."""
    per_cell = 8 * tree.width * (tree.d + 2)
    fit = max(1, storage.BROADCAST_LIMIT // per_cell)
    if len(small) > fit:
        ids = sorted(small)
        return [cell for s in range(0, len(ids), fit)
                for cell in _grow_small(points, tree, {k: small[k] for k in ids[s : s + fit]}, rounds, prune, against)]
    (rows, _), spark = _placed(points), points.sparkSession
    routes = _share(spark, {k: c.split_center for k, c in tree.cells.items() if k}, tree.width)
    wanted = np.array(sorted(small))
    roots = {k: (tree.cells[k], small[k]) for k in small}
    model = storage.checked_broadcast(spark, roots, len(roots) * per_cell, "the cells handed to tasks")
    d = tree.d

    def send(it):
        for batch in it:
            if batch.num_rows:
                _, leaf = _routed(routes.value, batch)
                tagged = batch.select(["point_id", "x"]).append_column("cell", pa.array(leaf))
                yield tagged.filter(pa.array(np.isin(leaf, wanted)))

    def grow(table: pa.Table) -> pa.Table:
        ids, x = nb.to_numpy(table.column("point_id")), nb.to_matrix(table.column("x"))
        order = np.argsort(ids)
        root, levels = model.value[int(table.column("cell")[0].as_py())]
        x, fresh = x[order], []
        if root.basis is None:
            center = x.mean(axis=0)
            root = Cell(root.node_id, root.n, center, center, *linear.basis_from_rows(x - center, d))
            fresh = [root]
        cells = fresh + _grow_local(root, ids[order], x, d, levels, rounds, prune, against)
        flat = lambda values, size: nb.from_matrix(np.array(values).reshape(len(cells), size))
        width = x.shape[1]
        return pa.table({
            "node_id": pa.array([c.node_id for c in cells], pa.int64()), "n": pa.array([c.n for c in cells], pa.int64()),
            "center": flat([c.center for c in cells], width), "split_center": flat([c.split_center for c in cells], width),
            "basis": flat([c.basis for c in cells], width * d), "svals": flat([c.svals for c in cells], d)})

    grown = rows.mapInArrow(send, "point_id long, x array<double>, cell long").groupBy("cell").applyInArrow(
        grow, "node_id long, n long, center array<double>, split_center array<double>, basis array<double>, svals array<double>")
    return [Cell(r.node_id, r.n, np.array(r.center), np.array(r.split_center),
                 np.array(r.basis).reshape(d, -1), np.array(r.svals)) for r in grown.collect()]


def fit_tree(points: DataFrame, d: int, resolution: int, *, prune: float | None = PRUNE, against: str = "sibling",
             rounds: int = ROUNDS, max_local_rows: int | None = None, factor_bytes: int = FACTOR_BYTES) -> CellTree:
    """Fit levels ``0 .. resolution`` of the cell tree over ``points(point_id, x)``.

    ``max_local_rows`` is the size below which a cell is handed to one task; it changes the
    route, not the result. Pruned or unsplittable cells stay leaves.
    """
    if against not in ("sibling", "parent"):
        raise ValueError("against must be 'sibling' or 'parent'")
    if d < 1 or resolution < 0:
        raise ValueError("d must be at least 1 and resolution at least 0")
    rows = _vectors(points)
    root = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if root.n == 0:
        raise ValueError("cannot fit a tree on no points")
    if root.low != root.high:
        raise ValueError(f"vectors of one table must all have the same length, found {root.low} to {root.high}")
    if resolution > MAX_LEVEL:
        raise ValueError(f"node ids of 64 bits name {MAX_LEVEL} levels, not {resolution}")
    local = max(1, LOCAL_BYTES // (8 * root.high)) if max_local_rows is None else max_local_rows
    tree = CellTree(d, root.high, {0: Cell(0, root.n, np.zeros(root.high))})
    live, small = [0], {}
    if root.n <= local:
        small = {0: resolution}
    else:
        points = _stored(rows, tree)
        center = points.agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("center")).first().center
        tree.cells[0].center = np.array(center)
        fit_cells(points, tree, {0: tree.cells[0]}, factor_bytes)
    for level in range(0 if small else resolution):
        if level and level % STORED_LEVELS == 0:
            points = _stored(points, tree)
        small |= {k: resolution - level for k in live if 1 < tree.cells[k].n <= local}
        live = [k for k in live if tree.cells[k].n > max(1, local)]
        if not live:
            break
        live = next_resolution(points, tree, live, prune=prune, against=against, rounds=rounds, factor_bytes=factor_bytes)
        if len(tree.cells) * root.high * 16 > 4 * storage.BROADCAST_LIMIT:
            raise ValueError(f"{len(tree.cells)} cells of {root.high} columns are more centers than tasks can hold; lower the resolution")
    if small:
        for cell in _grow_small(points, tree, small, rounds, prune, against):
            tree.cells[cell.node_id] = cell
    tree.cells[0].split_center = None
    return tree


def next_resolution(points: DataFrame, tree: CellTree, live: list[int], *, prune: float | None = PRUNE,
                    against: str = "sibling", rounds: int = ROUNDS, factor_bytes: int = FACTOR_BYTES) -> list[int]:
    """One level step on all ``live`` cells with more than one point; adds the kept children to the tree."""
    targets = [k for k in live if tree.cells[k].n > 1]
    if not targets:
        return []
    children = split_cells(points, tree, targets, rounds)
    if not children:
        return []
    fit_cells(points, tree, children, factor_bytes)
    kept = []
    for k in targets:
        left, right = children.get(2 * k + 1), children.get(2 * k + 2)
        if left is not None and keeps_split(tree.cells[k], left, right, prune, against):
            tree.cells[left.node_id], tree.cells[right.node_id] = left, right
            kept += [left.node_id, right.node_id]
    return kept


def prune_cells(nodes: DataFrame, eps: float = PRUNE, against: str = "sibling") -> DataFrame:
    """A node table without the splits whose subspace cosine is ``eps`` or more.

    Whole subtrees go: a cell stays only if every split above it stays.
    """
    cosines = subspace_cosines(nodes, against)
    bad = cosines.groupBy("parent_id").agg(F.min("cosine").alias("cosine")).where(F.col("cosine") >= eps)
    ancestors = nodes.select("node_id", F.explode(ancestor_ids(F.col("node_id"))).alias("parent_id"))
    gone = ancestors.join(bad, "parent_id", "left_semi").select("node_id").distinct()
    kept = nodes.join(gone, "node_id", "left_anti")
    inner = kept.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    return kept.drop("is_leaf").join(inner, "node_id", "left").withColumn("is_leaf", F.col("_in").isNull()).drop("_in")


def ancestor_ids(node_id):
    """All proper ancestors of a heap id, as an array expression (62 levels cover any long)."""
    chain = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: F.call_function("shiftright", node_id + 1, i) - 1)
    return F.filter(chain, lambda a: a >= 0)


def subspace_cosines(nodes: DataFrame, against: str = "sibling") -> DataFrame:
    """``(parent_id, node_id, cosine)`` of each split, sibling against sibling or child against parent.

    Narrower bases count as zero-padded. Cosines of an empty basis are 0.
    """
    flat = nodes.select("node_id", "parent_id", F.flatten("basis").alias("b"))
    if against == "sibling":
        left = flat.where("node_id % 2 = 1").select("parent_id", "node_id", F.col("b").alias("a"))
        right = flat.where("node_id % 2 = 0 and node_id > 0").select("parent_id", "b")
        pairs = left.join(right, "parent_id")
    else:
        parents = flat.select(F.col("node_id").alias("parent_id"), F.col("b").alias("a"))
        pairs = flat.where("node_id > 0").select("parent_id", "node_id", "b").join(parents, "parent_id")
    shared = F.least(F.size("a"), F.size("b"))
    inner = arrays.dot(F.slice("a", F.lit(1), shared), F.slice("b", F.lit(1), shared))
    size = F.sqrt(arrays.dot(F.col("a"), F.col("a")) * arrays.dot(F.col("b"), F.col("b")))
    return pairs.select("parent_id", "node_id", F.when(size > 0, inner / size).otherwise(0.0).alias("cosine"))


def _basis_groups(tree: CellTree) -> list[list[int]]:
    """Node ids in groups whose bases fit a broadcast; a large model is applied in several passes."""
    per_cell = tree.width * (tree.d + 1) * 8
    fit = max(1, storage.BROADCAST_LIMIT // per_cell)
    ids = sorted(tree.cells)
    return [ids[s : s + fit] for s in range(0, len(ids), fit)]


def _apply(points: DataFrame, tree: CellTree, by: str, compute, schema: str | StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Run ``compute(ids, path, x, cells, kept columns)`` in tasks; ``path`` is the node of each row per level."""
    rows, spark = _vectors(points, keep), points.sparkSession
    centers = {k: (c.split_center if by == "split" else c.center) for k, c in tree.cells.items() if k}
    width = tree.width
    routes = _share(spark, centers, width)
    by_level = [sorted(k for k in tree.cells if level_of(k) == j) for j in range(tree.depth + 1)] if by == "level" else None
    result = None
    for group in _basis_groups(tree):
        cells = {k: (tree.cells[k].center, tree.cells[k].basis) for k in group}
        model = storage.checked_broadcast(spark, cells, len(cells) * width * (tree.d + 1) * 8, "a group of bases")

        def task(it, model=model):
            for batch in it:
                if batch.num_rows == 0:
                    continue
                x = nb.to_matrix(batch.column("x"))
                if x.shape[1] != width:
                    raise ValueError(f"points of length {x.shape[1]} do not fit a tree over length {width}")
                if by_level is None:
                    path = routes.value.path(x)
                else:
                    path = _nearest_by_level(x, by_level, routes.value)
                kept = [batch.column(c) for c in keep]
                yield from compute(batch.column("point_id"), path, x, model.value, *kept)

        part = rows.mapInArrow(task, schema)
        result = part if result is None else result.unionByName(part)
    return result


def _nearest_by_level(x, by_level, router: Router) -> list[np.ndarray]:
    path = [np.zeros(len(x), np.int64)]
    for ids in by_level[1:]:
        ids = np.array(ids)
        slots = router.slots((ids - 1) // 2)
        centers = np.where((ids % 2 == 1)[:, None], router.left[slots], router.right[slots])
        path.append(ids[nb.nearest(x, centers)[0]])
    return path


def _in_cells(x, nodes, cells):
    for k in np.unique(nodes):
        if int(k) in cells:
            rows = np.flatnonzero(nodes == k)
            yield int(k), rows, x[rows] - cells[int(k)][0], cells[int(k)][1]


def _rep_batches(ids, path, x, cells):
    for level, nodes in enumerate(path):
        moved = np.ones(len(nodes), bool) if level == 0 else nodes != path[level - 1]
        for k, rows, xc, basis in _in_cells(x, np.where(moved, nodes, -1), cells):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(np.full(len(rows), level), pa.int32()),
                 pa.array(np.full(len(rows), k)), nb.from_matrix(xc @ basis.T)],
                names=["point_id", "level", "node_id", "z"])


def representations(points: DataFrame, tree: CellTree) -> DataFrame:
    """``z = basis (x - center)`` of the training points in every cell they belong to."""
    return _apply(points, tree, "split", _rep_batches, REP_SCHEMA)


def project_points(points: DataFrame, tree: CellTree) -> DataFrame:
    """New points routed to the child with the nearer center at each level; one ``z`` per level."""
    return _apply(points, tree, "center", _rep_batches, REP_SCHEMA)


def project_points_by_level(points: DataFrame, tree: CellTree) -> DataFrame:
    """New points sent to the nearest center among all cells of each level, whatever the level above said."""
    return _apply(points, tree, "level", _rep_batches, REP_SCHEMA)


def _hats(path, x, cells, level):
    """``P_level(x)`` of the rows, or as much of it as the cells at hand cover."""
    nodes = path[min(level, len(path) - 1)]
    for k, rows, xc, basis in _in_cells(x, nodes, cells):
        yield k, rows, xc @ basis.T @ basis + cells[k][0]


def reconstructions(points: DataFrame, tree: CellTree) -> DataFrame:
    """``P_j(x)`` of training points per level, including levels below an early leaf: ``(point_id, level, node_id, x_hat)``."""
    depth = tree.depth

    def compute(ids, path, x, cells):
        for level in range(depth + 1):
            for k, rows, hat in _hats(path, x, cells, level):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), level), pa.int32()),
                     pa.array(np.full(len(rows), k)), nb.from_matrix(hat)], names=["point_id", "level", "node_id", "x_hat"])

    return _apply(points, tree, "split", compute, "point_id long, level int, node_id long, x_hat array<double>")


def wavelets(points: DataFrame, tree: CellTree) -> DataFrame:
    """``Q_j(x) = P_{j+1}(x) - P_j(x)`` per point: ``(point_id, level, q)`` for levels ``0 .. depth - 1``.

    All levels of a point are at hand in one task, so nothing is shuffled, unless the model has to
    be applied in several passes.
    """
    depth = tree.depth
    if len(_basis_groups(tree)) > 1:
        order = Window.partitionBy("point_id").orderBy("level")
        steps = reconstructions(points, tree).withColumn("finer", F.lead("x_hat").over(order))
        return steps.where(F.col("finer").isNotNull()).select(
            "point_id", "level", arrays.subtract(F.col("finer"), F.col("x_hat")).alias("q"))

    def compute(ids, path, x, cells):
        coarse = None
        for level in range(depth + 1):
            fine = np.empty_like(x)
            for _, rows, hat in _hats(path, x, cells, level):
                fine[rows] = hat
            if level:
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(x), level - 1), pa.int32()), nb.from_matrix(fine - coarse)],
                    names=["point_id", "level", "q"])
            coarse = fine

    return _apply(points, tree, "split", compute, "point_id long, level int, q array<double>")


def wavelet_bases(nodes: DataFrame) -> DataFrame:
    """``Psi = (I - Phi_parent Phi_parent^T) Phi_child`` of every child cell: ``(node_id, psi)``, directions as rows."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("basis").alias("up"))

    def remove(v):
        """One child direction less its part in the parent's plane."""
        return F.aggregate("up", v, lambda acc, u: F.zip_with(acc, F.transform(u, lambda w: w * arrays.dot(u, v)), lambda p, q: p - q))

    return nodes.join(parents, "parent_id").select("node_id", F.transform("basis", remove).alias("psi"))


def fill_levels(reps: DataFrame, levels: int) -> DataFrame:
    """One row per point and level ``0 .. levels - 1``; missing levels repeat the deepest cell above them.

    A point has at most one row per level, so a point's window is bounded by the depth.
    """
    order = Window.partitionBy("point_id").orderBy("level")
    spans = reps.where(F.col("level") < levels).withColumn(
        "until", F.coalesce(F.lead("level").over(order), F.lit(levels)) - 1)
    return spans.select("point_id", F.explode(F.sequence("level", "until")).alias("level"), "node_id", "z")


def multiscale_features(reps: DataFrame, levels: int, d: int) -> DataFrame:
    """The ``z`` of the first ``levels`` levels, each cut or zero-filled to ``d``, as one vector per point."""
    sized = fill_levels(reps, levels).select("point_id", "level", arrays.fit_length(F.col("z"), d).alias("z"))
    gathered = sized.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("level", "z"))).alias("rows"))
    return gathered.select("point_id", F.flatten("rows.z").alias("x"))


def feature_vectors(points: DataFrame, tree: CellTree, levels: int | None = None, d: int | None = None, *,
                    new_points: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The same features straight from points and model, in one pass without a shuffle: ``(point_id, x)``
    and any columns of ``points`` named in ``keep``."""
    levels = tree.depth + 1 if levels is None else levels
    d = tree.d if d is None else d
    if len(_basis_groups(tree)) > 1:
        made = multiscale_features((project_points if new_points else representations)(points, tree), levels, d)
        return made.join(points.select("point_id", *keep), "point_id") if keep else made

    def compute(ids, path, x, cells, *kept):
        out = np.zeros((len(x), levels, d))
        for level in range(levels):
            for _, rows, xc, basis in _in_cells(x, path[min(level, len(path) - 1)], cells):
                z = xc @ basis[:d].T
                out[rows, level, : z.shape[1]] = z
        yield pa.RecordBatch.from_arrays([ids, nb.from_matrix(out.reshape(len(x), -1)), *kept], names=["point_id", "x", *keep])

    schema = StructType.fromDDL("point_id long, x array<double>")
    for c in keep:
        schema = schema.add(points.schema[c])
    return _apply(points, tree, "center" if new_points else "split", compute, schema, keep)


def check_partition(reps: DataFrame, levels: int) -> DataFrame:
    """``(level, n_points, n_cells, violations)``: points not in exactly one cell of the level, or in a
    cell that does not lie in the point's cell of the level above. Zero violations for a sound tree."""
    full = fill_levels(reps.select("point_id", "level", "node_id", F.lit(None).cast("array<double>").alias("z")), levels)
    order = Window.partitionBy("point_id").orderBy("level", "node_id")
    above = F.lag("node_id").over(order)
    nested = (F.col("node_id") == above) | (F.shiftright(F.col("node_id") - 1, 1) == above) | (F.col("level") == 0)
    marked = full.select("level", "point_id", "node_id", F.when(~nested, 1).otherwise(0).alias("stray"))
    seats = marked.groupBy("level", "point_id").agg(F.count(F.lit(1)).alias("cells"), F.max("stray").alias("stray"),
                                                    F.min("node_id").alias("node_id"))
    return seats.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("node_id").alias("n_cells"),
        F.sum(F.when((F.col("cells") != 1) | (F.col("stray") == 1), 1).otherwise(0)).alias("violations"))


def level_sizes(members: DataFrame, width: int) -> DataFrame:
    """Cells, points, largest cell and its size in KB per level of ``members(level, node_id)``."""
    cells = members.groupBy("level", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_points"), F.max("n").alias("max_points"),
        (F.max("n") * F.lit(width * 8 / 1024.0)).alias("max_kb"))
