"""Metric joins as keyed blocks of rows.

The data side is cut into nested cells around pivots, and every leaf into blocks of bounded size.
A query row goes only to the leaves that the bounds cannot rule out. Both sides
then meet on a (cell, data block, query block) key through one shuffle: a task holds one data
block and streams the query rows of the same key past it. No block depends on how many rows
share a cell, so a crowded cell becomes more blocks and never a larger task. With few rows,
or where no bound can help, the plan has one cell and no pivots. Within one table, rows of a cell
meet the blocks from their own on, so that no two blocks meet twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.functions import batches as nb
from manyscale.functions.metrics import Metric
from manyscale.plans import storage
from manyscale.plans.cells import BLOCK_VALUES, MAX_CELLS, TILE_VALUES, CellPairs, Cells, Nearest, Pairs, Within, decode, exact_block, grouped, measured

BLOCK_BYTES = 16 * 1024 * 1024
#: Tasks of a join for each core.
TASKS = 16
PIVOT_ROWS = 20_000
HIT = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("cell", "lo", "hi")]))


@dataclass
class Side:
    """The rows of one side of a block, as numpy columns; ``same`` marks rows that meet their own block."""

    ids: np.ndarray
    points: np.ndarray
    columns: dict[str, pa.Array]
    lo: np.ndarray
    hi: np.ndarray
    home: np.ndarray
    same: np.ndarray
    cap: np.ndarray
    cell: int
    _ready: list = field(default_factory=list)

    def ready(self, metric: Metric):
        """What the metric makes of the points for products, worked out once for a block."""
        if not self._ready:
            self._ready.append(metric.products(self.points))
        return self._ready[0]

    def slice(self, s: int, e: int) -> Side:
        return Side(self.ids[s:e], self.points[s:e], {k: v[s:e] for k, v in self.columns.items()},
                    self.lo[s:e], self.hi[s:e], self.home[s:e], self.same[s:e], self.cap[s:e], self.cell)


def block_rows(width: int, metric: Metric) -> int:
    """Rows per block from the width of a row."""
    if metric.textual:
        return 8192
    return int(min(131_072, max(1024, BLOCK_BYTES // (8 * max(1, width)))))


def _spread_rows(data: DataFrame, count: int, metric: Metric) -> np.ndarray:
    """``count`` rows in a fixed pseudo-random order of their ids."""
    rows = data.orderBy(F.xxhash64("id"), "id").select("x").limit(count).collect()
    return np.array([r.x for r in rows], dtype=object if metric.textual else float)


def pick_pivots(data: DataFrame, count: int, metric: Metric) -> np.ndarray:
    """At most ``count`` distinct points of the table, in the fixed order."""
    rows = _spread_rows(data, count, metric)
    if metric.textual:
        return np.array(list(dict.fromkeys(rows)), dtype=object)
    return rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])]


def cell_count(n: int, rows_per_block: int, most: int = MAX_CELLS) -> int:
    """Leaves for ``n`` rows; their pivots are no larger than a block."""
    return min(most, math.ceil(math.sqrt(n)), max(64, rows_per_block))


def copies(n_queries: int, n: int, rows_per_block: int, workers: int) -> int:
    """Rows of either side that travel if every query meets every block."""
    data_blocks = max(1, -(-n // rows_per_block))
    return n_queries * data_blocks + n * -(-n_queries // query_rows(n_queries * data_blocks, workers))


def query_rows(work: int, workers: int) -> int:
    """Query rows of a block. They are streamed, so their blocks only have to be small enough to share out the work."""
    return max(128, -(-work // (8 * workers)))


def make_cells(data: DataFrame, n: int, metric: Metric, rows_per_block: int, near: int, count: int | None,
               queries: DataFrame, rule: Within | Nearest) -> Cells:
    """Cells for the ``n`` rows of ``data(id, x)``: a single one for a small table, unless asked otherwise.

    Pivots only pay if the bounds rule rows out. On data where they do not, such as isotropic
    vectors of many dimensions, a query would travel to every cell for nothing, so plain blocks
    are used when a look at some queries shows them visiting more than half of the rows.
    """
    if n == 0 or (count is None and n <= min(rows_per_block, PIVOT_ROWS)) or (count is not None and count <= 1):
        return Cells.one(n)
    pivots = pick_pivots(data, count or cell_count(n, rows_per_block), metric)
    cells = measured(data, metric, Cells.nested(metric, pivots, near))
    return cells if count is not None or visited_share(queries, metric, cells, rule) <= 0.5 else Cells.one(n)


def visited_share(queries: DataFrame, metric: Metric, cells: Cells, rule: Within | Nearest, look: int = 256) -> float:
    """The share of data rows that a query has to be compared with, judged on a few queries."""
    points = _spread_rows(queries, look, metric)
    if len(points) == 0:
        return 0.0
    pairs, _, _ = rule.walk(cells, metric, points)
    return float(cells.rows[pairs.cell].sum() / len(points) / max(1, cells.rows.sum()))


class Home:
    """Only the leaf that a query belongs to."""

    def walk(self, cells: Cells, metric: Metric, points: np.ndarray, known=None, home=None):
        n = len(points)
        own = Pairs(np.arange(n), home[-1], np.zeros(n), np.full(n, np.inf), np.zeros(n))
        return own, np.zeros(n, np.int32), np.full(n, np.inf)


def home_distances(queries: DataFrame, data: DataFrame, metric: Metric, cells: Cells, k: int, rows_per_block: int) -> DataFrame:
    """``queries(id, x)`` with ``known``: the k-th distance within one block of the query's own cell.

    Nearly the true k-th distance, so a second visit only needs the cells that really come close.
    Stored, because it is read more than once and cost a join.
    """

    def task(q: Side, x: Side | None) -> Iterator[pa.RecordBatch]:
        known = np.full(len(q.ids), np.inf)
        if x is not None and len(x.ids) >= k:
            d, slack = metric.block(q.points, x.points)
            known = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
        points = pa.array(q.points.tolist(), pa.string()) if metric.textual else nb.from_matrix(q.points)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids), points, pa.array(known)], names=["id", "x", "known"])

    schema = T.StructType([queries.schema["id"], queries.schema["x"], T.StructField("known", T.DoubleType())])
    found, _ = block_join(queries, data, metric, cells, Home(), task, schema, rows_per_block=rows_per_block, one_block=True)
    return storage.materialize(found)


ROUTED = [T.StructField("home", T.IntegerType()), T.StructField("cap", T.DoubleType()), T.StructField("hits", HIT)]


def _with_hits(batch: pa.RecordBatch, home: np.ndarray, cap: np.ndarray, row: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """A batch with the cells that each row visits."""
    order = np.argsort(row, kind="stable")
    entries = pa.StructArray.from_arrays([pa.array(v[order], pa.int32()) for v in (cell, lo, hi)], names=["cell", "lo", "hi"])
    offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(home, pa.int32()), pa.array(cap), pa.ListArray.from_arrays(pa.array(offsets), entries)],
        names=[*batch.schema.names, "home", "cap", "hits"])


def _one_row_per_hit(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("hit", F.explode("hits")).select(*columns, "hit.cell", "hit.lo", "hit.hi", "home", "cap")


def route(queries: DataFrame, metric: Metric, cells: Cells, rule: Within | Nearest | Home, self_join: bool) -> DataFrame:
    """One row per query and cell it must visit, with columns ``cell, lo, hi, home, cap``; ``lo = 1`` marks cells to take as a whole."""
    if not cells.levels:
        zero = F.lit(0)
        return queries.select("*", zero.alias("cell"), zero.alias("lo"), F.lit(2**30).alias("hi"),
                              zero.alias("home"), F.lit(float("inf")).alias("cap"))
    shipped = queries.sparkSession.sparkContext.broadcast(cells)
    tiles = max(64, TILE_VALUES // (len(cells) * max(1, cells.levels[-1].near.shape[1])))

    def task(it: Iterator[pa.RecordBatch]):
        model = shipped.value
        for whole in it:
            for s in range(0, whole.num_rows, tiles):
                batch = whole.slice(s, tiles)
                points = decode(batch.column("x"), metric)
                known = nb.to_numpy(batch.column("known")) if "known" in batch.schema.names else None
                home = model.place(metric, points)[0] if self_join or not isinstance(rule, Within) else None
                pairs, lo, cap = rule.walk(model, metric, points, known, home)
                own = home[-1] if home is not None else np.zeros(len(points), np.int64)
                keep = pairs.cell >= own[pairs.row] if self_join else np.ones(len(pairs.row), bool)
                yield _with_hits(batch, own, cap, pairs.row[keep], pairs.cell[keep], lo[keep], lo[keep])

    return _one_row_per_hit(queries.mapInArrow(task, T.StructType([*queries.schema.fields, *ROUTED])), queries.columns)


def settle_rows(metric: Metric, points: np.ndarray, left: Cells, right: Cells, pairs: CellPairs, radii: np.ndarray):
    """What the undecided pairs of leaves leave undecided for single rows of the left leaf.

    Returns the rows' leaves, and ``(row, b, lo, hi, was)``: radii ``[lo, hi)`` stay open, all of ``b`` lies within those of ``[hi, was)``.
    Distances are exact, so a row is judged alike in any batch.
    """
    home = left.place(metric, points)[0][-1]
    found = [np.zeros((5, 0), np.int64)]
    level = right.levels[-1]
    for a, at in grouped(home):
        span = slice(int(pairs.start[a]), int(pairs.start[a + 1]))
        b = pairs.b[span]
        if not len(b):
            continue
        d = exact_block(metric, points[at], level.pivots[b])
        lower, upper = d * (1 - 1e-12) - level.radius[b], (d + level.radius[b]) * (1 + 1e-12)
        was = np.broadcast_to(pairs.hi[span], d.shape)
        lo = np.maximum(np.searchsorted(radii, lower, side="left"), pairs.lo[span])
        hi = np.minimum(np.searchsorted(radii, upper, side="left"), was)
        # Within a leaf a pair of rows is met once for both orders, so its rows have to be judged alike.
        own = (b == a) & (left is right)
        lo, hi = np.where(own, pairs.lo[span], np.minimum(lo, hi)), np.where(own, was, hi)
        keep = lo < was
        cols = np.broadcast_to(b, d.shape)
        found.append(np.stack([np.broadcast_to(at[:, None], d.shape)[keep], cols[keep], lo[keep], hi[keep], was[keep]]))
    return home, np.concatenate(found, axis=1)


def route_pairs(queries: DataFrame, metric: Metric, left: Cells, right: Cells, pairs: CellPairs, radii: np.ndarray) -> DataFrame:
    """One row per query and leaf of the other side for which some radius is still open, as ``route``."""
    shipped = storage.checked_broadcast(queries.sparkSession, (left, right, pairs), pairs.n_bytes, "the open pairs of cells")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                home, (row, b, lo, hi, _) = settle_rows(metric, decode(batch.column("x"), metric), *shipped.value, radii)
                keep = lo < hi
                yield _with_hits(batch, home, np.full(len(home), np.inf), row[keep], b[keep], lo[keep], hi[keep])

    return _one_row_per_hit(queries.mapInArrow(task, T.StructType([*queries.schema.fields, *ROUTED])), queries.columns)


def place(data: DataFrame, metric: Metric, cells: Cells) -> DataFrame:
    """The data side with the cell of every row."""
    if not cells.levels:
        return data.withColumn("cell", F.lit(0))
    shipped = data.sparkSession.sparkContext.broadcast(cells)

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                cell = shipped.value.place(metric, decode(batch.column("x"), metric))[0][-1]
                yield batch.append_column("cell", pa.array(cell, pa.int32()))

    schema = T.StructType([*data.schema.fields, T.StructField("cell", T.IntegerType())])
    return data.mapInArrow(task, schema)


def _spread(counts: np.ndarray) -> Column:
    """Number of blocks of the row's cell, as an expression."""
    if len(counts) == 1:
        return F.lit(int(counts[0]))
    return F.element_at(F.lit([int(c) for c in counts]), F.col("cell") + 1)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of both sides in their blocks, data before queries and each by id; the one shuffle of a join.

    Blocks are small tables that take long, so they are spread by their number and not by their bytes.
    """
    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "cell", "qb", "xb").sortWithinPartitions("cell", "qb", "xb", "side", "id")


def block_join(queries: DataFrame, data: DataFrame, metric: Metric, cells: Cells, rule: Within | Nearest | Home | None,
               task: Callable[[Side, Side], Iterator[pa.RecordBatch]], schema: str | T.StructType, *,
               rows_per_block: int, n_queries: int | None = None, routed: DataFrame | None = None,
               self_join: bool = False, one_block: bool = False) -> tuple[DataFrame, bool]:
    """Run ``task(query rows, data block)`` on every pair of blocks that may hold a match.

    ``queries`` and ``data`` have columns ``id, x`` and may carry more. With ``one_block`` a query
    meets one block of each cell it visits, or ``None`` if that block is empty. ``routed`` replaces what ``rule`` gives.
    The flag returned with the result says whether a query can have met several data blocks.
    """
    spark = queries.sparkSession
    routed = route(queries, metric, cells, rule, self_join) if routed is None else routed
    if not cells.levels:
        visits = np.array([queries.count() if n_queries is None else n_queries])
    else:
        visits = np.zeros(len(cells), np.int64)
        for r in routed.groupBy("cell").count().collect():
            visits[r.cell] = r["count"]
    data_blocks = np.maximum(1, -(-cells.rows // rows_per_block))
    per_block = query_rows(int((visits * data_blocks).sum()), spark.sparkContext.defaultParallelism)
    query_blocks = np.maximum(1, -(-visits // per_block))

    def own(count: Column) -> Column:
        return F.pmod(F.xxhash64("id"), count).cast("int")

    def every(count: Column, first: Column = F.lit(0)) -> Column:
        return F.explode(F.sequence(first, count - 1))

    extra_q = [c for c in queries.columns if c not in ("id", "x")]
    extra_x = [c for c in data.columns if c not in ("id", "x")]
    blocks_of = _spread(data_blocks)
    at_home = F.lit(self_join) & (F.col("cell") == F.col("home"))
    visited = own(blocks_of) if one_block else every(blocks_of, F.when(at_home, own(blocks_of)).otherwise(0))
    left = routed.withColumn("xb", visited).select(
        "cell", own(_spread(query_blocks)).alias("qb"), "xb", F.lit(1).alias("side"), "id", "x", "lo", "hi", "home",
        (at_home & (F.col("xb") == own(blocks_of))).alias("same"), "cap", F.struct(F.lit(0).alias("_"), *extra_q).alias("q"),
        F.lit(None).cast(T.StructType([T.StructField("_", T.IntegerType()), *[data.schema[c] for c in extra_x]])).alias("p"))
    right = place(data, metric, cells).select(
        "cell", every(_spread(query_blocks)).alias("qb"), own(_spread(data_blocks)).alias("xb"),
        F.lit(0).alias("side"), "id", "x", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("home"), F.lit(False).alias("same"), F.lit(0.0).alias("cap"),
        F.lit(None).cast(T.StructType([T.StructField("_", T.IntegerType()), *[queries.schema[c] for c in extra_q]])).alias("q"),
        F.struct(F.lit(0).alias("_"), *extra_x).alias("p"))

    def side(table, name: str, extra: list[str], cell: int) -> Side:
        struct = nb.single(table.column(name)) if extra else None
        return Side(nb.to_numpy(table.column("id")), decode(table.column("x"), metric),
                    {c: struct.field(c) for c in extra}, nb.to_numpy(table.column("lo")),
                    nb.to_numpy(table.column("hi")), nb.to_numpy(table.column("home")), nb.to_numpy(table.column("same")),
                    nb.to_numpy(table.column("cap")), cell)

    def run(it: Iterator[pa.RecordBatch]):
        key, held, block = None, [], None
        for batch in it:
            marks = np.stack([nb.to_numpy(batch.column(c)) for c in ("cell", "qb", "xb", "side")])
            cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                here = tuple(marks[:3, s])
                if here != key:
                    key, held, block = here, [], None
                rows = batch.slice(s, e - s)
                if marks[3, s] == 0:
                    held.append(rows)
                elif held or block is not None or one_block:
                    if held:
                        block = side(pa.Table.from_batches(held), "p", extra_x, int(here[0]))
                        held = []
                    chunk = side(rows, "q", extra_q, int(here[0]))
                    step = max(1, BLOCK_VALUES // len(block.ids)) if block else len(chunk.ids)
                    for t in range(0, len(chunk.ids), step):
                        yield from task(chunk.slice(t, t + step), block)

    met = dealt(left.unionByName(right))
    several = bool(cells.levels) or int(data_blocks.sum()) > 1
    return met.mapInArrow(run, schema), several
