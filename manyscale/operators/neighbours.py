"""Nearest neighbours, radius searches, pair joins and pair counts in any metric.

Inputs are tables with an id and a point column. Distances compare inclusively and ties
are ordered by ``(distance, id)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from manyscale.functions import arrays
from manyscale.functions.batches import from_lists, from_matrix, to_numpy
from manyscale.functions.metrics import Metric, named
from manyscale.operators import edit_joins
from manyscale.plans import blocks, cells as nests, sketches, storage
from manyscale.plans.blocks import Side

COPIES = 10_000
#: Edits up to which strings are counted over segments; with more, segments are too short to tell strings apart.
MAX_EDITS = 8
REFINE_ROWS = 50_000
#: Ids that a list of neighbours or distances covers.
SEGMENT = 1 << 16


def _side(df: DataFrame, id_col: str, x_col: str, metric: Metric, extra: Sequence[str] = ()) -> DataFrame:
    x = F.col(x_col).cast("string") if metric.textual else arrays.doubles(x_col)
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *extra)


def _width(side: DataFrame, metric: Metric) -> int | None:
    first = None if metric.textual else side.select(F.size("x").alias("d")).first()
    return first.d if first else None


def check_widths(a: DataFrame, b: DataFrame, metric: Metric) -> int:
    """Both sides must hold points of one shape; looked at on one row per side. Returns the width."""
    widths = [w for w in ((_width(s, metric) for s in ((a,) if a is b else (a, b)))) if w is not None]
    if len(set(widths)) > 1:
        raise ValueError(f"points of length {widths[0]} searched among points of length {widths[1]}")
    return widths[0] if widths else 1


def _crowded(side: DataFrame, rows: int) -> list[int]:
    """Hashes of points that occur very often; at most ``rows / limit`` of them exist."""
    limit = max(COPIES, rows // 10_000)
    hashed = side.groupBy(F.xxhash64("x").alias("h")).count().where(F.col("count") >= limit)
    return [r.h for r in hashed.collect()]


def _first_copies(side: DataFrame, hashes: list[int], keep: int) -> DataFrame:
    """Of every crowded point only the ``keep`` smallest ids, which are all that ``keep`` answers can use."""
    crowded = F.xxhash64("x").isin(hashes)
    order = Window.partitionBy("x").orderBy("id")
    few = side.where(crowded).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")
    return side.where(~crowded).unionByName(few)


def _best(d: np.ndarray, slack: float, k: int, ceiling: np.ndarray, ids: np.ndarray, measure) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, cols, distances, ranks)`` of the ``k`` nearest of each row of a block; ``measure(rows, cols)`` gives exact distances."""
    take = min(k, d.shape[1])
    kth = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
    rows, cols = np.nonzero((d <= np.minimum(kth, ceiling[:, None]) + 2 * slack) & np.isfinite(d))
    gaps = measure(rows, cols) if slack else d[rows, cols]
    inside = gaps <= ceiling[rows]
    rows, cols, gaps = rows[inside], cols[inside], gaps[inside]
    order = np.lexsort((ids[cols], gaps, rows))
    rows, cols, gaps = rows[order], cols[order], gaps[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
    keep = rank <= k
    return rows[keep], cols[keep], gaps[keep], rank[keep]


def _top_task(metric: Metric, k: int, limit: float, payload: list[str], exclude_self: bool):
    def task(q: Side, x: Side) -> Iterator[pa.RecordBatch]:
        d, slack = metric.block(q.points, x.points)
        if exclude_self:
            d[q.ids[:, None] == x.ids[None, :]] = np.inf
        rows, cols, gaps, rank = _best(d, slack, k, np.minimum(q.cap, limit), x.ids, lambda i, j: nests.exact(metric, q.points, x.points, i, j))
        picked = pa.array(cols)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.ids[rows]), pa.array(rank, pa.int32()), pa.array(x.ids[cols]), pa.array(gaps),
             *[x.columns[c].take(picked) for c in payload]],
            names=["q_id", "rank", "nbr_id", "d", *payload])

    return task


def knn_sweep(queries: DataFrame, data: DataFrame, k: int, dims: Sequence[int], levels: Sequence[int], widest: int, *,
              payload: Sequence[str] = (), rows_per_block: int | None = None) -> DataFrame:
    """Nearest neighbours for many cuts of the same vectors in one join: ``(dim, levels, q_id, rank, nbr_id, d, payload...)``.

    A vector holds ``widest`` numbers for each level. The cut ``(dim, levels)`` keeps the first ``dim`` numbers of each of the first ``levels``;
    its squared distances add up level by level, so every cut costs the distances of one more level and no row travels twice.
    """
    metric, payload = named("euclidean"), list(payload)
    q, x = _side(queries, "point_id", "x", metric), _side(data, "point_id", "x", metric, payload)
    width = check_widths(q, x, metric)
    if max(levels) * widest > width or max(dims) > widest:
        raise ValueError(f"vectors of length {width} do not hold {max(levels)} levels of {widest} numbers with cuts of {max(dims)}")
    n, size, kept = x.count(), rows_per_block or blocks.block_rows(width, metric), set(levels)

    def task(one: Side, other: Side) -> Iterator[pa.RecordBatch]:
        for dim in dims:
            square, slack = 0.0, 0.0
            for level in range(max(levels)):
                part = slice(level * widest, level * widest + dim)
                d, off = metric.block(np.ascontiguousarray(one.points[:, part]), np.ascontiguousarray(other.points[:, part]))
                square, slack = square + d * d, slack + off * off
                if level + 1 not in kept:
                    continue
                columns = np.concatenate([np.arange(j * widest, j * widest + dim) for j in range(level + 1)])
                a, b = one.points[:, columns], other.points[:, columns]
                # Each level's squares are off by at most the square of its slack.
                rows, cols, gaps, rank = _best(np.sqrt(square), 2 * np.sqrt(slack) + 1e-300, k, np.full(len(one.ids), np.inf), other.ids,
                                               lambda i, j, a=a, b=b: nests.exact(metric, a, b, i, j))
                picked = pa.array(cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), dim), pa.int32()), pa.array(np.full(len(rows), level + 1), pa.int32()), pa.array(one.ids[rows]),
                     pa.array(rank, pa.int32()), pa.array(other.ids[cols]), pa.array(gaps), *[other.columns[c].take(picked) for c in payload]],
                    names=["dim", "levels", "q_id", "rank", "nbr_id", "d", *payload])

    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("levels", T.IntegerType()), T.StructField("q_id", T.LongType()),
                           T.StructField("rank", T.IntegerType()), T.StructField("nbr_id", T.LongType()), T.StructField("d", T.DoubleType()),
                           *[x.schema[c] for c in payload]])
    found, several = blocks.block_join(q, x, metric, nests.Cells.one(n), None, task, schema, rows_per_block=size)
    if several:
        order = Window.partitionBy("dim", "levels", "q_id").orderBy("d", "nbr_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found


def knn_join(queries: DataFrame, data: DataFrame, k: int, *, metric: str | Metric = "euclidean",
             query_id: str = "point_id", data_id: str = "point_id", query_x: str = "x", data_x: str = "x",
             distance_upper_bound: float = np.inf, eps: float = 0.0, payload: Sequence[str] = (),
             exclude_self: bool = False, cells: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """The ``k`` nearest data rows of each query: ``(q_id, rank, nbr_id, d, payload...)``.

    With ``eps`` the k-th distance may be up to ``1 + eps`` times the true one. ``payload``
    columns of the data travel with the neighbours, so no join back is needed.
    """
    if k is None or int(k) != k or k < 1:
        raise ValueError(f"k must be a whole number of at least one, not {k!r}; use neighbours_within for all")
    metric = named(metric)
    payload = list(payload)
    q = _side(queries, query_id, query_x, metric)
    x = _side(data, data_id, data_x, metric, payload)
    width = check_widths(q, x, metric)
    size = rows_per_block or blocks.block_rows(width, metric)
    need = k + 1 if exclude_self else k
    n = x.count()
    copies = _crowded(x, n) if n > min(size, blocks.PIVOT_ROWS) else []
    asked = q
    if copies:
        x = _first_copies(x, copies, need)
        asked = _first_copies(q, copies, 1)
        n = x.count()
    rule = nests.Nearest(need, eps, distance_upper_bound)
    model = blocks.make_cells(x, n, metric, size, need, cells, asked, rule)
    if model.levels and n > REFINE_ROWS:
        asked = blocks.home_distances(asked, x, metric, model, need, size)
    want, skip = need if copies else k, exclude_self and not copies
    sketch = None if model.levels else _sketch(asked, x, n, metric, size, _open_nearest(need))
    if sketch:
        found = _sketched_top(asked, x, n, metric, sketch, want, distance_upper_bound, payload, skip, size)
    else:
        schema = T.StructType([T.StructField("q_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                               T.StructField("nbr_id", T.LongType()), T.StructField("d", T.DoubleType()),
                               *[x.schema[c] for c in payload]])
        found, several = blocks.block_join(
            asked, x, metric, model, rule, _top_task(metric, want, distance_upper_bound, payload, skip), schema, rows_per_block=size)
        if several:
            found = _ranked(found, want)
    if copies:
        found = _answer_copies(found, q, asked, copies)
        if exclude_self:
            found = _ranked(found.where("q_id <> nbr_id"), k)
    return found.select("q_id", "rank", "nbr_id", "d", *payload)


#: Rows of a table from which sketches are considered; below, two more joins cost more than the bytes they save.
SKETCH_ROWS = 500_000


def _sketch(queries: DataFrame, data: DataFrame, n: int, metric: Metric, size: int, open_pairs) -> sketches.Sketch | None:
    """A sketch for a join in which every query meets every block, if it saves half of the bytes."""
    if not metric.flat or n < SKETCH_ROWS:
        return None
    n_queries = n if queries is data else queries.count()
    looks = [blocks._spread_rows(side, count, metric) for side, count in ((queries, sketches.LOOK_QUERIES), (data, sketches.LOOK_ROWS))]
    travelling = blocks.copies(n_queries, n, size, queries.sparkSession.sparkContext.defaultParallelism)
    return sketches.choose(*looks, travelling, lambda low, high: open_pairs(low, high, n_queries, n))


def _open_nearest(k: int):
    """Estimate: for each neighbour as many rows as come below the least upper bound of some rows."""
    return lambda low, high, n_queries, n: n_queries * k * float((low <= high.min(axis=1, keepdims=True)).sum(axis=1).mean())


def _open_within(r: float):
    return lambda low, high, n_queries, n: n_queries * n * float((low <= r).mean())


def _sketched_top(asked: DataFrame, x: DataFrame, n: int, metric: Metric, sketch: sketches.Sketch, k: int, limit: float,
                  payload: list[str], exclude_self: bool, size: int) -> DataFrame:
    """Neighbours through sketches: rows whose lower bound is within the ``k``-th upper bound are measured. Ids are unique."""

    def task(q: Side, other: Side) -> Iterator[pa.RecordBatch]:
        low, high = sketches.bounds(q.points, other.points)
        if exclude_self:
            own = q.ids[:, None] == other.ids[None, :]
            low[own] = high[own] = np.inf
        ceiling = np.full(len(q.ids), limit)
        if high.shape[1] >= k:
            ceiling = np.minimum(ceiling, np.partition(high, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero((low <= ceiling[:, None]) & np.isfinite(low))
        picked = pa.array(cols)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.ids[rows]), pa.array(other.ids[cols]), pa.array(low[rows, cols]), pa.array(high[rows, cols]),
             *[other.columns[c].take(picked) for c in payload]], names=["q_id", "nbr_id", "_low", "_high", *payload])

    schema = T.StructType([T.StructField("q_id", T.LongType()), T.StructField("nbr_id", T.LongType()), T.StructField("_low", T.DoubleType()),
                           T.StructField("_high", T.DoubleType()), *[x.schema[c] for c in payload]])
    found, several = blocks.block_join(sketches.encoded(asked.select("id", "x"), sketch), sketches.encoded(x, sketch), sketch.metric(),
                                       nests.Cells.one(n), None, task, schema, rows_per_block=size)
    if several:
        place = F.row_number().over(Window.partitionBy("q_id").orderBy("_high", "nbr_id"))
        ceiling = F.min(F.when(F.col("_place") >= k, F.col("_high"))).over(Window.partitionBy("q_id"))
        found = found.withColumn("_place", place).withColumn("_ceiling", ceiling).where("_ceiling IS NULL OR _low <= _ceiling").drop("_place", "_ceiling")
    exact = sketches.refined(found.drop("_low", "_high"), asked, x, metric, "q_id", "nbr_id").where(F.col("d") <= limit)
    return _ranked(exact, k)


def _sketched_pairs(left: DataFrame, right: DataFrame, n: int, metric: Metric, sketch: sketches.Sketch, r: float, self_join: bool, size: int) -> DataFrame:
    """Pairs ``(i, j, d)`` through sketches: those whose lower bound is within ``r`` are measured. Ids are unique."""

    def task(q: Side, other: Side) -> Iterator[pa.RecordBatch]:
        hit = sketches.bounds(q.points, other.points)[0] <= r
        if self_join:
            hit &= ~q.same[:, None] | (q.ids[:, None] < other.ids[None, :])
        rows, cols = np.nonzero(hit)
        i, j = q.ids[rows], other.ids[cols]
        if self_join:
            i, j = np.minimum(i, j), np.maximum(i, j)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

    coded = sketches.encoded(left, sketch)
    others = coded if left is right else sketches.encoded(right, sketch)
    found, _ = blocks.block_join(coded, others, sketch.metric(), nests.Cells.one(n), None, task, "i long, j long",
                                 rows_per_block=size, n_queries=n if left is right else None, self_join=self_join)
    return sketches.refined(found, left, right, metric, "i", "j").where(F.col("d") <= r)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy("d", "nbr_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer_copies(found: DataFrame, q: DataFrame, asked: DataFrame, copies: list[int]) -> DataFrame:
    """Give every copy of a crowded query point the answer of the one copy that was asked.

    Only as many points are crowded as ``_crowded`` allows, so their answers are a small table.
    """
    crowded = F.xxhash64("x").isin(copies)
    speakers = asked.where(crowded).select(F.col("id").alias("q_id"), "x")
    answers = F.broadcast(found.join(F.broadcast(speakers), "q_id"))
    spread = q.where(crowded).select(F.col("id").alias("copy_id"), "x").join(answers, "x")
    spread = spread.select(F.col("copy_id").alias("q_id"), *[c for c in found.columns if c != "q_id"])
    return found.join(F.broadcast(speakers.select("q_id")), "q_id", "left_anti").unionByName(spread)


def pad_neighbours(found: DataFrame, queries: DataFrame, k: int, missing_id: int, *,
                   query_id: str = "point_id") -> DataFrame:
    """Exactly ``k`` rows per query; missing neighbours have infinite distance and ``missing_id``."""
    slots = queries.select(F.col(query_id).cast("long").alias("q_id"),
                           F.explode(F.sequence(F.lit(1), F.lit(int(k)))).alias("rank"))
    return slots.join(found, ["q_id", "rank"], "left").select(
        "q_id", "rank", F.coalesce("nbr_id", F.lit(missing_id).cast("long")).alias("nbr_id"),
        F.coalesce("d", F.lit(float("inf"))).alias("d"))


def _within(metric: Metric, r: float, self_join: bool, q: Side, x: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, cols, distances)`` of the pairs of two blocks within ``r``, and of those in leaves that are taken whole."""
    whole = q.lo == 1
    hit, d = x.ready(metric).within(q.points, r) if metric.products else None, None
    open_ = hit is not None
    if not open_:
        d, slack = metric.block(q.points, x.points)
        hit, open_ = d <= r + slack, bool(slack)
    if whole.any():
        hit |= whole[:, None]
    if self_join and q.same.any():
        hit &= ~q.same[:, None] | (q.ids[:, None] < x.ids[None, :])
    rows, cols = np.nonzero(hit)
    gaps = nests.exact(metric, q.points, x.points, rows, cols) if open_ else d[rows, cols]
    inside = (gaps <= r) | whole[rows]
    return rows[inside], cols[inside], gaps[inside]


def _pairs_task(metric: Metric, r: float, self_join: bool):
    def task(q: Side, x: Side) -> Iterator[pa.RecordBatch]:
        rows, cols, gaps = _within(metric, r, self_join, q, x)
        i, j = q.ids[rows], x.ids[cols]
        if self_join:
            i, j = np.minimum(i, j), np.maximum(i, j)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gaps)], names=["i", "j", "d"])

    return task


def _lists_task(metric: Metric, r: float, segment: int | None):
    """Neighbours within ``r`` as one list for each query row and data block, nearest first, or for each segment of ids in it."""

    def task(q: Side, x: Side) -> Iterator[pa.RecordBatch]:
        rows, cols, gaps = _within(metric, r, False, q, x)
        ids = x.ids[cols]
        part = ids // segment if segment else np.zeros(len(ids), np.int64)
        # The rows of a block are in the order of their ids, and equal distances stay so.
        order = np.lexsort((gaps, part, rows) if segment else (gaps, rows))
        rows, part = rows[order], part[order]
        first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(part) != 0))) if len(rows) else rows
        lengths = np.diff(np.append(first, len(rows)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.ids[rows[first]]), pa.array(part[first]), from_lists(ids[order], lengths, pa.int64()), from_lists(gaps[order], lengths, pa.float64())],
            names=["q_id", "segment", "nbr_ids", "ds"])

    return task


def _prepared(a, b, metric, a_id, b_id, a_x, b_x, rows_per_block):
    """Both sides in standard form, and the rows per block."""
    left = _side(a, a_id, a_x, metric)
    right = left if a is b and (a_id, a_x) == (b_id, b_x) else _side(b, b_id, b_x, metric)
    width = check_widths(left, right, metric)
    return left, right, rows_per_block or blocks.block_rows(width, metric)


def _join_within(left: DataFrame, right: DataFrame, r: float, metric: Metric, size: int, eps: float, cells: int | None, segment: int | None = None,
                 lists: bool = False) -> DataFrame:
    """Pairs ``(i, j, d)`` of two sides within ``r``, or ``lists``, each of one query and block: ``(q_id, segment, nbr_ids, ds)``."""
    n = right.count()
    rule = nests.Within(r, eps)
    model = blocks.make_cells(right, n, metric, size, 0, cells, left, rule)
    sketch = None if model.levels else _sketch(left, right, n, metric, size, _open_within(r))
    if sketch:
        found = _sketched_pairs(left, right, n, metric, sketch, r, False, size)
        one = F.expr(f"(j - pmod(j, {segment}L)) div {segment}L") if segment else F.lit(0).cast("long")
        return found.select(F.col("i").alias("q_id"), one.alias("segment"), F.array("j").alias("nbr_ids"), F.array("d").alias("ds")) if lists else found
    task, schema = ((_lists_task(metric, r, segment), "q_id long, segment long, nbr_ids array<long>, ds array<double>") if lists
                    else (_pairs_task(metric, r, False), "i long, j long, d double"))
    found, _ = blocks.block_join(left, right, metric, model, rule, task, schema, rows_per_block=size, n_queries=n if left is right else None)
    return found


def range_join(a: DataFrame, b: DataFrame, r: float, *, metric: str | Metric = "euclidean", eps: float = 0.0,
               a_id: str = "point_id", b_id: str = "point_id", a_x: str = "x", b_x: str = "x",
               cells: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Pairs across two tables at distance ``<= r``: ``(i, j, d)``.

    With ``eps`` cells whose nearest possible row is beyond ``r / (1 + eps)`` are skipped, and
    cells that lie within ``r * (1 + eps)`` are taken as a whole.
    """
    metric = named(metric)
    left, right, size = _prepared(a, b, metric, a_id, b_id, a_x, b_x, rows_per_block)
    return _join_within(left, right, r, metric, size, eps, cells)


def close_pairs(a: DataFrame, r: float, *, metric: str | Metric = "euclidean", eps: float = 0.0,
                id_col: str = "point_id", x_col: str = "x", cells: int | None = None,
                rows_per_block: int | None = None) -> DataFrame:
    """Pairs within one table, ``i < j``, at distance ``<= r``: ``(i, j, d)``; each pair is met once."""
    metric = named(metric)
    rows, _, size = _prepared(a, a, metric, id_col, id_col, x_col, x_col, rows_per_block)
    n = rows.count()
    rule = nests.Within(r, eps)
    model = blocks.make_cells(rows, n, metric, size, 0, cells, rows, rule)
    sketch = None if model.levels else _sketch(rows, rows, n, metric, size, _open_within(r))
    if sketch:
        return _sketched_pairs(rows, rows, n, metric, sketch, r, True, size)
    found, _ = blocks.block_join(rows, rows, metric, model, rule,
                                 _pairs_task(metric, r, True), "i long, j long, d double",
                                 rows_per_block=size, n_queries=n, self_join=True)
    return found


def sparse_distances(a: DataFrame, b: DataFrame, max_distance: float, **options) -> DataFrame:
    """Sparse matrix of distances up to ``max_distance`` as ``(i, j, d)``; zero distances are kept."""
    return range_join(a, b, max_distance, **options)


def ball_search(queries: DataFrame, data: DataFrame, r: float, *, metric: str | Metric = "euclidean",
                eps: float = 0.0, query_id: str = "point_id", data_id: str = "point_id", query_x: str = "x",
                data_x: str = "x", segment: int = SEGMENT, cells: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Neighbours within ``r`` as lists, nearest first: ``(q_id, segment, nbr_ids, ds)``.

    A list covers the neighbours whose id divided by ``segment``, rounded down, is the number in column ``segment``,
    so none is longer than that, and what a row holds depends on ids alone. Queries without neighbours keep one row
    with empty lists and no segment.
    """
    metric = named(metric)
    left, right, size = _prepared(queries, data, metric, query_id, data_id, query_x, data_x, rows_per_block)
    pieces = _join_within(left, right, r, metric, size, eps, cells, segment, lists=True)
    # One shuffle serves the merged lists and the join with the queries; pieces are in order, so merging them is quick.
    found = pieces.repartition("q_id").groupBy("q_id", "segment").agg(
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("ds").alias("d"), F.col("nbr_ids").alias("j"))))).alias("e")).select(
        "q_id", "segment", F.col("e.j").alias("nbr_ids"), F.col("e.d").alias("ds"))
    nothing = F.array().cast("array<long>"), F.array().cast("array<double>")
    return queries.select(F.col(query_id).cast("long").alias("q_id")).join(found, "q_id", "left").select(
        "q_id", "segment", F.coalesce("nbr_ids", nothing[0]).alias("nbr_ids"), F.coalesce("ds", nothing[1]).alias("ds"))


def neighbours_within(queries: DataFrame, data: DataFrame, distance_upper_bound: float, *, ranked: bool = False, **options) -> DataFrame:
    """All neighbours up to a bound (the open-ended form of a nearest-neighbour query), as ``ball_search`` lists.

    With ``ranked`` they are rows ``(q_id, rank, nbr_id, d)``, as ``knn_join`` gives them.
    """
    if not ranked:
        return ball_search(queries, data, distance_upper_bound, **options)
    return _ranked_within(queries, data, distance_upper_bound, **options)


def _ranked_within(queries: DataFrame, data: DataFrame, r: float, *, metric: str | Metric = "euclidean", eps: float = 0.0,
                   query_id: str = "point_id", data_id: str = "point_id", query_x: str = "x", data_x: str = "x",
                   cells: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Neighbours travel as lists of one block each, which are opened where they are ranked; a query's rows are sorted by Spark."""
    metric = named(metric)
    left, right, size = _prepared(queries, data, metric, query_id, data_id, query_x, data_x, rows_per_block)
    pieces = _join_within(left, right, r, metric, size, eps, cells, lists=True).repartition("q_id")
    rows = pieces.select("q_id", F.explode(F.arrays_zip("nbr_ids", "ds")).alias("e")).select("q_id", F.col("e.nbr_ids").alias("nbr_id"), F.col("e.ds").alias("d"))
    order = Window.partitionBy("q_id").orderBy("d", "nbr_id")
    return rows.select("q_id", F.row_number().over(order).alias("rank"), "nbr_id", "d")


def _count_task(metric: Metric, radii: np.ndarray, self_join: bool):
    def task(q: Side, x: Side) -> Iterator[pa.RecordBatch]:
        d, slack = metric.block(q.points, x.points)
        qw, xw = to_numpy(q.columns["w"]), to_numpy(x.columns["w"]).astype(float)
        # In one table a pair of cells, or of blocks of a cell, is met once and counts for both orders.
        times = np.where(q.same, 1, 2) if self_join else 1
        sums = []
        for t, r in enumerate(radii):
            open_rows = (q.lo <= t) & (t < q.hi)
            sure = d <= r - slack
            if slack:
                rows, cols = np.nonzero((d <= r + slack) & ~sure)
                sure[rows, cols] = nests.exact(metric, q.points, x.points, rows, cols) <= r
            sums.append(int((qw * open_rows * times) @ (sure @ xw).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(radii)), pa.int32()), pa.array(sums, pa.int64())],
                                         names=["t", "n"])

    return task


def _weighted(side: DataFrame, metric: Metric, rows: int) -> DataFrame:
    """Points that occur very often as one row with a weight; of texts, whose distances are dear, all equal ones.

    Otherwise only hashes of the points are shuffled.
    """
    merge = lambda df: df.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "x", "w")
    if metric.textual:
        return storage.materialize(merge(side))
    hashes = _crowded(side, rows) if rows >= COPIES else []
    if not hashes:
        return side.select("id", "x", F.lit(1).cast("long").alias("w"))
    crowded = F.xxhash64("x").isin(hashes)
    return side.where(~crowded).select("id", "x", F.lit(1).cast("long").alias("w")).unionByName(merge(side.where(crowded)))


def _count_cells(side: DataFrame, n: int, metric: Metric, size: int, cells: int | None) -> nests.Cells:
    """Cells of one side of a count; a single one for a small table unless asked otherwise."""
    if n == 0 or (cells is None and n <= min(size, blocks.PIVOT_ROWS)) or (cells is not None and cells <= 1):
        return nests.Cells.one(n)
    count = min(cells, nests.MAX_DUAL_CELLS) if cells else blocks.cell_count(n, size, nests.MAX_DUAL_CELLS)
    return nests.measured(side, metric, nests.Cells.nested(metric, blocks.pick_pivots(side, count, metric)))


def count_pairs(a: DataFrame, b: DataFrame, radii: float | Sequence[float], *,
                metric: str | Metric = "euclidean", a_id: str = "point_id", b_id: str = "point_id",
                a_x: str = "x", b_x: str = "x", cells: int | None = None,
                rows_per_block: int | None = None) -> DataFrame:
    """Number of pairs at distance ``<= r`` for every radius, in one pass: ``(radius, n_pairs)``.

    Both tables have nested cells. Pairs of cells that lie within or beyond a radius as a whole are settled by their sizes;
    rows of the others are held against single leaves, and only those still open are joined. A table
    with itself meets every pair of cells once. Points that occur very often are counted once with a weight. Strings within at most
    ``MAX_EDITS`` edits are counted through the index of segments instead, unless cells are asked for.
    """
    if np.ndim(radii) > 1:
        raise ValueError("radii must be one value or a one-dimensional list of values")
    metric = named(metric)
    asked = [float(r) for r in np.atleast_1d(radii)]
    if metric.name == "levenshtein" and cells is None and rows_per_block is None and 0 <= max(asked, default=-1) <= MAX_EDITS:
        return edit_joins.edit_pair_counts(a, b, asked, a_id=a_id, b_id=b_id, a_x=a_x, b_x=b_x)
    ordered = np.array(sorted(set(asked)))
    left, right, size = _prepared(a, b, metric, a_id, b_id, a_x, b_x, rows_per_block)
    same, task = left is right, "t int, n long"
    n = right.count()
    n_left = n if same else left.count()
    right = _weighted(right, metric, n)
    left = right if same else _weighted(left, metric, n_left)
    settled = [0] * len(ordered)
    model = _count_cells(right, n, metric, size, cells)
    others = model if same or not model.levels else _count_cells(left, n_left, metric, size, cells or blocks.cell_count(n, size, nests.MAX_DUAL_CELLS))
    run = _count_task(metric, ordered, same)
    if model.levels and others.levels:
        settled, open_pairs = nests.cell_pairs(metric, others, model, ordered)
        routed = blocks.route_pairs(left, metric, others, model, open_pairs, ordered)
        found, _ = blocks.block_join(left, right, metric, model, None, run, task, rows_per_block=size, routed=routed, self_join=same)
        found = found.unionByName(_inside_counts(left, metric, others, model, open_pairs, ordered))
    else:
        one = model if not model.levels else nests.Cells.one(n)
        found, _ = blocks.block_join(left, right, metric, one, None, run, task, rows_per_block=size, n_queries=n if same else None, self_join=same)
    spark = a.sparkSession
    summed = found.groupBy("t").agg(F.sum("n").alias("n"))
    keys = spark.createDataFrame([(t := int(np.searchsorted(ordered, r)), r, settled[t]) for r in asked], "t int, radius double, settled long")
    return keys.join(F.broadcast(summed), "t", "left").select(
        "radius", (F.col("settled") + F.coalesce("n", F.lit(0))).cast("long").alias("n_pairs"))


def _inside_counts(left: DataFrame, metric: Metric, others: nests.Cells, model: nests.Cells, open_pairs: nests.CellPairs, radii: np.ndarray) -> DataFrame:
    """Pairs settled by a row against a leaf of the other side: all rows of leaves that lie inside the radius."""
    shipped = storage.checked_broadcast(left.sparkSession, (others, model, open_pairs), open_pairs.n_bytes, "the open pairs of cells")

    def task(it: Iterator[pa.RecordBatch]):
        sums = [0] * len(radii)
        for batch in it:
            if batch.num_rows == 0:
                continue
            mine, its, pairs = shipped.value
            home, (row, b, _, hi, was) = blocks.settle_rows(metric, nests.decode(batch.column("x"), metric), mine, its, pairs, radii)
            w = to_numpy(batch.column("w"))[row] * its.levels[-1].weight[b] * (np.where(home[row] != b, 2, 1) if mine is its else 1)
            for t in range(len(radii)):
                sums[t] += int(w[(hi <= t) & (t < was)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(radii)), pa.int32()), pa.array(sums, pa.int64())],
                                         names=["t", "n"])

    return left.select("x", "w").mapInArrow(task, "t int, n long")


def distance_matrix(a: DataFrame, b: DataFrame, *, metric: str | Metric = "euclidean", a_id: str = "point_id",
                    b_id: str = "point_id", a_x: str = "x", b_x: str = "x", segment: int = SEGMENT,
                    rows_per_block: int | None = None) -> DataFrame:
    """All distances between two tables, one row per point of ``a`` and segment of ``b``: ``(i, segment, js, ds)``.

    Segments are cut by ``id // segment``, as in ``ball_search``; ``js`` is ascending. Use ``matrix_entries`` for one row per pair.
    """
    metric = named(metric)
    left, right, size = _prepared(a, b, metric, a_id, b_id, a_x, b_x, rows_per_block)

    def task(q: Side, x: Side) -> Iterator[pa.RecordBatch]:
        order = np.argsort(x.ids, kind="stable")
        d, slack = metric.block(q.points, x.points[order])
        if slack:
            rows, cols = np.indices(d.shape).reshape(2, -1)
            d = nests.exact(metric, q.points, x.points[order], rows, cols).reshape(d.shape)
        ids = x.ids[order]
        edges = [0, *(np.flatnonzero(np.diff(ids // segment)) + 1), len(ids)]
        for s, e in zip(edges, edges[1:]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.ids), pa.array(np.full(len(q.ids), ids[s] // segment)),
                 from_lists(np.tile(ids[s:e], len(q.ids)), np.full(len(q.ids), e - s), pa.int64()),
                 from_matrix(np.ascontiguousarray(d[:, s:e]))], names=["i", "segment", "js", "ds"])

    found, several = blocks.block_join(left, right, metric, nests.Cells.one(right.count()), None,
                                       task, "i long, segment long, js array<long>, ds array<double>", rows_per_block=size)
    if not several:
        return found
    # A segment may lie in several blocks.
    merged = found.groupBy("i", "segment").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("js", "ds")))).alias("e"))
    return merged.select("i", "segment", F.col("e.js").alias("js"), F.col("e.ds").alias("ds"))


def matrix_entries(rows: DataFrame) -> DataFrame:
    """A ``distance_matrix`` as ``(i, j, d)``."""
    return rows.select("i", F.explode(F.arrays_zip("js", "ds")).alias("e")).select("i", "e.js", "e.ds").toDF("i", "j", "d")


def metric_partitions(data: DataFrame, pivots: DataFrame, *, metric: str | Metric = "euclidean",
                      id_col: str = "point_id", x_col: str = "x", max_pivots: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Cells around given pivots: ``(point_id, pivot_id, d)`` and ``(pivot_id, n, radius)``.

    A point belongs to its nearest pivot (tie: smaller pivot id). Pivots are model-sized, at most ``max_pivots``; many of them
    are nested, so that a point is compared with few.
    """
    metric = named(metric)
    chosen = _side(pivots, id_col, x_col, metric).orderBy("id").limit(max_pivots + 1).collect()
    if len(chosen) > max_pivots:
        raise ValueError(f"more than {max_pivots} pivots; use fewer, larger cells or a higher max_pivots")
    # Of equal pivots only the first can have members.
    known = sorted({tuple(np.atleast_1d(r.x)): r for r in reversed(chosen)}.values(), key=lambda r: r.id)
    ids = np.array([r.id for r in known])
    centers = np.array([r.x for r in known], dtype=object if metric.textual else float)
    size = sum(map(len, centers)) if metric.textual else centers.nbytes
    nest = nests.nest_of(metric, centers) if len(known) > nests.FAN else None
    shipped = storage.checked_broadcast(data.sparkSession, (ids, centers, nest), 3 * size, "the pivots")
    rows = _side(data, id_col, x_col, metric)

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                cell, d = nearest_pivots(metric, nests.decode(batch.column("x"), metric), *shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell), pa.array(d)],
                                                 names=["point_id", "pivot_id", "d"])

    members = rows.mapInArrow(task, "point_id long, pivot_id long, d double")
    summary = members.groupBy("pivot_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    return members, summary


def nearest_pivots(metric: Metric, points: np.ndarray, ids: np.ndarray, centers: np.ndarray, nest: nests.Cells | None) -> tuple[np.ndarray, np.ndarray]:
    """The id of the nearest pivot (ties: smaller id) of each point and its exact distance; ``ids`` ascend."""
    if nest is None:
        cell, d = nests.assign(metric, points, centers)
        return ids[cell], d
    pairs, _, _ = nests.Nearest(1).walk(nest, metric, points)
    leaves = nest.levels[-1]
    gaps = nests.exact(metric, points, leaves.pivots, pairs.row, pairs.cell)
    order = np.lexsort((leaves.order[pairs.cell], gaps, pairs.row))
    first = order[np.searchsorted(pairs.row[order], np.arange(len(points)))]
    return ids[leaves.order[pairs.cell[first]]], gaps[first]


def check_metric_partitions(data: DataFrame, members: DataFrame, summary: DataFrame, *,
                            id_col: str = "point_id") -> DataFrame:
    """Violation counts, all zero for sound cells: rows not covered, and rows not in exactly one cell."""
    uncovered = members.join(F.broadcast(summary), "pivot_id", "left").agg(
        F.count(F.when(F.col("radius").isNull() | (F.col("d") > F.col("radius")), 1)).alias("violations"))
    homes = data.select(F.col(id_col).cast("long").alias("point_id"), F.lit(1).alias("given"), F.lit(0).alias("placed")) \
        .unionByName(members.select("point_id", F.lit(0).alias("given"), F.lit(1).alias("placed"))) \
        .groupBy("point_id").agg(F.sum("given").alias("given"), F.sum("placed").alias("placed")) \
        .agg(F.count(F.when((F.col("given") != 1) | (F.col("placed") != 1), 1)).alias("violations"))
    return uncovered.select(F.lit("radius_covers").alias("rule"), "violations").unionByName(
        homes.select(F.lit("exactly_one_cell").alias("rule"), "violations"))
