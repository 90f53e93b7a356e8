"""Distributed matrices: rows ``(i, x)``, entries ``(i, j, v)`` or square blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.functions import arrays
from manyscale.functions import batches as nb
from manyscale.plans import storage

BLOCK = 256
#: Entries of one inner index that meet in a task, and how many indices may be heavy on each side.
PART_ROWS, HEAVY = 4096, 10_000
SMALL_SIDE = 64 * 1024 * 1024
BLOCK_SCHEMA = "bi long, bj long, height int, width int, ids array<long>, v array<double>"


def shape(a: DataFrame) -> tuple[int, int]:
    """Rows and columns; ragged rows are an error."""
    r = a.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if r.low != r.high:
        raise ValueError(f"matrix rows have between {r.low} and {r.high} entries")
    return r.n, r.high or 0


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two matrices of the same shape, matched by row index; an index that only one of them has is an error."""
    if shape(a) != shape(b):
        raise ValueError(f"cannot add matrices of shape {shape(a)} and {shape(b)}")
    other = b.select("i", F.col("x").alias("_y"))
    alone = F.raise_error(F.concat(F.lit("only one matrix has row "), F.col("i").cast("string"))).cast("array<double>")
    total = F.when(F.col("x").isNull() | F.col("_y").isNull(), alone).otherwise(arrays.add(arrays.doubles("x"), arrays.doubles("_y")))
    return a.select("i", "x").join(other, "i", "full").select("i", total.alias("x"))


def matrix_scale(a: DataFrame, s: float) -> DataFrame:
    return a.select("i", arrays.scale(arrays.doubles("x"), s).alias("x"))


def to_entries(a: DataFrame) -> DataFrame:
    return a.select("i", F.posexplode("x").alias("j", "v"))


def transpose_entries(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_transpose(a: DataFrame, segment: int = 1024) -> DataFrame:
    """Rows of the transpose in bounded pieces: ``(i, segment, js, x)``.

    Row ``i`` holds column ``i`` of ``a``; ``js`` are the source rows, ``segment`` of them at most.
    A transposed row is as long as the table, so it is never put together in one place.
    """

    def turn(table: pa.Table) -> pa.Table:
        order = np.argsort(nb.to_numpy(table.column("i")))
        index, x = nb.to_numpy(table.column("i"))[order], nb.to_matrix(table.column("x"))[order]
        width = x.shape[1]
        return pa.table({
            "i": pa.array(range(width), pa.int32()), "segment": pa.array([int(index[0]) // segment] * width, pa.int64()),
            "js": nb.from_lists(np.tile(index, width), np.full(width, len(index)), pa.int64()),
            "x": nb.from_matrix(x.T)})

    keyed = a.select(F.col("i").cast("long").alias("i"), arrays.doubles("x").alias("x"),
                     F.floor(F.col("i") / segment).alias("segment"))
    return keyed.groupBy("segment").applyInArrow(turn, "i int, segment long, js array<long>, x array<double>")


def split_heavy(a: DataFrame, b: DataFrame, rows_per_part: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of a product keyed by ``(k, sa, sb)``, where inner indices with many entries are cut in two dimensions.

    The entries of a heavy index are dealt into parts by their row (``sa``) or column (``sb``), and every part of one side meets every part
    of the other, so that a key has about ``rows_per_part`` entries of each. On a large table the least number that counts as heavy
    is its share of the table, so the list of heavy indices, which is broadcast, has at most ``2 * HEAVY`` rows.
    """
    left, right = _factors(a, b)
    shares = _shares(left, right, rows_per_part) or [1 << 62, 1 << 62]
    one, two = (side.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias(name))
                for side, share, name in zip((left, right), shares, ("pa", "pb")))
    heavy = F.broadcast(one.join(two, "k").where("pa > 1 OR pb > 1"))

    def dealt(side: DataFrame, key: str, own: str, parts: str, other: str, others: str) -> DataFrame:
        met = side.join(heavy, "k", "left")
        mine = F.coalesce(F.pmod(F.xxhash64(key), F.col(parts)).cast("int"), F.lit(0)).alias(own)
        return met.select(*side.columns, mine, F.explode(F.coalesce(F.expr(f"sequence(0, {others} - 1)"), F.array(F.lit(0)))).alias(other))

    return dealt(left, "i", "sa", "pa", "sb", "pb"), dealt(right, "j", "sb", "pb", "sa", "pa")


def _factors(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("_a")), b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("_b")))


def _shares(left: DataFrame, right: DataFrame, rows_per_part: int) -> list[int]:
    """Entries of an index on either side from which it is heavy; none if no index is."""
    counts = [side.groupBy("k").count().agg(F.lit(at).alias("side"), F.sum("count").alias("n"), F.max("count").alias("most")) for at, side in enumerate((left, right))]
    found = sorted(counts[0].union(counts[1]).collect())
    shares = [max(rows_per_part, -(-(r.n or 0) // HEAVY)) for r in found]
    return shares if any((r.most or 0) > share for r, share in zip(found, shares)) else []


def multiply_entries(a: DataFrame, b: DataFrame, rows_per_part: int = PART_ROWS) -> DataFrame:
    """Sparse product of ``(i, j, v)`` tables. Inner indices that carry many entries are split; the sums combine before they shuffle."""
    left, right = _factors(a, b)
    keys = ["k"]
    if _shares(left, right, rows_per_part):
        left, right = split_heavy(a, b, rows_per_part)
        keys = ["k", "sa", "sb"]
    return left.join(right, keys).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def matrix_multiply(a: DataFrame, b: DataFrame, *, block: int = BLOCK, small_side: int = SMALL_SIDE) -> DataFrame:
    """Product of two row matrices as rows ``(i, x)``.

    A right side of at most ``small_side`` bytes is broadcast after its size has been checked;
    anything larger is multiplied block by block. Both ways give the row indices of ``a``, whatever they are;
    ``b`` is matched by index and must have the indices ``0 .. n - 1``.
    """
    (n, inner), (rows, width) = shape(a), shape(b)
    if inner != rows:
        raise ValueError(f"cannot multiply matrices of shape {(n, inner)} and {(rows, width)}")
    low, high = b.agg(F.min("i"), F.max("i")).first()
    if rows and (low, high) != (0, rows - 1):
        raise ValueError(f"the right matrix has {rows} rows with indices from {low} to {high}")
    if rows * width * 8 > small_side:
        product = multiply_blocks(to_blocks(a, block, block), to_blocks(b, block, block, dense=True), n // block + 1)
        return from_blocks(product)
    held = b.select("i", arrays.doubles("x").alias("x")).orderBy("i").collect()
    if [r.i for r in held] != list(range(rows)):
        raise ValueError("the right matrix has a row index twice")
    right = np.array([r.x for r in held])
    shipped = storage.checked_broadcast(a.sparkSession, right, right.nbytes, "the right matrix")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i"), nb.from_matrix(nb.to_matrix(batch.column("x")) @ shipped.value)], names=["i", "x"])

    return a.select(F.col("i").cast("long").alias("i"), arrays.doubles("x").alias("x")).mapInArrow(task, "i long, x array<double>")


def to_blocks(a: DataFrame, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK, *, dense: bool = False) -> DataFrame:
    """A row matrix as row-major blocks. Row indices may have gaps: ``ids`` says which rows a block holds.

    ``dense`` makes a gap or a repeated index inside a block an error.
    """

    def cut(table: pa.Table) -> pa.Table:
        order = np.argsort(nb.to_numpy(table.column("i")))
        x = nb.to_matrix(table.column("x"))[order]
        ids = nb.to_numpy(table.column("i"))[order]
        bi = int(ids[0]) // rows_per_block
        if dense and (np.diff(ids) != 1).any():
            raise ValueError(f"row indices between {ids[0]} and {ids[-1]} are missing or repeated")
        pieces = [x[:, s : s + cols_per_block] for s in range(0, x.shape[1], cols_per_block)]
        return pa.table({
            "bi": pa.array([bi] * len(pieces), pa.int64()), "bj": pa.array(range(len(pieces)), pa.int64()),
            "height": pa.array([len(x)] * len(pieces), pa.int32()),
            "width": pa.array([p.shape[1] for p in pieces], pa.int32()),
            "ids": pa.array([ids] * len(pieces), pa.list_(pa.int64())),
            "v": pa.array([p.ravel() for p in pieces], pa.list_(pa.float64()))})

    keyed = a.select(F.col("i").cast("long").alias("i"), arrays.doubles("x").alias("x"),
                     F.floor(F.col("i") / rows_per_block).alias("_bi"))
    return keyed.groupBy("_bi").applyInArrow(cut, BLOCK_SCHEMA)


def multiply_blocks(a: DataFrame, b: DataFrame, row_blocks: int) -> DataFrame:
    """Block product. Blocks meet on the inner index, which a tall matrix has few of, so the left
    side is spread over salts and the right side repeated for them. Tasks add up equal targets first."""
    salts = max(1, row_blocks // 64)
    left = a.select("bi", F.col("bj").alias("k"), F.pmod("bi", F.lit(salts)).alias("salt"), "height",
                    "ids", F.col("width").alias("inner"), F.col("v").alias("l"))
    right = b.select(F.col("bi").alias("k"), "bj", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                     "width", F.col("v").alias("r"))

    def task(it: Iterator[pa.RecordBatch]):
        held: dict[tuple, np.ndarray] = {}
        ids: dict[int, np.ndarray] = {}
        size = 0
        for batch in it:
            cols = {c: nb.to_numpy(batch.column(c)) for c in ("bi", "bj", "height", "inner", "width")}
            for t in range(batch.num_rows):
                h, k, w = (int(cols[c][t]) for c in ("height", "inner", "width"))
                product = nb.single(batch.column("l"))[t].values.to_numpy().reshape(h, k) @ \
                    nb.single(batch.column("r"))[t].values.to_numpy().reshape(k, w)
                key = (int(cols["bi"][t]), int(cols["bj"][t]))
                ids[key[0]] = nb.single(batch.column("ids"))[t].values
                if key in held:
                    held[key] += product
                else:
                    held[key] = product
                    size += product.size
            if size > 16_000_000:
                yield from emit(held, ids)
                held, ids, size = {}, {}, 0
        yield from emit(held, ids)

    def emit(held, ids):
        for (bi, bj), m in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([bi]), pa.array([bj]), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()),
                 nb.from_lists(ids[bi], np.array([len(ids[bi])]), pa.int64()), nb.from_matrix(m.reshape(1, -1))],
                names=["bi", "bj", "height", "width", "ids", "v"])

    products = left.join(right, ["k", "salt"]).select("bi", "bj", "height", "inner", "width", "ids", "l", "r").mapInArrow(task, BLOCK_SCHEMA)
    return products.groupBy("bi", "bj", "height", "width").agg(
        F.first("ids").alias("ids"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks back to rows ``(i, x)``; a row gathers one piece per column block."""
    start = F.col("r") * F.col("width") + 1
    rows = blocks.select("bi", "bj", "width", "v", F.posexplode("ids").alias("r", "i")).select(
        "bi", "r", "i", "bj", F.slice("v", start, F.col("width")).alias("p"))
    joined = rows.groupBy("bi", "r", "i").agg(F.sort_array(F.collect_list(F.struct("bj", "p"))).alias("ps"))
    return joined.select("i", F.flatten("ps.p").alias("x"))


def matrix_vector(a: DataFrame, v: Sequence[float]) -> DataFrame:
    """``(i, y)`` with ``y = x . v``."""
    n, width = shape(a)
    if width != len(v):
        raise ValueError(f"cannot multiply a matrix of shape {(n, width)} by a vector of length {len(v)}")
    return a.select("i", arrays.dot(arrays.doubles("x"), arrays.literal(v)).alias("y"))


def identity(spark: SparkSession, d: int) -> DataFrame:
    return spark.range(d).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def row_means(a: DataFrame) -> DataFrame:
    return a.select("i", (arrays.total(arrays.doubles("x")) / F.size("x")).alias("mean"))


def column_means(a: DataFrame) -> DataFrame:
    """One row ``x`` with the mean of every column, combined map-side in the JVM."""
    return a.agg(vector_to_array(Summarizer.mean(array_to_vector(arrays.doubles("x")))).alias("x"))


def subtract_vector(a: DataFrame, c: Sequence[float]) -> DataFrame:
    return a.select("i", arrays.subtract(arrays.doubles("x"), arrays.literal(c)).alias("x"))


def center_columns(a: DataFrame) -> DataFrame:
    """Each column less its mean."""
    means = column_means(a).first().x
    return subtract_vector(a, means) if means is not None else a


def matrix_size_kb(a: DataFrame, *keys: str) -> DataFrame:
    """Rows times row bytes, in KB, over the whole matrix or per key."""
    return a.groupBy(*keys).agg((F.sum(F.size("x").cast("long")) * 8 / 1024.0).alias("kb"))
