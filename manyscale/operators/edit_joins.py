"""Joins of strings by edit distance over an index of segments, with built-in functions only.

Two strings within ``r`` edits share one of the ``r + 1`` segments into which the shorter one is cut, at nearly the same place:
an edit can spoil one segment only. Each string emits its segments as hashed keys, and, for every length that a shorter
partner can have, the pieces of its own that could be such a segment. Strings that share a key are candidates, whose distance is
worked out. Equal strings count as one; membership tells which rows they stand for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.plans import storage


def representatives(df: DataFrame, id_col: str = "point_id", x_col: str = "x") -> DataFrame:
    """``(id, x, copies)``: each distinct string with its smallest id and number of rows; null strings have none."""
    rows = df.where(F.col(x_col).isNotNull()).groupBy(F.col(x_col).cast("string").alias("x"))
    return rows.agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "x", "copies")


def membership(df: DataFrame, distinct: DataFrame, id_col: str = "point_id", x_col: str = "x") -> DataFrame:
    """``(id, representative)`` of every row with a string."""
    rows = df.where(F.col(x_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(x_col).cast("string").alias("x"))
    return rows.join(distinct.select(F.col("id").alias("representative"), "x"), "x").select("id", "representative")


def _segment(r: int, n: str, i: str) -> tuple[str, str]:
    """First place (from 0) and size of segment ``i`` of a string of ``n`` letters; the last ones are longer if ``n`` does not divide."""
    short = f"({r + 1} - {n} % {r + 1})"
    return f"({i} * ({n} div {r + 1}) + greatest(0, {i} - {short}))", f"({n} div {r + 1} + CASE WHEN {i} >= {short} THEN 1 ELSE 0 END)"


def segment_keys(r: int, x: str = "x") -> Column:
    """Hashes of the ``r + 1`` segments with the string's length and the segment's number."""
    n = f"length({x})"
    start, size = _segment(r, n, "i")
    return F.expr(f"transform(sequence(0, {r}), i -> xxhash64({n}, i, substring({x}, CAST({start} AS INT) + 1, CAST({size} AS INT))))")


def piece_keys(r: int, x: str = "x") -> Column:
    """Hashes of the pieces that may equal a segment of a partner of the same length or up to ``r`` letters shorter.

    Edits before a segment move it by at most its number, edits behind it by at most the number of segments that
    follow, seen from the end; a piece has to be possible from both sides.
    """
    n, gap = f"length({x})", f"(length({x}) - m)"
    start, size = _segment(r, "m", "i")
    low = f"greatest({start} - i, {start} + {gap} - ({r} - i), 0)"
    high = f"least({start} + i, {start} + {gap} + ({r} - i), {n} - {size})"
    places = f"CASE WHEN {low} <= {high} THEN sequence(CAST({low} AS INT), CAST({high} AS INT)) ELSE array() END"
    pieces = f"transform({places}, p -> xxhash64(m, i, substring({x}, p + 1, CAST({size} AS INT))))"
    lengths = f"sequence(greatest(0, {n} - {r}), {n})"
    return F.expr(f"array_distinct(flatten(flatten(transform({lengths}, m -> transform(sequence(0, {r}), i -> {pieces})))))")


def distinct_pairs(shorter: DataFrame, longer: DataFrame, r: int) -> DataFrame:
    """``(a, b, d)``: ids of strings of ``shorter(id, x)`` and of ``longer(id, x)``, not shorter than the first, within ``r`` edits."""
    one = shorter.select(F.col("id").alias("a"), F.col("x").alias("s"), F.explode(segment_keys(r)).alias("key"))
    two = longer.select(F.col("id").alias("b"), F.col("x").alias("t"), F.explode(piece_keys(r)).alias("key"))
    met = one.join(two, "key").where("length(t) BETWEEN length(s) AND length(s) + " + str(r)).withColumn("d", F.levenshtein("s", "t", r))
    return met.where("d >= 0").select("a", "b", F.col("d").cast("double").alias("d")).distinct()


def edit_close_pairs(df: DataFrame, r: int, *, id_col: str = "point_id", x_col: str = "x") -> tuple[DataFrame, DataFrame]:
    """Pairs ``(i, j, d)`` of distinct strings within ``r`` edits, by their smallest ids, and ``(id, representative)`` of every row."""
    if int(r) != r or r < 0:
        raise ValueError(f"the number of edits must be a whole number, not {r!r}")
    known = storage.materialize(representatives(df, id_col, x_col))
    found = distinct_pairs(known.select("id", "x"), known.select("id", "x"), int(r)).where("a <> b")
    pairs = found.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "d").distinct()
    return pairs, membership(df, known, id_col, x_col)


def _both_ways(left: DataFrame, right: DataFrame, r: int) -> DataFrame:
    """``(i, j, d)`` of distinct strings ``left(id, x)`` and ``right(id, x)`` within ``r`` edits, whichever is shorter."""
    up = distinct_pairs(left.select("id", "x"), right.select("id", "x"), r).select(F.col("a").alias("i"), F.col("b").alias("j"), "d")
    down = distinct_pairs(right.select("id", "x"), left.select("id", "x"), r).select(F.col("b").alias("i"), F.col("a").alias("j"), "d")
    return up.union(down).distinct()


def edit_range_join(a: DataFrame, b: DataFrame, r: int, *, a_id: str = "point_id", b_id: str = "point_id", a_x: str = "x",
                    b_x: str = "x") -> DataFrame:
    """Pairs ``(i, j, d)`` of distinct strings of two tables within ``r`` edits, by their smallest ids in each table."""
    if int(r) != r or r < 0:
        raise ValueError(f"the number of edits must be a whole number, not {r!r}")
    left, right = (storage.materialize(representatives(*side)) for side in ((a, a_id, a_x), (b, b_id, b_x)))
    return _both_ways(left, right, int(r))


def edit_pair_counts(a: DataFrame, b: DataFrame, radii: Sequence[float], *, a_id: str = "point_id", b_id: str = "point_id", a_x: str = "x",
                     b_x: str = "x") -> DataFrame:
    """``(radius, n_pairs)``: pairs of rows of two tables (or of one with itself, both orders) within each number of edits; equal strings weigh as one."""
    left = storage.materialize(representatives(a, a_id, a_x))
    right = left if a is b and (a_id, a_x) == (b_id, b_x) else storage.materialize(representatives(b, b_id, b_x))
    found = _both_ways(left, right, max(0, int(max(radii))))
    one, two = left.select(F.col("id").alias("i"), F.col("copies").alias("w")), right.select(F.col("id").alias("j"), F.col("copies").alias("v"))
    weighed = found.join(one, "i").join(two, "j")
    sums = weighed.agg(*(F.sum(F.when(F.col("d") <= r, F.col("w") * F.col("v"))).alias(f"n{at}") for at, r in enumerate(radii)))
    each = [F.struct(F.lit(float(r)).alias("radius"), F.coalesce(f"n{at}", F.lit(0)).cast("long").alias("n_pairs")) for at, r in enumerate(radii)]
    return sums.select(F.explode(F.array(*each)).alias("e")).select("e.*")
