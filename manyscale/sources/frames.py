"""Trajectory frames ``(traj_id, frame_no, coords ARRAY<ARRAY<DOUBLE>>)`` and label files."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BUCKETS = 20_000


def select_frames(frames: DataFrame, start: int = 0, stop: int | None = None, step: int = 1,
                  frame_no: str = "frame_no") -> DataFrame:
    """Frames ``start, start + step, ...`` below ``stop``; the range test reaches the Parquet scan."""
    if step < 1 or start < 0:
        raise ValueError("step must be at least 1 and start at least 0")
    rows = frames.where(F.col(frame_no) >= start)
    if stop is not None:
        rows = rows.where(F.col(frame_no) < stop)
    return rows if step == 1 else rows.where((F.col(frame_no) - start) % step == 0)


def read_frames(spark: SparkSession, path: str | Sequence[str], start: int = 0, stop: int | None = None,
                step: int = 1, frame_no: str = "frame_no") -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return select_frames(spark.read.parquet(*paths), start, stop, step, frame_no)


def union_trajectories(parts: Sequence[DataFrame]) -> DataFrame:
    """One table over several trajectories; each part gets its position as ``traj_id`` unless it has one."""
    tagged = [p if "traj_id" in p.columns else p.withColumn("traj_id", F.lit(t)) for t, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def downsample(df: DataFrame, step: int, index: str = "idx") -> DataFrame:
    if step < 1:
        raise ValueError("step must be at least 1")
    return df.where(F.col(index) % step == 0)


def flatten_frames(frames: DataFrame, coords: str = "coords", out: str = "x") -> DataFrame:
    return frames.withColumn(out, F.flatten(coords).cast("array<double>")).drop(coords)


def fold_frames(points: DataFrame, x_col: str = "x", out: str = "coords") -> DataFrame:
    """Flat vectors as lists of triples; a length that three does not divide is an error."""
    atoms = F.transform(F.sequence(F.lit(0), F.floor(F.size(x_col) / 3).cast("int") - 1), lambda a: F.slice(x_col, a * 3 + 1, 3))
    none = F.slice(F.array(F.col(x_col)), 1, 0)
    broken = F.raise_error(F.lit("a vector does not divide into triples")).cast("array<array<double>>")
    folded = F.when(F.size(x_col) == 0, none).when(F.size(x_col) % 3 == 0, atoms).when(F.col(x_col).isNotNull(), broken)
    return points.withColumn(out, folded).drop(x_col)


def explode_atoms(frames: DataFrame, coords: str = "coords") -> DataFrame:
    """One row per atom, with its position in the frame."""
    kept = [c for c in frames.columns if c != coords]
    return frames.select(*kept, F.posexplode(coords).alias("atom", "x"))


def select_atoms(frames: DataFrame, topology: DataFrame, kind: str, coords: str = "coords", max_atoms: int = 1_000_000) -> DataFrame:
    """Frames reduced to the atoms of one kind, in topology order.

    The topology is as long as one frame, so its index list is a constant of the plan and no
    frame is taken apart or shuffled.
    """
    chosen = [r.atom_id for r in topology.where(F.col("kind") == kind).select("atom_id").orderBy("atom_id").limit(max_atoms + 1).collect()]
    if len(chosen) > max_atoms:
        raise ValueError(f"more than {max_atoms} atoms in one frame")
    index = F.lit([int(a) for a in chosen]) if chosen else F.array().cast("array<int>")
    return frames.withColumn(coords, F.transform(index, lambda a: F.get(coords, a)))


def parse_labels(lines: DataFrame, column: int = 1, value: str = "value") -> DataFrame:
    """Whitespace-separated lines: the first field and the label field, as ``(first, label)``."""
    fields = F.split(F.trim(F.col(value)), r"\s+")
    return lines.where(F.trim(F.col(value)) != "").select(
        F.get(fields, F.lit(0)).alias("first"), F.get(fields, F.lit(column)).cast("double").alias("label"))


def read_labels(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    return parse_labels(spark.read.text(path), column)


def with_row_index(df: DataFrame, key: str, out: str = "idx", buckets: int | None = None, rows_per_bucket: int = 250_000) -> DataFrame:
    """A dense 0-based index in the order of a unique numeric key.

    Approximate quantiles cut the key range into buckets, bucket sizes give each bucket its first
    index, and rows are numbered within their bucket: no step orders the whole table in one place.
    Buckets follow the number of rows; a larger table than ``MAX_BUCKETS`` of them has larger buckets.
    """
    count = buckets or max(1, min(MAX_BUCKETS, math.ceil(df.count() / rows_per_bucket)))
    cuts = [i / count for i in range(1, count)] or [0.5]
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), cuts, F.lit(max(10_000, 20 * count))).alias("q")).first().q
    bounds = [float("-inf"), *sorted(set(found or [])), float("inf")]
    placed = Bucketizer(splits=bounds if len(bounds) > 2 else [float("-inf"), 0.0, float("inf")],
                        inputCol="_key", outputCol="_bucket").transform(df.withColumn("_key", F.col(key).cast("double")))
    sizes = {r["_bucket"]: r["count"] for r in placed.groupBy("_bucket").count().collect()}
    starts, total = [], 0
    for b in range(max(1, len(bounds) - 1) + 1):
        starts.append(total)
        total += sizes.get(float(b), 0)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    first = F.element_at(F.lit(starts), F.col("_bucket").cast("int") + 1)
    return placed.withColumn(out, (first + within - 1).cast("long")).drop("_key", "_bucket")
