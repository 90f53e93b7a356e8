"""Rounds of local training on a fixed number of row groups.

Rows are hashed by key to a fixed number of workers and ordered by hash within each, so a run does
not depend on how the input was split. That layout is stored once in the checkpoint folder and read
again every round. Workers start each round from the same broadcast parameters; their results are
added up in the JVM, weighted by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyscale.plans import storage
from manyscale.plans.partials import SCHEMA, collect_sums, merge_partials, partial_rows


#: Rows that a worker trains on unless the number of workers is given.
ROWS_PER_WORKER = 1 << 16


def worker_count(df: DataFrame) -> int:
    """Workers for a table: its rows alone decide, so a model is the same on every cluster."""
    return max(1, -(-df.count() // ROWS_PER_WORKER))


def laid_out(df: DataFrame, key: str, workers: int, seed: int, by_key: bool = False) -> DataFrame:
    """The rows on their workers, in the order of training: of the key's hash, or of the key itself if there is one worker."""
    if by_key and workers > 1:
        raise ValueError("rows in the order of their key need one worker")
    order = F.lit(0) if by_key else F.xxhash64(F.col(key), F.lit(seed))
    return storage.materialize(df.withColumn("_order", order).repartition(workers, "_order")
                               .sortWithinPartitions("_order", key).drop("_order"))


def train_round(rows: DataFrame, parameters, n_bytes: int,
                train: Callable[[Iterator[pa.RecordBatch], object], tuple[int, list[np.ndarray]] | None]) -> tuple[int, list[np.ndarray]]:
    """One pass of all workers. ``train(batches, parameters)`` returns rows seen and summed arrays,
    or nothing if it saw no rows. The arrays come back added up over workers."""
    shipped = storage.checked_broadcast(rows.sparkSession, parameters, n_bytes, "the trained parameters")

    def task(it: Iterator[pa.RecordBatch]):
        found = train((b for b in it if b.num_rows), shipped.value)
        if found is not None:
            n, sums = found
            yield from partial_rows({(0, p): [n, s] for p, s in enumerate(sums)})

    sums = collect_sums(merge_partials(rows.mapInArrow(task, SCHEMA)))
    shipped.unpersist()
    if not sums:
        raise ValueError("no rows to train on")
    return sums[0, 0][0], [sums[0, p][1] for p in range(len(sums))]
