"""Key-wise sums of numpy partials.

A task adds up its own rows with numpy and hands on one row per key; the JVM merges those
rows one at a time, with a map-side combine, so no group is ever held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyscale.functions.batches import from_lists

SEGMENT = 65_536
FLUSH_VALUES = 16_000_000
SCHEMA = "node_id long, part int, segment int, n long, s array<double>"


def sum_partials(df: DataFrame, columns: list[str], extract: Callable) -> DataFrame:
    """Sum ``extract``'s vectors over the whole table.

    ``extract(batch)`` yields ``(node_id, part, n, vector)`` for an Arrow batch of ``columns``.
    The result has the columns of ``SCHEMA``, one row per key and vector segment.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for node, part, n, vector in extract(batch):
                slot = held.get((node, part))
                if slot is None:
                    held[(node, part)] = [n, vector.copy()]
                    size += vector.size
                else:
                    slot[0] += n
                    slot[1] += vector
                if size > FLUSH_VALUES:
                    yield from partial_rows(held)
                    held, size = {}, 0
        if held:
            yield from partial_rows(held)

    return merge_partials(df.select(*columns).mapInArrow(task, SCHEMA))


def merge_partials(partial: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` with equal keys added up."""
    merged = partial.groupBy("node_id", "part", "segment").agg(
        F.sum("n").alias("n"),
        Summarizer.metrics("mean", "count").summary(array_to_vector("s")).alias("m"))
    return merged.select("node_id", "part", "segment", "n",
                         F.transform(vector_to_array("m.mean"), lambda v: v * F.col("m.count")).alias("s"))


def partial_rows(held: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
    """``{(node_id, part): [n, vector]}`` as batches of ``SCHEMA``, long vectors in segments."""
    for (node, part), (n, vector) in held.items():
        flat = np.asarray(vector, dtype=float).ravel()
        starts = list(range(0, flat.size, SEGMENT)) or [0]
        lengths = np.array([min(SEGMENT, flat.size - s) for s in starts])
        k = len(starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([node] * k, pa.int64()), pa.array([part] * k, pa.int32()),
             pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()),
             from_lists(flat, lengths, pa.float64())],
            names=["node_id", "part", "segment", "n", "s"])


def collect_sums(merged: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """Model-sized sums on the driver: ``(node_id, part) -> (n, vector)``."""
    parts: dict[tuple[int, int], dict[int, tuple[int, list]]] = {}
    for row in merged.collect():
        parts.setdefault((row.node_id, row.part), {})[row.segment] = (row.n, row.s)
    return {key: (segs[0][0], np.concatenate([np.asarray(segs[i][1]) for i in sorted(segs)]))
            for key, segs in parts.items()}
