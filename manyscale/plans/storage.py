"""Session-level helpers: where intermediates are kept, and how much may be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

BROADCAST_LIMIT = 512 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for stored intermediates, as the session names it.

    Only a local-mode session without a setting gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="manyscale-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, stored reliably in the checkpoint folder with the lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(spark: SparkSession, value, n_bytes: int, what: str):
    """Ship model arrays to the executors once their size is known to be small enough."""
    if n_bytes > BROADCAST_LIMIT:
        raise ValueError(f"{what} needs {n_bytes} bytes, more than the broadcast limit of {BROADCAST_LIMIT}")
    return spark.sparkContext.broadcast(value)
