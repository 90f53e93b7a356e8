"""Fitted trees on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.operators.tree import CellTree


def save_model(spark: SparkSession, tree: CellTree, path: str, reps: DataFrame | None = None) -> None:
    """Cells, and representations if given, as Parquet split by level."""
    tree.nodes(spark).write.partitionBy("level").parquet(f"{path}/nodes")
    if reps is not None:
        reps.write.partitionBy("level").parquet(f"{path}/reps")


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def load_model(spark: SparkSession, path: str) -> CellTree:
    return CellTree.from_nodes(load_nodes(spark, path))


def load_representations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/reps").select("point_id", "level", "node_id", "z")


def export_model_text(nodes: DataFrame, path: str, reps: DataFrame | None = None) -> None:
    """Text files per part and node: one folder per node id, a header line, values separated by blanks."""

    def words(col):
        return F.array_join(F.transform(col, lambda v: v.cast("string")), " ")

    def write(df: DataFrame, part: str) -> None:
        df.select("node_id", "values").write.partitionBy("node_id").option("header", True).csv(f"{path}/{part}")

    write(nodes.select("node_id", words(F.col("center")).alias("values")), "centers")
    write(nodes.select("node_id", F.explode("basis").alias("b")).select("node_id", words(F.col("b")).alias("values")), "bases")
    if reps is not None:
        write(reps.select("node_id", F.concat_ws(" ", F.col("point_id").cast("string"), words(F.col("z"))).alias("values")), "representations")
