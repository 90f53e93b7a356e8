import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("manyscale-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Points from a numpy matrix: ``table(matrix)`` gives ``(point_id, x)``."""

    def make(matrix, start=0, partitions=2):
        rows = [(start + i, [float(v) for v in row]) for i, row in enumerate(matrix)]
        return spark.createDataFrame(rows, "point_id long, x array<double>").repartition(partitions)

    return make
