"""Sessions, table readers and the package's delivery to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors through Spark, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "millrace.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("millrace", os.path.relpath(path, root)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only the columns and row groups that a query needs are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
