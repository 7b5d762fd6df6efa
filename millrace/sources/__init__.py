"""Files of other formats, partitioned folders and bucketed tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or a local one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later reads survive lost executors and repeat no work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(df: DataFrame, form: str, **options: str) -> DataFrame:
    """df written in a format and read again with its own schema: no inference, no second pass."""
    path = scratch(df.sparkSession)
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.format(form).options(**options).schema(df.schema).load(path)


def partitioned(df: DataFrame, by: str) -> DataFrame:
    """df written with a folder for each value of `by`: filters on it skip whole folders. Several tasks share a folder."""
    path = scratch(df.sparkSession)
    df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df as a table dealt into buckets by a key and sorted in them: joins and groups by that key need no shuffle."""
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", scratch(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)
