"""Structured Streaming over files: the events table as a stream, and a run to its end into a table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import scratch


def events(spark: SparkSession, sf_dir: str, late: str | None = None, path: str | None = None) -> DataFrame:
    """The events as a stream; times get a zone (UTC), as watermarks need; late: the watermark's delay.

    path: a folder to read in place of the table."""
    path = path or f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late) if late else stream


def finished(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, path: str | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Runs the stream over all that is there and returns what it wrote; nothing if `each` writes it.

    Append mode writes Parquet files, exactly once; the other modes keep the last version of their rows by
    overwriting (complete) or by adding each batch's changes (update), through foreachBatch, in a folder by the batch's
    number, so that a repeated batch overwrites itself. With the path and checkpoint of an earlier run it goes on from there.
    """
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark), checkpoint or scratch(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    elif mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}"))
    query = writer.start()
    query.awaitTermination()
    return None if each else spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
