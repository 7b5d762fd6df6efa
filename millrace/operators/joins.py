"""Joins by time and range, and joins of skewed keys, without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The largest side that is broadcast, by the optimizer's own size estimate.
BROADCAST_BYTES = 64 << 20

#: Rows of both sides that a task of a salted join sorts, on average.
TASK_ROWS = 1 << 20


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df's estimated size is at most so many bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its estimated size is small enough; otherwise left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, most) else df


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the `columns` of the last right row of its keys that isn't later.

    One shuffle: both sides are put together by key and time, and the last right row so far is carried on. Of
    right rows with equal times the one with the greatest columns counts. Right columns must not clash with left ones.
    """
    a = left.select(*(F.col(c) for c in on), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(_struct(right, [right_time, *columns])).alias("_right"))
    b = right.select(*(F.col(c) for c in on), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_left"), F.struct(right_time, *columns).alias("_right"))
    order = W.partitionBy(*on).orderBy("_time", "_side", "_right").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(order))
    return carried.where("_side = 1").select("_left.*", *(F.col(f"_last.{c}").alias(c) for c in columns))


def _struct(df: DataFrame, names: list[str]):
    from pyspark.sql.types import StructType

    return StructType([df.schema[n] for n in names])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with low <= point <= high, as an equi-join on buckets of `width`; each range goes to all that it touches.

    The width should be about the usual length of a range: then a range is copied about twice.
    """
    bucket = lambda c: F.floor(c.cast("double") / F.lit(float(width)))
    p = points.withColumn("_bucket", bucket(F.col(point)))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return p.join(r, [*(on or []), "_bucket"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_bucket")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join (inner or left) for keys that hold much of the large side: each key is spread over `salts` tasks.

    Both sides are counted, which for plain tables reads only the files' footers. Where spark.sql.shuffle.partitions would
    give tasks of more than TASK_ROWS rows, there are as many tasks as the rows need, so their memory doesn't grow with the input.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join keeps whole results only as inner or left")
    a = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    tasks = -(-(large.count() + salts * small.count()) // TASK_ROWS)
    if tasks > int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = (x.repartition(tasks, *on, "_salt") for x in (a, b))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, on: list[str]) -> DataFrame:
    """Pairs of equal keys whose times differ by at most `seconds`: buckets of that length, and their neighbours."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    a = left.withColumn("_bucket", bucket(left_time))
    b = right.withColumn("_bucket", F.explode(F.array(*(bucket(right_time) + d for d in (-1, 0, 1)))))
    apart = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*on, "_bucket"]).where(apart <= seconds * 1_000_000).drop("_bucket")
