"""Grouped operators: top k, sessions, frames by groups, distinct counts of hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the planner limits each task's groups before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: list[str], time: str, seconds: int, name: str = "session") -> DataFrame:
    """Numbers the sessions of each group: a new one begins after a gap of more than `seconds`."""
    w = W.partitionBy(*by).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    begins = F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_begins")


def groups_frame(df: DataFrame, by: list[str], order: str, before: int, after: int, value: Column, name: str) -> DataFrame:
    """An aggregate over a frame of peer groups (GROUPS BETWEEN): dense ranks give the frame by range."""
    ranked = df.withColumn("_peers", F.dense_rank().over(W.partitionBy(*by).orderBy(order)))
    return ranked.withColumn(name, value.over(W.partitionBy(*by).orderBy("_peers").rangeBetween(-before, after))).drop("_peers")


def spread_count_distinct(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct counts where one group may hold most rows: values are made distinct by (group, value) first."""
    return df.select(*by, value).where(F.col(value).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias(name))
