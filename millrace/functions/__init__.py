"""Column functions that fill gaps between SQL dialects, all built from expressions that the planner compiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness_sample(c: Column) -> Column:
    """The sample skewness, corrected for bias; null for fewer than three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(c: Column) -> Column:
    """The sample excess kurtosis, corrected for bias; null for fewer than four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def day_of_week(c: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(c) - 1).cast("long")


def truncated(unit: str, c: Column) -> Column:
    """date_trunc that keeps a time stamp without zone."""
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def logarithm(c: Column, log: Callable[[Column], Column] = F.ln) -> Column:
    """ln or log10 as in floating point: minus infinity of 0 and NaN below it, where Spark's own give null."""
    return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(log(c))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as in floating point: c * 10**digits to the next whole number, halves away from zero, and back.

    Spark's own rounds the shortest decimal form of c, which is below a half where the product is one. What the product can't
    hold, infinities and NaN stay as they are.
    """
    scale = F.lit(10.0**digits)
    return F.when(F.abs(c) < 1e290, F.round(c * scale) / scale).otherwise(c)
