"""Count-min sketches as a table of counters: built by one combined aggregate, joined to whatever is asked."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources import staged


def count_min(rows: DataFrame, column: str, error: float, confidence: float) -> Callable[[DataFrame, str, str], DataFrame]:
    """What adds to any frame an estimate of how often each of its values stands in `rows`.

    ceil(e / error) counters in ceil(ln(1 / (1 - confidence))) rows: an estimate is never too small, and by more than
    error times the number of rows too large with a probability of 1 - confidence at most. The counters are a table, so
    sketches of any size can be built and asked without a broadcast. Null is a value like any other.
    """
    if not (0 < error < 1 and 0 < confidence < 1):
        raise ValueError("error and confidence must be between 0 and 1")
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))
    cells = lambda c: F.array(*(F.pmod(F.xxhash64(F.col(c), F.lit(i)), F.lit(width)) + F.lit(i) * width for i in range(depth)))
    counters = staged(rows.groupBy(column).agg(F.count("*").alias("_n")).select(F.explode(cells(column)).alias("_cell"), "_n").groupBy("_cell").agg(F.sum("_n").alias("_n")))

    def estimate(asked: DataFrame, value: str, name: str) -> DataFrame:
        own = asked.select(value).distinct()
        each = own.select(value, F.explode(cells(value)).alias("_cell")).join(counters, "_cell", "left")
        least: Column = F.min(F.coalesce("_n", F.lit(0).cast("long")))
        found = each.groupBy(F.col(value).alias("_value")).agg(least.alias(name))
        return asked.join(found, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")

    return estimate
