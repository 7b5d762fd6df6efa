"""Operators over one order of all rows, or of very large groups, without one task that holds them: distributed scans.

Rows are dealt to tasks by ranges of the order (sampled splitters), each task works on its own range, and one row for each
range, what the range adds up to, is scanned on the driver and sent back. Rows that are alike in the order may lie in
several ranges, since a hash and a number of the row go on where the order ends; so neither a group nor a value that
holds most rows gathers in one task. Ranges are as many as shuffle partitions, or `parts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import staged

Order = list[str | tuple[str, bool]]  # names; with False: descending


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ordered(by: Order) -> tuple[list[str], list[Column]]:
    """The names, and the order of the columns _k0, _k1 and so on; nulls come first ascending and last descending."""
    pairs = [(b, True) if isinstance(b, str) else b for b in by]
    return [n for n, _ in pairs], [F.col(f"_k{i}").asc() if up else F.col(f"_k{i}").desc() for i, (_, up) in enumerate(pairs)]


def _dealt(df: DataFrame, names: list[str], order: list[Column], parts: int, more: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The rows as _row with their keys and `more`, and the number _part of their range; and the whole order of rows."""
    keyed = df.select(F.struct("*").alias("_row"), *(F.col(n).alias(f"_k{i}") for i, n in enumerate(names)), *more, F.xxhash64(*names, *df.columns).alias("_tie"), F.monotonically_increasing_id().alias("_id"))
    whole = [*order, F.col("_tie").asc(), F.col("_id").asc()]
    return keyed.repartitionByRange(parts, *whole).withColumn("_part", F.spark_partition_id()), whole


def _frame(like: DataFrame, columns: list[tuple[str, T.DataType]], rows: list[tuple]) -> DataFrame:
    """A frame of a row for each range, to be broadcast."""
    return F.broadcast(like.sparkSession.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in columns])))


def running(df: DataFrame, by: Order, sums: dict[str, Column] | None = None, number: str | None = None, rank: str | None = None, dense: str | None = None, percent: str | None = None, tiles: tuple[str, int] | None = None, parts: int | None = None) -> DataFrame:
    """df with running sums (up to each row), row number, ranks and tiles over one order of all rows.

    Sums of whole numbers and decimals are exact; null counts as nothing, and a sum before any value is null. Rows that
    are alike in `by` share their rank and dense rank; their row numbers and running sums follow a hash of the row.
    percent is the percent rank, 0 for a single row. An empty frame gives an empty one.
    """
    names, order = _ordered(by)
    sums = sums or {}
    dealt, whole = _dealt(df, names, order, _parts(df, parts), [c.alias(f"_s{i}") for i, c in enumerate(sums.values())])
    rows, peers = W.partitionBy("_part").orderBy(*whole), W.partitionBy("_part").orderBy(*order)
    local = dealt.withColumn("_n", F.row_number().over(rows)).withColumn("_r", F.rank().over(peers)).withColumn("_d", F.dense_rank().over(peers))
    for i in range(len(sums)):
        local = local.withColumn(f"_s{i}", F.sum(f"_s{i}").over(rows.rowsBetween(W.unboundedPreceding, 0)))
    local = staged(local.drop("_tie", "_id"))
    keys = F.struct(*(f"_k{i}" for i in range(len(names))))
    facts = [F.min_by(keys, "_n").alias("first"), F.max_by(keys, "_n").alias("last"), F.max("_n").alias("n"), F.max("_r").alias("r"), F.max("_d").alias("d")]
    found = local.groupBy("_part").agg(*facts, *(F.max_by(f"_s{i}", "_n").alias(f"_s{i}") for i in range(len(sums)))).orderBy("_part").collect()
    before, seen, dense_seen, last, last_rank, totals = [], 0, 0, None, 0, [None] * len(sums)
    for p in found:
        goes_on = last is not None and last == p["first"]
        before.append((p["_part"], seen, dense_seen - goes_on, last_rank if goes_on else seen + 1, *totals))
        last_rank = before[-1][3] if p["r"] == 1 else seen + p["r"]
        seen, dense_seen, last = seen + p["n"], dense_seen - goes_on + p["d"], p["last"]
        totals = [x if p[f"_s{i}"] is None else p[f"_s{i}"] + (x or 0) for i, x in enumerate(totals)]
    kinds = [local.schema[f"_s{i}"].dataType for i in range(len(sums))]
    offsets = _frame(df, [("_part", T.IntegerType()), *((c, T.LongType()) for c in ("_before", "_dense", "_first")), *((f"_t{i}", t) for i, t in enumerate(kinds))], before)
    out = local.join(offsets, "_part")
    position, ranked = F.col("_before") + F.col("_n"), F.when(F.col("_r") == 1, F.col("_first")).otherwise(F.col("_before") + F.col("_r"))
    more = [F.coalesce(F.col(f"_t{i}") + F.col(f"_s{i}"), f"_t{i}", f"_s{i}").cast(t).alias(n) for i, (n, t) in enumerate(zip(sums, kinds))]
    if number:
        more.append(position.alias(number))
    if rank:
        more.append(ranked.alias(rank))
    if dense:
        more.append((F.col("_dense") + F.col("_d")).alias(dense))
    if percent:
        more.append(((ranked - 1) / F.lit(max(seen - 1, 1))).alias(percent))
    if tiles:  # the first seen % k tiles hold one row more
        small, large = divmod(seen, tiles[1])
        at = position - 1
        tile = F.when(at < large * (small + 1), F.floor(at / (small + 1))).otherwise(large + F.floor((at - large * (small + 1)) / max(small, 1)))
        more.append((tile + 1).cast("long").alias(tiles[0]))
    return out.select("_row.*", *more)


def exact_quantiles(df: DataFrame, group: list[str], value: str, cont: dict[str, float], disc: dict[str, float] | None = None, parts: int | None = None) -> DataFrame:
    """Exact quantiles of each group: interpolated ones (`cont`) and ones that are values (`disc`), by name.

    Equal values of a group are counted first; their running number over the order (group, value) tells where each
    stands, and each quantile takes the one or two values that stand where it is due. Null values don't count; a group
    without values has no row.
    """
    disc = disc or {}
    names = [f"_g{i}" for i in range(max(len(group), 1))]
    counts = df.select(*(F.col(g).alias(n) for g, n in zip(group, names)), *(() if group else (F.lit(0).alias("_g0"),)), F.col(value).alias("_v")).where("_v is not null").groupBy(*names, "_v").agg(F.count("*").alias("_times"))
    placed = running(counts, [*names, "_v"], sums={"_end": F.col("_times")}, parts=parts)
    spans = placed.groupBy(*names).agg(F.min(F.col("_end") - F.col("_times")).alias("_start"), F.max("_end").alias("_stop"))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    joined = placed.alias("a").join(spans.alias("b"), _all(same)).select("a.*", "_start", "_stop")
    n = F.col("_stop") - F.col("_start")
    holds = lambda at: F.max(F.when((F.col("_end") - F.col("_times") - F.col("_start") <= at) & (at < F.col("_end") - F.col("_start")), F.col("_v")))
    wanted = []
    for i, q in enumerate(cont.values()):
        at = F.lit(float(q)) * (n - 1)
        wanted += [holds(F.floor(at)).alias(f"_lo{i}"), holds(F.ceil(at)).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
    wanted += [holds(F.greatest(F.ceil(F.lit(float(q)) * n) - 1, F.lit(0))).alias(f"_d{i}") for i, q in enumerate(disc.values())]
    found = joined.groupBy(*names).agg(*wanted)
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(c) for i, c in enumerate(cont)]
    return found.select(*(F.col(n).alias(g) for n, g in zip(names, group)), *between, *(F.col(f"_d{i}").alias(c) for i, c in enumerate(disc)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def asof_join_spread(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """Each left row with the `columns` of the last right row of its keys that isn't later, where a key may hold most rows.

    Both sides lie in one order by key and time, in ranges; each range carries its last right row forward, and a range
    that begins within a key takes what the ranges before it carry. Of right rows with equal times the one with the
    greatest columns counts. Null keys and null times match nothing. Right columns must not clash with left ones.
    """
    kinds = T.StructType([right.schema[n] for n in [right_time, *columns]])
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    a = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(kinds).alias("_right"))
    b = right.where(_all([F.col(c).isNotNull() for c in [*on, right_time]])).select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_left"), F.struct(right_time, *columns).alias("_right"))
    own = [f"_k{i}" for i in range(len(on))]
    order = [*own, "_time", "_side", "_right", "_id"]
    both = a.unionByName(b).withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(_parts(left, parts), *order).withColumn("_part", F.spark_partition_id())
    within = W.partitionBy("_part", *own).orderBy(*order[len(own) :]).rowsBetween(W.unboundedPreceding, 0)
    local = staged(both.withColumn("_last", F.last("_right", ignorenulls=True).over(within)).withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order))).select("_part", F.struct(*own).alias("_key"), "_n", "_side", "_left", "_last"))
    facts = local.groupBy("_part").agg(F.min_by("_key", "_n").alias("first"), F.max_by("_key", "_n").alias("key"), F.max_by(F.struct("_last"), "_n").alias("tail")).orderBy("_part").collect()
    carried, key, tail = [], None, None
    for p in facts:
        if tail is not None and key == p["first"]:
            carried.append((p["_part"], key, tail))
        tail = p["tail"]["_last"] if p["tail"]["_last"] is not None else tail if key == p["key"] else None
        key = p["key"]
    before = _frame(left, [("_part", T.IntegerType()), ("_first", local.schema["_key"].dataType), ("_carried", kinds)], carried)
    out = local.where("_side = 1").join(before, "_part", "left")
    last = F.coalesce("_last", F.when(F.col("_first") == F.col("_key"), F.col("_carried")))
    known = F.col(f"_left.`{left_time}`").isNotNull()
    return out.select("_left", F.when(known, last).alias("_found")).select("_left.*", *(F.col(f"_found.`{c}`").alias(c) for c in columns))
