"""Scans over one order, as-of joins and quantiles of hot keys, and inequality joins, against plain loops."""

import datetime as dt
import math
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import inequality, ordering


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 9)])
def test_running_over_all_rows(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, 5, -2])) for i in range(80)]
    frame = spark.createDataFrame(rows, "i int, x int, y string, v int")
    got = ordering.running(frame, ["x", ("y", False)], {"total": F.col("v"), "all": F.lit(1)}, number="n", rank="r", dense="d", percent="p", tiles=("t", 7), parts=parts).collect()
    key = lambda r: (r["x"] is not None, r["x"] or 0, r["y"] is None, -ord(r["y"] or "a"))
    got = sorted(got, key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, 81)) == [r["all"] for r in got] and [key(r) for r in got] == sorted(map(key, got))
    total, dense = None, 0
    for i, r in enumerate(got):
        total = total if r["v"] is None else (total or 0) + r["v"]
        dense += i == 0 or key(got[i - 1]) != key(r)
        rank = 1 + next(j for j, other in enumerate(got) if key(other) == key(r))
        small, large = divmod(80, 7)
        tile = i // (small + 1) + 1 if i < large * (small + 1) else large + (i - large * (small + 1)) // small + 1
        assert (r["total"], r["r"], r["d"], r["p"], r["t"]) == (total, rank, dense, (rank - 1) / 79, tile)
    assert {tuple(r)[:4] for r in got} == set(rows)


def test_running_over_little(spark):
    none = spark.createDataFrame([], "x int")
    got = ordering.running(none, ["x"], {"s": F.col("x")}, number="n", rank="r", percent="p", tiles=("t", 3))
    assert got.columns == ["x", "s", "n", "r", "p", "t"] and got.count() == 0
    assert list(map(tuple, ordering.running(none.union(spark.createDataFrame([(4,)], "x int")), ["x"], {"s": F.col("x")}, number="n", percent="p", tiles=("t", 3)).collect())) == [(4, 4, 1, 0.0, 1)]


@pytest.mark.parametrize("seed,parts", [(1, 7), (2, 3)])
def test_quantiles_of_hot_groups(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([1.5, 1.5, 2.0, rng.random() * 9, None])) for _ in range(300)] + [("none", None)]
    got = {r["g"]: r for r in ordering.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.83}, {"d": 0.25, "z": 0.0}, parts=parts).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g]["m"] == pytest.approx(np.quantile(v, 0.5)) and got[g]["p"] == pytest.approx(np.quantile(v, 0.83))
        assert got[g]["d"] == v[max(0, math.ceil(0.25 * len(v)) - 1)] and got[g]["z"] == v[0]
    assert "none" not in got
    whole = ordering.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).collect()
    assert whole[0]["m"] == pytest.approx(np.median([x for _, x in rows if x is not None])) and len(whole) == 1


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 6), (3, 13)])
def test_asof_of_a_hot_key(spark, seed, parts):
    rng = random.Random(seed)
    at = lambda m: m if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    keys = ["hot"] * 20 + ["a", "z", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(50)])) for i in range(150)]
    right = [(rng.choice(keys), rng.choice([None, *range(20, 45)]), rng.choice([None, 1, 2, 3])) for _ in range(40)]
    a = spark.createDataFrame([(i, k, at(m)) for i, k, m in left], "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(m), v) for k, m, v in right], "k string, s timestamp_ntz, v int")
    got = {r["i"]: r["v"] for r in ordering.asof_join_spread(a, b, ["k"], "t", "s", ["v"], parts=parts).collect()}
    assert len(got) == len(left)
    for i, k, m in left:
        fit = [(n, -1 if v is None else v) for j, n, v in right if None not in (k, m, n) and j == k and n <= m]
        best = max(fit, default=(0, -1))[1]
        assert got[i] == (None if best == -1 else best)


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    dealt, _ = ordering._dealt(rows, ["k"], [F.col("_k0").asc()], 8, [])
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("first", OPS)
@pytest.mark.parametrize("second", [*OPS, None])
def test_pairs_within_ranges(monkeypatch, first, second):
    monkeypatch.setattr(inequality, "BLOCK", 5)
    rng = np.random.default_rng(len(first) + 7 * len(second or ""))
    lx, ly, rx, ry = (rng.integers(0, 9, n) for n in (30, 30, 40, 40))
    found = list(inequality.matches(lx, ly, rx, ry, first, second))
    got = sorted(p for i, j in found for p in zip(i.tolist(), j.tolist()))
    assert got == [(i, j) for i in range(30) for j in range(40) if OPS[first](lx[i], rx[j]) and (second is None or OPS[second](ly[i], ry[j]))]


@pytest.mark.parametrize("first,second", [("<", ">"), (">=", "<="), (">", None)])
def test_inequality_join_is_the_nested_loop(spark, monkeypatch, first, second):
    monkeypatch.setattr(inequality, "LEFT", 20)
    monkeypatch.setattr(inequality, "RIGHT", 30)
    rng = random.Random(5)
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    left = [(i, rng.choice([None, float("nan"), *[rng.random() for _ in range(6)]]), rng.randrange(30)) for i in range(90)]
    right = [(j, rng.choice([None, rng.random(), rng.random(), 0.5]), rng.randrange(30)) for j in range(70)]
    a = spark.createDataFrame([(i, x, at(y)) for i, x, y in left], "i int, x double, y timestamp_ntz")
    b = spark.createDataFrame([(j, x, at(y)) for j, x, y in right], "j int, u double, v timestamp_ntz")
    joined = inequality.inequality_join(a, b, ("x", first, "u"), ("y", second, "v") if second else None)
    assert joined.columns == ["i", "x", "y", "j", "u", "v"]
    got = sorted((r["i"], r["j"]) for r in joined.collect())
    assert got == [(i, j) for i, x, y in left for j, u, v in right if None not in (x, u) and OPS[first](x, u) and (second is None or OPS[second](y, v))]
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert inequality.inequality_join(a, b.limit(0), ("x", first, "u")).count() == 0


@pytest.mark.parametrize("small", [0, 16 << 20])
def test_inequality_join_runs_in_spark_alone(spark, monkeypatch, small):
    """Broadcast or not: no group goes to Python, and no task gets more than its share of the pairs."""
    monkeypatch.setattr(inequality, "LEFT", 100)
    monkeypatch.setattr(inequality, "RIGHT", 100)
    monkeypatch.setattr(inequality, "BLOCK", 9)
    monkeypatch.setattr(inequality, "PAIRS", 5)
    monkeypatch.setattr(inequality, "SMALL", small)
    a = spark.range(1500).select(F.col("id").alias("i"), (F.col("id") * 7 % 1000).alias("x"), (F.col("id") * 3 % 25).alias("u"))
    b = spark.range(1200).select(F.col("id").alias("j"), (F.col("id") * 11 % 1000).alias("y"), (F.col("id") * 7 % 25).alias("v"), F.lit("w").alias("_x"))
    joined = inequality.inequality_join(a, b, ("x", "<", "y"), ("u", ">", "v"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
    tasks = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    i, j = np.arange(1500), np.arange(1200)
    want = int(((i * 7 % 1000)[:, None] < (j * 11 % 1000))[(i * 3 % 25)[:, None] > (j * 7 % 25)].sum())
    assert sum(tasks) == want and (small == 0 or max(tasks) < want / 5)
    assert joined.where("x >= y or u <= v or _x <> 'w'").count() == 0 and joined.select("i", "j").distinct().count() == want


def test_inequality_join_shuffles_a_left_row_once(spark, monkeypatch):
    """Not once for each range on the right that it may match."""
    monkeypatch.setattr(inequality, "LEFT", 100)
    monkeypatch.setattr(inequality, "RIGHT", 100)
    a, b = (spark.range(1000).select(F.col("id").alias(c), (F.col("id") * 7 % 1000).alias(x)) for c, x in (("i", "x"), ("j", "y")))
    joined = inequality.inequality_join(a, b, ("x", "<", "y"))
    assert joined.count() == 499_500
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.find("explode(_to") < plan.find("Exchange RoundRobin")  # a plan's last steps stand first
