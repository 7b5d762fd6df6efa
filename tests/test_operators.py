import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.grouping import groups_frame, sessions, top_k
from millrace.operators.joins import asof_join, interval_join, range_join, salted_join

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20)), max_size=12), st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20), st.integers(0, 3)), max_size=12))
def test_asof_takes_the_last_not_later(spark, left, right):
    a = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(left)], "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(m), v) for k, m, v in right], "k string, s timestamp_ntz, v int")
    got = {r["i"]: r["v"] for r in asof_join(a, b, ["k"], "t", "s", ["v"]).collect()}
    for i, (k, m) in enumerate(left):
        fit = [(n, v) for j, n, v in right if j == k and n <= m]
        assert got[i] == (max(fit)[1] if fit else None)


@FEW
@given(st.lists(st.integers(-30, 30), max_size=15), st.lists(st.tuples(st.integers(-30, 30), st.integers(0, 25)), max_size=8))
def test_range_join_is_the_nested_loop(spark, points, ranges):
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(points)], "i int, x double")
    r = spark.createDataFrame([(j, float(a), float(a + n)) for j, (a, n) in enumerate(ranges)], "j int, lo double, hi double")
    got = sorted((x["i"], x["j"]) for x in range_join(p, r, "x", "lo", "hi", 10).collect())
    assert got == sorted((i, j) for i, x in enumerate(points) for j, (a, n) in enumerate(ranges) if a <= x <= a + n)


def test_salted_join_keeps_every_row(spark):
    a = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, i int")
    b = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("other", "z")], "k string, v string")
    for how in ("inner", "left"):
        got, want = (sorted(map(str, d.select("k", "i", "v").collect())) for d in (salted_join(a, b, ["k"], 4, how), a.join(b, "k", how)))
        assert got == want


def test_interval_join_at_the_bound(spark):
    a = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(61)), (3, "v", at(0)), (4, None, at(0))], "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame([("u", at(60), 10), ("v", None, 11)], "k string, s timestamp_ntz, j int")
    assert sorted((r["i"], r["j"]) for r in interval_join(a, b, "t", "s", 3600, ["k"]).collect()) == [(1, 10), (2, 10)]


def test_sessions_part_only_beyond_the_gap(spark):
    a = spark.createDataFrame([("u", at(m)) for m in (0, 30, 61)], "k string, t timestamp_ntz")
    assert [r["session"] for r in sessions(a, ["k"], "t", 1800).orderBy("t").collect()] == [1, 1, 2]


def test_top_k_and_group_frames(spark):
    a = spark.createDataFrame([("u", 1), ("u", 1), ("u", 3), ("u", 4), ("v", None)], "k string, x int")
    assert sorted((r["k"], r["x"]) for r in top_k(a, ["k"], [F.desc("x")], 2).collect() if r["x"]) == [("u", 3), ("u", 4)]
    got = groups_frame(a.where("k = 'u'"), ["k"], "x", 1, 0, F.sum("x"), "s").orderBy("x").collect()
    assert [r["s"] for r in got] == [2, 2, 5, 7]


def test_tasks_of_a_salted_join_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
        b = spark.range(0, 2000, 2).select((F.col("id") + 1).alias("k"), F.col("id").alias("v"))
        for how in ("inner", "left"):
            joined = salted_join(a, b, ["k"], 4, how)
            sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert len(sizes) > 60  # 6,000 rows of both sides with their copies: 120 tasks
            got, want = (sorted(map(str, d.select("k", "i", "v").collect())) for d in (joined, a.join(b, "k", how)))
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
