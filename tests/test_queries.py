import pytest

from compare import database, same
from millrace import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, con):
    same(plans.QUERIES[name], plans.ORACLE_SQL[name], spark, SF, con)


def test_approximations_are_near(spark, con):
    got = {r["event_type"]: r for r in plans.QUERIES["approximate"](spark, SF).collect()}
    for kind, users, n in con.sql("SELECT event_type, count(DISTINCT user_id), count(*) FROM events GROUP BY 1").fetchall():
        assert got[kind]["n"] == n
        assert abs(got[kind]["users"] - users) <= max(3, 0.15 * users)
        assert abs(got[kind]["hll_users"] - users) <= max(3, 0.1 * users)


def test_sample_is_part_of_the_table(spark, con):
    got = {r[0] for r in plans.QUERIES["sampled"](spark, SF).collect()}
    every = {r[0] for r in con.sql("SELECT o_orderkey FROM orders").fetchall()}
    assert got <= every and 0.04 * len(every) < len(got) < 0.2 * len(every)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["discount_revenue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "l_orderkey" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sorted_table_has_nulls_last(spark):
    got = [(r["k"], r["n"]) for r in plans.QUERIES["sort_nulls_last"](spark, SF).collect()]
    assert got == sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])) and got[-1][0] is None


def test_frequent_items_and_median(spark, con):
    got = plans.QUERIES["frequent_items"](spark, SF).first()
    n, median = con.sql("SELECT count(*), median(value) FROM events").fetchall()[0]
    assert got["n"] == n and len(got["users"]) == 5 and abs(got["median"] - median) < 0.1 * median


def test_partitioned_read_is_pruned(spark):
    from millrace import session
    from millrace.sources import partitioned

    rows = partitioned(session.table(spark, SF, "events"), "event_type").where("event_type = 'click'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and len(rows.inputFiles()) > 1


def odd_events(folder, rows):
    """A folder with events of one's own (event_id, minute, user_id, event_type, value), and a database over it."""
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq

    ids, minutes, users, kinds, values = zip(*rows)
    times = pa.array([None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in minutes], pa.timestamp("us"))
    columns = {"event_id": pa.array(ids, pa.int64()), "ts": times, "user_id": pa.array(users, pa.int64()), "event_type": pa.array(kinds, pa.string()), "value": pa.array(values, pa.float64())}
    pq.write_table(pa.table(columns), folder / "events.parquet")
    return database(str(folder))


def test_numbers_of_zero_and_below(spark, tmp_path):
    con = odd_events(tmp_path, [(i, i, i, "click", v) for i, v in enumerate([0.0, -1.0, -7.5, 1.0, 50.0, None, 2.25])])
    same(plans.QUERIES["numbers"], plans.ORACLE_SQL["numbers"], spark, str(tmp_path), con)
    got = [r["ln"] for r in plans.QUERIES["numbers"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got[0] == float("-inf") and got[1] != got[1] and got[2] != got[2] and got[3] == 0 and got[5] is None


def test_first_of_equal_values_and_no_nulls(spark, tmp_path):
    rows = [(i, i // 20, i % 3, "click", float(i // 30 % 2)) for i in range(100)]
    rows += [(None, -5, 0, "view", 900.0), (None, 5, 3, None, 1.0), (200, None, 4, "error", None), (201, 7, 5, "view", float("nan")), (202, 7, 5, "view", 9.0)]
    con = odd_events(tmp_path, rows)
    same(plans.QUERIES["arg_max_and_sets"], plans.ORACLE_SQL["arg_max_and_sets"], spark, str(tmp_path), con)
    got = {r["user_id"]: (r["top_event"], r["first_event"]) for r in plans.QUERIES["arg_max_and_sets"](spark, str(tmp_path)).collect()}
    assert got == {0: (30, 0), 1: (31, 1), 2: (32, 2), 3: (None, None), 4: (None, None), 5: (201, 201)}


def test_numbers_are_rounded_as_in_floating_point(spark, tmp_path):
    """The products of these are halves, their decimal forms are less or more."""
    values = [4515.94, 4412.92, 747.1370148793959, 644.3214750527901, 2.5, 0.5, -3.25, 9e18]
    con = odd_events(tmp_path, [(i, i, i, "click", v) for i, v in enumerate(values)])
    wanted = con.sql(plans.ORACLE_SQL["numbers"] + " ORDER BY event_id").fetchall()
    got = plans.QUERIES["numbers"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert list(map(repr, map(tuple, got))) == list(map(repr, wanted))  # all digits, NaN too
