"""Stateful streaming operators over several runs: timers, restart, rows out of order, state that expires."""

import datetime as dt
import os
import subprocess
import sys
import time

import pytest

from millrace.plans import registry
from millrace.sources import scratch
from millrace.streaming import finished
from millrace.streaming.stateful import Visits, first_seen, rocksdb, visits

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def runs(spark, parts, run, clock=False):
    """What is there after each part has come and the stream has gone on from its checkpoint."""
    source, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    found = []
    for part in parts:
        spark.createDataFrame(part, "u string, t timestamp, m long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("u string, t timestamp, m long").parquet(source).withWatermark("t", "0 seconds")
        with rocksdb(spark, clock):
            found.append(sorted(map(tuple, finished(run(stream), path=out, checkpoint=checkpoint).collect())))
    return found


def test_visits_close_by_timer_and_go_on_after_a_restart(spark):
    parts = [
        [("a", at(30), None), ("a", at(0), 7), ("b", at(5), 9), ("a", at(20), 8)],  # out of order, one visit of a
        [("a", at(45), 3), ("c", at(50), None)],  # a goes on; b is idle for long
        [("c", at(200), 1)],  # all others are idle
        [("d", at(1000), None)],
    ]
    got = runs(spark, parts, lambda s: visits(s, "u", "t", "m", 20 * 60))
    b, a = ("b", 1, at(5), at(5), 1, "9"), ("a", 1, at(0), at(45), 4, "7,8,3")
    assert got[0] == [b] and got[1] == [b]
    assert got[2] == sorted([a, b, ("c", 1, at(50), at(50), 1, "")])
    assert got[3] == sorted([*got[2], ("c", 2, at(200), at(200), 1, "1")])


def test_a_late_bridge_joins_two_open_visits(spark):
    got = runs(spark, [[("a", at(0), None), ("a", at(15), None), ("x", at(5), None)], [("a", at(16), 5), ("y", at(16), None)], [("z", at(500), None)]], lambda s: visits(s, "u", "t", "m", 10 * 60))
    assert ("a", 2, at(15), at(16), 2, "5") in got[-1] and ("a", 1, at(0), at(0), 1, "") in got[-1]


def test_state_expires(spark):
    parts = [[("a", at(0), None)] * 3, [("a", at(1), None), ("b", at(1), None)], [("a", at(2), None)]]
    got = runs(spark, parts[:2], lambda s: first_seen(s, ["u"], 3600), True)
    assert got == [[("a",)], [("a",), ("b",)]]

    def slow(stream):
        time.sleep(1.5)
        return first_seen(stream, ["u"], 1)

    assert runs(spark, parts, slow, True)[-1] == [("a",), ("a",), ("a",), ("b",)]


def test_a_repeated_name_is_an_error():
    def query(spark, sf_dir):
        pass

    r = registry.Registry()
    r.query()(query)
    with pytest.raises(ValueError):
        r.query()(query)
    with pytest.raises(ValueError):
        registry.joined([r, r])


def test_python_processes_need_no_path(tmp_path):
    """As an application that is started elsewhere runs it: only the driver can import the package."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from millrace import plans, session
spark = session.local(2, 2)
for name in ("stream_visits", "listed_stream", "python_table_sessions"):
    print(name, plans.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[1:] and line.split()[1].isdigit()] == ["stream_visits", "listed_stream", "python_table_sessions"], done.stderr[-2000:]


class Calls:
    """A value and a list in place of Spark's state; every use of either or of a timer is a call to Spark."""

    def __init__(self):
        self.n, self.kept, self.timers = 0, {}, []

    def getValueState(self, name, schema):
        return self.state(name, None)

    def getListState(self, name, schema):
        return self.state(name, [])

    def state(self, name, empty):
        def call(f):
            def counted(*args):
                self.n += 1
                return f(*args)

            return counted

        one = type("State", (), {})()
        one.get = call(lambda: self.kept.get(name, empty))
        one.exists = call(lambda: name in self.kept)
        one.update = one.put = call(lambda v: self.kept.__setitem__(name, v))
        one.appendValue = call(lambda v: self.kept.setdefault(name, []).append(v))
        one.clear = call(lambda: self.kept.pop(name, None))
        return one

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_calls_to_spark_do_not_follow_the_rows():
    import pandas as pd

    handle, processor = Calls(), Visits("u", 60)
    processor.init(handle)
    hour = 3600 * 1_000_000
    rows = pd.DataFrame({"u": "a", "at_": [i * hour for i in range(500)], "mark_": [i % 2 for i in range(500)], "id_": range(500)})
    list(processor.handleInputRows(("a",), iter([rows[:300], rows[300:]]), None))
    assert handle.n <= 8 and handle.timers == [60_001]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 450 * 3_600_000})()
    (out,) = processor.handleExpiredTimer(("a",), clock, None)
    assert handle.n <= 16 and handle.timers[-1] == 450 * 3_600_000 + 60_001
    assert list(out["number"]) == list(range(1, 451)) and list(out["marked"]) == [str(i) if i % 2 else "" for i in range(450)]
    assert len(handle.kept["own"][2]) == 50 and handle.kept["marked"][0][1] == list(range(451, 500, 2))
