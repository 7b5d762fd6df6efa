"""Table functions in Python, and count-min sketches."""

import datetime as dt
import random
from collections import Counter

import pytest

from millrace.functions import tables
from millrace.operators.sketches import count_min


def test_sessions_of_a_table(spark):
    tables.register(spark)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", 1, at(0)), ("a", 2, at(60)), ("a", 3, at(121)), ("b", 4, at(0)), ("b", 5, None), (None, 6, at(9)), (None, 7, at(10))]
    spark.createDataFrame(rows, "u string, `odd name` int, t timestamp_ntz").createOrReplaceTempView("visits_")
    found = spark.sql("SELECT * FROM sessions_of(TABLE(visits_) PARTITION BY (u) ORDER BY (t), 't', 60, 'u, odd name')")
    assert found.schema.simpleString() == "struct<u:string,odd name:int,begins:timestamp_ntz,ends:timestamp_ntz,n:bigint>"
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, at(0), at(60), 2), ("a", 3, at(121), at(121), 1), ("b", 4, at(0), at(0), 1), (None, 6, at(9), at(10), 2)], key=str)
    assert spark.sql("SELECT * FROM sessions_of(TABLE(SELECT * FROM visits_ WHERE false) PARTITION BY (u) ORDER BY (t), 't', 60, '')").count() == 0
    for call in ("'u', 60, 'u'", "'none', 60, ''", "'t', 60, 'none'"):
        with pytest.raises(Exception, match="must be|has no"):
            spark.sql(f"SELECT * FROM sessions_of(TABLE(visits_) PARTITION BY (u) ORDER BY (t), {call})").collect()


@pytest.mark.parametrize("error,confidence", [(0.05, 0.9), (0.01, 0.99)])
def test_count_min_keeps_its_bounds(spark, error, confidence):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else int(rng.paretovariate(0.7)) % 1000,) for _ in range(5000)]
    exact, frame = Counter(x for (x,) in rows), spark.createDataFrame(rows, "x long")
    asked = spark.createDataFrame([(x,) for x in [*exact, 10**9]], "x long")
    got = dict(map(tuple, count_min(frame, "x", error, confidence)(asked, "x", "n").collect()))
    over = [n - exact[x] for x, n in got.items()]
    assert len(got) == len(exact) + 1 and min(over) >= 0
    assert sum(x > error * len(rows) for x in over) <= (1 - confidence) * len(over)


def test_theta_sketches_are_near(spark):
    from compare import database
    from millrace import plans

    got = plans.QUERIES["theta_sets"](spark, "/root/testdata/sf0.001").first().asDict()
    con = database("/root/testdata/sf0.001")
    c, p = ({r[0] for r in con.sql(f"SELECT DISTINCT user_id FROM events WHERE event_type = '{k}'").fetchall()} for k in ("click", "purchase"))
    want = {"clicked": len(c), "bought": len(p), "both": len(c & p), "either": len(c | p), "clicked_only": len(c - p)}
    assert got == want  # fewer users than a sketch has entries: exact
