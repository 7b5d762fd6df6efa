"""The listed-files source: what comes back, which files filters leave out, failed and repeated writes."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from millrace.sources import listed

SCHEMA = "i long, x double, t timestamp_ntz, z timestamp, d date, s string, b binary, a array<int>, ok boolean"


@pytest.fixture
def rows(spark):
    listed.register(spark)
    at = dt.datetime(2024, 5, 1, 12)
    data = [(i, i / 2, at + dt.timedelta(days=i), at + dt.timedelta(days=i), at.date() + dt.timedelta(days=i), f"s{i:03}", bytes([i]), [i, None], i % 2 == 0) for i in range(100)]
    data += [(None,) * 9, (200, float("nan"), None, None, None, "x" * 999, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def load(spark, path):
    return spark.read.format("listed").option("path", path).load()


def test_what_is_written_comes_back(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows.repartition(4).write.format("listed").option("path", path).mode("append").save()
    back = load(spark, path)
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    rows.limit(3).coalesce(1).write.format("listed").option("path", "file://" + path).mode("append").save()
    assert load(spark, path).count() == 105
    rows.limit(7).write.format("listed").option("path", path).mode("overwrite").save()
    assert load(spark, path).count() == 7
    with pytest.raises(Exception, match="schema"):
        rows.select("i").write.format("listed").option("path", path).mode("append").save()
    rows.limit(0).write.format("listed").option("path", path).mode("overwrite").save()
    assert load(spark, path).count() == 0


@pytest.mark.parametrize("test,most", [
    ("i = 42", 1), ("i > 90", 2), ("i <= 5", 1), ("i in (3, 97)", 2), ("t >= timestamp_ntz'2024-08-01'", 1), ("z < timestamp'2024-05-02 12:00:00'", 1), ("d = date'2024-06-01'", 1),
    ("s like 's01%'", 3), ("s = 's055' and i > 50", 2), ("x > 48", 3), ("i is null", 1), ("i is not null", 10), ("i <> 5", 10), ("ok = true", 10), ("i = 5000", 0), ("isnan(x)", 10), ("i = 1 or i = 99", 10),
])
def test_filters_leave_files_out_and_lose_nothing(spark, rows, tmp_path, test, most):
    path = str(tmp_path / "t")
    rows.repartitionByRange(10, "i").write.format("listed").option("path", path).mode("append").save()
    found = load(spark, path).where(test)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.where(test).collect()))
    read = found.select(F.spark_partition_id()).rdd.getNumPartitions()
    assert read <= max(most, 1)


def test_files_of_failed_and_repeated_tasks_do_not_count(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    writer = listed.Writer(path, rows.schema, False)
    batches = rows.toArrow().to_batches()
    first, again = writer.write(iter(batches)), writer.write(iter(batches))
    writer.commit([first, None])
    assert load(spark, path).count() == 102
    writer.abort([again, None])
    assert len([f for f in os.listdir(path) if f.endswith(".arrow")]) == 1
    odd = rows.select(F.when(F.col("i") == 50, F.raise_error("odd")).otherwise(F.col("s")).alias("s"))
    with pytest.raises(Exception, match="odd"):
        odd.write.format("listed").option("path", str(tmp_path / "u")).mode("append").save()
    assert listed.manifest(str(tmp_path / "u"))["files"] == []


def test_statistics_are_bounds(tmp_path, rows):
    writer = listed.Writer(str(tmp_path), rows.schema, False)
    (entry,) = json.loads(json.dumps(writer.write(iter(rows.toArrow().to_batches())).files))
    own = entry["columns"]
    assert (entry["rows"], own["i"]["nulls"], own["i"]["least"], own["i"]["greatest"]) == (102, 1, 0, 200)
    assert own["x"]["greatest"] is None and own["s"]["greatest"] is None  # NaN, and a text that is too long
    assert not listed.possible(entry, ds.GreaterThan(("i",), 200)) and listed.possible(entry, ds.GreaterThan(("x",), 1e9)) and listed.possible(entry, ds.EqualTo(("s",), "zzz"))
