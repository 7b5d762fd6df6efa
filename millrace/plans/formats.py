"""Tables through other formats, partitioned folders and bucketed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import Registry
from millrace.session import table
from millrace.sources import bucketed, listed, partitioned, round_trip, scratch
from millrace.streaming import finished

R = Registry()

for _form, _options in {"csv": {"header": "true"}, "json": {}, "orc": {}, "xml": {"rowTag": "row"}}.items():

    def _trip(spark, sf_dir, form=_form, options=_options):
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        return round_trip(rows, form, **options).where("c_acctbal > 0")

    _trip.__name__ = f"through_{_form}"
    R.query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")(_trip)


@R.query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment")
def through_text(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").select("c_mktsegment").write.text(path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@R.query("SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL")
def pruned_partitions(spark, sf_dir):
    return partitioned(table(spark, sf_dir, "events"), "event_type").where("event_type = 'click'").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def bucketed_join(spark, sf_dir):
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 8)
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 8)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.query("""SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'""")
def listed_files(spark, sf_dir):
    """A table in a format of our own, in ranges of dates: the filter leaves files out by the manifest's statistics."""
    listed.register(spark)
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    orders.repartitionByRange(8, "o_orderdate", "o_orderkey").write.format("listed").option("path", path).mode("append").save()
    return spark.read.format("listed").option("path", path).load().where("o_orderdate >= timestamp_ntz'1998-01-01' and o_orderstatus = 'F'")


@R.query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def listed_stream(spark, sf_dir):
    """The same format as a stream: each run goes on after the files that it has read."""
    listed.register(spark)
    path, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        part.write.format("listed").option("path", path).mode("append").save()
        found = finished(spark.readStream.format("listed").option("path", path).load(), path=out, checkpoint=checkpoint)
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
