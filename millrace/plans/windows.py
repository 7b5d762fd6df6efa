"""Window functions and frames, qualified rows and sessions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.grouping import groups_frame, sessions
from millrace.plans.registry import Registry
from millrace.plans.selections import views
from millrace.session import table

R = Registry()


@R.query("""SELECT event_id, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, round(percent_rank() OVER w, 9) AS percent, round(cume_dist() OVER w, 9) AS share, CAST(ntile(4) OVER w AS BIGINT) AS quarter
    FROM (SELECT event_id, user_id, floor(value) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY v, event_id)""")
def ranks(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.floor("value"), "event_id")
    n = lambda c, name: c.over(w).cast("long").alias(name)
    return table(spark, sf_dir, "events").select("event_id", n(F.rank(), "rank"), n(F.dense_rank(), "dense"), F.round(F.percent_rank().over(w), 9).alias("percent"), F.round(F.cume_dist().over(w), 9).alias("share"), n(F.ntile(4), "quarter"))


@R.query("""SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(nullif(event_type, 'click') IGNORE NULLS) OVER w AS first, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def neighbours(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    first = F.first(F.nullif("event_type", F.lit("click")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"), first.alias("first"), F.nth_value("event_id", 2).over(w).alias("second"))


@R.query("""SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events""")
def frames(spark, sf_dir):
    views(spark, sf_dir, "events")
    return spark.sql("""SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events""")


@R.query("""SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM part""")
def frame_of_groups(spark, sf_dir):
    return groups_frame(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1, 1, F.sum("p_size"), "near").select("p_partkey", "near")


@R.query("SELECT c_custkey, c_nationkey FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) = 1")
def qualify(spark, sf_dir):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(spark, sf_dir, "customer").withColumn("r", F.rank().over(w)).where("r = 1").select("c_custkey", "c_nationkey")


@R.query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first FROM s GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    found = sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@R.query("""SELECT o_custkey, o_orderkey, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS DOUBLE) AS running FROM orders""")
def running_total(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("running"))
