"""Aggregates: grouping sets, distinct and filtered, statistics, quantiles, arg-min and -max, strings, sketches, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.grouping import spread_count_distinct
from millrace.operators.sketches import count_min
from millrace.plans.registry import Registry
from millrace.plans.selections import views
from millrace.session import table

R = Registry()

for _name, _group in {
    "group_rollup": "ROLLUP (o_orderstatus, o_orderpriority)",
    "group_cube": "CUBE (o_orderstatus, o_orderpriority)",
    "group_sets": "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
}.items():
    _sql = "SELECT o_orderstatus, o_orderpriority, {g} AS level, count(*) AS n FROM orders GROUP BY " + _group

    def _grouped(spark, sf_dir, sql=_sql.format(g="CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT)")):
        views(spark, sf_dir, "orders")
        return spark.sql(sql)

    _grouped.__name__ = _name
    R.query(_sql.format(g="CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT)"))(_grouped)


@R.query("""SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 100) AS high, CAST(sum(event_id) FILTER (WHERE value <= 100) AS BIGINT) AS low_ids FROM events GROUP BY event_type""")
def distinct_and_filtered(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    low = F.sum(F.when(F.col("value") <= 100, F.col("event_id")))
    return events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("value") > 100, 1)).alias("high"), low.alias("low_ids"))


@R.query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag")
def distinct_of_hot_groups(spark, sf_dir):
    return spread_count_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "orders")


@R.query("""SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(corr(value, event_id), 6) AS r, round(regr_slope(value, event_id), 9) AS slope FROM events GROUP BY event_type""")
def statistics(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.var_pop(v), 4).alias("var"), F.round(F.corr(v, i), 6).alias("r"), F.round(F.regr_slope(v, i), 9).alias("slope"))


@R.query("""SELECT p_brand, round(median(p_retailprice), 4) AS median, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, quantile_disc(p_retailprice, 0.25) AS p25 FROM part GROUP BY p_brand""")
def quantiles(spark, sf_dir):
    views(spark, sf_dir, "part")
    return spark.sql("""SELECT p_brand, round(median(p_retailprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY p_retailprice), 4) AS p90,
        percentile_disc(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS p25 FROM part GROUP BY p_brand""")


@R.query("""SELECT user_id, arg_max(event_id, value) AS top_event, arg_min(event_id, ts) AS first_event, bool_or(event_type = 'error') AS failed, bool_and(value < 480) AS modest,
    array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id""")
def arg_max_and_sets(spark, sf_dir):
    """Of a user's equal values or times the event with the smallest id counts, the first of the table, in any partitioning;
    events without an id don't count."""
    known = F.col("event_id").isNotNull()
    high = F.when(known & F.col("value").isNotNull(), F.struct("value", F.bitwise_not("event_id")))
    early = F.when(known & F.col("ts").isNotNull(), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_id", high).alias("top_event"), F.min_by("event_id", early).alias("first_event"), F.bool_or(F.col("event_type") == "error").alias("failed"),
        F.bool_and(F.col("value") < 480).alias("modest"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds"),
    )


@R.query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def ordered_string_aggregate(spark, sf_dir):
    views(spark, sf_dir, "nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@R.query()
def approximate(spark, sf_dir):
    """Sketch aggregates: distinct counts, quantiles; mergeable, of fixed size."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("hll_users"), F.count("*").alias("n"),
    )


@R.query("SELECT event_type, hour, n FROM (SELECT event_type, CAST(extract('hour' FROM ts) AS BIGINT) % 4 AS hour, count(*) AS n FROM events GROUP BY ALL)")
def unpivot(spark, sf_dir):
    hours = [0, 1, 2, 3]
    rows = table(spark, sf_dir, "events").select("event_type", (F.hour("ts") % 4).alias("h"))
    wide = rows.groupBy("event_type").pivot("h", hours).agg(F.count(F.lit(1)))
    return wide.unpivot(["event_type"], [str(h) for h in hours], "hour", "n").select("event_type", F.col("hour").cast("long").alias("hour"), "n")


@R.query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@R.query()
def theta_sets(spark, sf_dir):
    """How many users clicked, bought, did both, either, or clicked only: set algebra over Theta sketches of 2**12 entries, exact up to so many users."""
    views(spark, sf_dir, "events")
    return spark.sql("""WITH s AS (SELECT theta_sketch_agg(user_id, 12) FILTER (WHERE event_type = 'click') AS c, theta_sketch_agg(user_id, 12) FILTER (WHERE event_type = 'purchase') AS p FROM events)
        SELECT theta_sketch_estimate(c) AS clicked, theta_sketch_estimate(p) AS bought, theta_sketch_estimate(theta_intersection(c, p)) AS both, theta_sketch_estimate(theta_union(c, p, 12)) AS either, theta_sketch_estimate(theta_difference(c, p)) AS clicked_only FROM s""")


@R.query()
def frequencies_by_sketch(spark, sf_dir):
    """How often each user's events occur by a count-min sketch: never too few, and with 99 % confidence at most 0.1 % of all too many."""
    events = table(spark, sf_dir, "events").select("user_id")
    counts = count_min(events, "user_id", 0.001, 0.99)
    return counts(events.distinct(), "user_id", "estimate")


@R.query("SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS c_mktsegment FROM customer) GROUP BY 1")
def group_by_collation(spark, sf_dir):
    """Groups under a collation in which keys of different bytes are equal."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    grouped = table(spark, sf_dir, "customer").select(F.collate(name, "UTF8_LCASE").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    return grouped.select(F.lower(F.collate("segment", "UTF8_BINARY")).alias("segment"), "n")


@R.query("SELECT c_custkey, n FROM customer JOIN (SELECT lower(o_orderstatus) AS k, count(*) AS n FROM orders GROUP BY 1) ON lower(substr(c_mktsegment, 3, 1)) = k")
def join_by_collation(spark, sf_dir):
    """A join of upper with lower case under a Unicode collation that doesn't tell them apart."""
    counts = table(spark, sf_dir, "orders").groupBy(F.lower("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    letter = F.collate(F.substring("c_mktsegment", 3, 1), "UNICODE_CI")
    return table(spark, sf_dir, "customer").join(counts, letter == F.collate("k", "UNICODE_CI")).select("c_custkey", "n")
