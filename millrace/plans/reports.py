"""Business reports over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.joins import sized
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()


def money(c):
    """An exact sum, whatever the order of its rows."""
    return F.round(F.sum(c.cast("decimal(18,4)")), 2).cast("double")


@R.query("""
    SELECT l_returnflag, l_linestatus, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_qty,
        CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_disc_price,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-09-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money(F.col("l_quantity")).alias("sum_qty"), money(price).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@R.query("""
    SELECT r_name, n_name, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL""")
def revenue_by_nation(spark, sf_dir):
    t = lambda x: table(spark, sf_dir, x)
    places = sized(t("nation").join(sized(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))
    orders = t("orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    # by order first: only lines of these orders are added up, lineitem is shuffled once, and a row for each order goes on
    lines = t("lineitem").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("part"), F.count("*").alias("n"))
    by_order = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = by_order.groupBy("c_nationkey").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("part"), 2).cast("double").alias("revenue"), F.sum("n").alias("n_lines"))


@R.query("""
    SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue, o_orderdate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark, sf_dir):
    t = lambda x: table(spark, sf_dir, x)
    customers = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = t("orders").where("o_orderdate < timestamp_ntz'1998-03-15'").join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    lines = t("lineitem").where("l_shipdate > timestamp_ntz'1998-03-15'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(money(price).alias("revenue"))
    return joined.select("l_orderkey", "revenue", "o_orderdate").orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@R.query("""
    SELECT CAST(round(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""")
def discount_revenue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01' and l_discount between 0.03D and 0.07D and l_quantity < 24")
    return rows.agg(money(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@R.query("""
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""")
def order_priority(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    late = orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi")
    return late.groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@R.query("""
    SELECT n_orders, count(*) AS n_customers FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) GROUP BY n_orders""")
def order_distribution(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    each = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return each.groupBy(F.coalesce("n", F.lit(0)).alias("n_orders")).agg(F.count("*").alias("n_customers"))


@R.query("""
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_brand <> 'Brand#11' AND p_size IN (1, 5, 9, 14, 23, 36, 45, 49) GROUP BY ALL""")
def parts_suppliers(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11' and p_size in (1, 5, 9, 14, 23, 36, 45, 49)").select("p_partkey", "p_brand", "p_type", "p_size")
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("n_suppliers"))


@R.query("""
    WITH r AS (SELECT l_suppkey AS s, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS total FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, CAST(round(total, 2) AS DOUBLE) AS total FROM supplier JOIN r ON s_suppkey = s WHERE total = (SELECT max(total) FROM r)""")
def top_supplier(spark, sf_dir):
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(price).alias("total"))
    best = sums.agg(F.max("total").alias("best"))  # one row
    rows = sums.join(F.broadcast(best), F.col("total") == F.col("best")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("s_suppkey", "s_name", F.round("total", 2).cast("double").alias("total"))
