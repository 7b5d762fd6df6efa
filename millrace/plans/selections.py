"""Projection, predicates, conditionals, subqueries, set operations, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.grouping import top_k
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()


def views(spark, sf_dir, *names):
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


@R.query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS large FROM lineitem")
def project_computed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_quantity") > 25).alias("large"))


@R.query("""SELECT p_partkey, p_name FROM part WHERE (p_type LIKE '%O%' AND p_size IN (1, 2, 3, 7)) OR (p_retailprice BETWEEN 1000 AND 1100 AND NOT p_brand = 'Brand#12') OR regexp_matches(p_name, '^a.*e$')""")
def filter_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").where("(p_type like '%O%' and p_size in (1, 2, 3, 7)) or (p_retailprice between 1000 and 1100 and not p_brand = 'Brand#12') or p_name rlike '^a.*e$'").select("p_partkey", "p_name")


@R.query("""SELECT count(*) FILTER (WHERE x > 5) AS over, count(*) FILTER (WHERE NOT (x > 5)) AS under, count(*) FILTER (WHERE x IS NULL) AS unknown, count(*) FILTER (WHERE x IS DISTINCT FROM 5) AS other
    FROM (SELECT nullif(p_size % 10, 3) AS x FROM part)""")
def three_valued_logic(spark, sf_dir):
    x = F.nullif(F.col("p_size") % 10, F.lit(3))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    rows = table(spark, sf_dir, "part").select(x.alias("x"))
    return rows.agg(n(F.col("x") > 5, "over"), n(~(F.col("x") > 5), "under"), n(F.col("x").isNull(), "unknown"), n(~F.col("x").eqNullSafe(5), "other"))


@R.query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status FROM orders""")
def conditional(spark, sf_dir):
    size = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "medium").otherwise("small")
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"))


@R.query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(b.p_retailprice) FROM part b WHERE b.p_brand = part.p_brand)")
def correlated_scalar(spark, sf_dir):
    views(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(b.p_retailprice) FROM part b WHERE b.p_brand = part.p_brand)")


@R.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def in_and_not_exists(spark, sf_dir):
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")


@R.query("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12), named AS (SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey)
    SELECT n, count(*) AS customers FROM named GROUP BY n""")
def common_table_expression(spark, sf_dir):
    views(spark, sf_dir, "orders", "customer")
    return spark.sql("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12), named AS (SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey)
        SELECT n, count(*) AS customers FROM named GROUP BY n""")


@R.query("""WITH RECURSIVE m(m) AS (SELECT min(date_trunc('month', ts)) FROM events UNION ALL SELECT m + INTERVAL 1 DAY FROM m WHERE m < (SELECT date_trunc('day', max(ts)) FROM events))
    SELECT CAST(m AS TIMESTAMP) AS day, count(event_id) AS n FROM m LEFT JOIN events ON date_trunc('day', ts) = m GROUP BY m""")
def recursive_calendar(spark, sf_dir):
    """Events by day, from the first month's first day to the last event's; days without events count 0."""
    views(spark, sf_dir, "events")
    return spark.sql("""WITH RECURSIVE m(day, stop) MAX RECURSION LEVEL 100000 AS (SELECT CAST(min(date_trunc('month', ts)) AS TIMESTAMP_NTZ), CAST(date_trunc('day', max(ts)) AS TIMESTAMP_NTZ) FROM events
        UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS TIMESTAMP_NTZ), stop FROM m WHERE day < stop)
        SELECT day, count(event_id) AS n FROM m LEFT JOIN events ON CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) = day GROUP BY day""")


@R.query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey HAVING count(*) > 1")
def pipe_syntax(spark, sf_dir):
    views(spark, sf_dir, "supplier")
    return spark.sql("FROM supplier |> WHERE s_acctbal > 0 |> AGGREGATE count(*) AS n GROUP BY s_nationkey |> WHERE n > 1")


for _name, _sql in {
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
}.items():

    def _set(spark, sf_dir, sql=_sql):
        views(spark, sf_dir, "customer", "supplier", "orders")
        return spark.sql(sql)

    _set.__name__ = _name
    R.query(_sql)(_set)


@R.query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@R.query("SELECT p_partkey AS n, nullif(p_size % 7, 0) AS k FROM part")
def sort_nulls_last(spark, sf_dir):
    """The whole table, sorted; tests look at the order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.nullif(F.col("p_size") % 7, F.lit(0)).alias("k"))
    return rows.orderBy(F.desc_nulls_last("k"), "n")


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@R.query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 30")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").offset(30).limit(15).select("c_custkey")


@R.query("SELECT c_nationkey, c_custkey, CAST(rank AS INTEGER) AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    found = top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return found.select("c_nationkey", "c_custkey", "rank")


@R.query()
def sampled(spark, sf_dir):
    """A tenth of the orders, by a seeded sample."""
    return table(spark, sf_dir, "orders").sample(0.1, seed=11).select("o_orderkey")
