"""Joins of every kind: by key, by hint, by condition, by range, as of a time, lateral."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.joins import asof_join, interval_join, range_join, salted_join, sized
from millrace.plans.registry import Registry
from millrace.plans.selections import views
from millrace.session import table

R = Registry()

for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():

    def _join(spark, sf_dir, how=_how):
        orders = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_orderkey", "o_custkey")
        customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
        return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "c_name", "o_orderkey")

    _join.__name__ = f"join_{_how}"
    R.query(f"SELECT c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {_sql} (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey")(_join)

for _how, _not in {"left_semi": "", "left_anti": "NOT "}.items():

    def _semi(spark, sf_dir, how=_how):
        return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), how).select("o_orderkey")

    _semi.__name__ = f"join_{_how}"
    R.query(f"SELECT o_orderkey FROM orders WHERE {_not}EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(_semi)

_BY_NATION = "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
for _hint in ("broadcast", "merge", "shuffle_hash"):

    def _hinted(spark, sf_dir, hint=_hint):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        side = sized(customers) if hint == "broadcast" else customers.hint(hint)
        joined = table(spark, sf_dir, "orders").select("o_custkey").join(side, F.col("o_custkey") == F.col("c_custkey"))
        by_key = joined.groupBy("c_nationkey").agg(F.count("*").alias("n"))
        return by_key.join(sized(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")

    _hinted.__name__ = f"join_{_hint}"
    R.query(_BY_NATION)(_hinted)


@R.query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_salted(spark, sf_dir):
    """Each part's lines are spread over several tasks."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    joined = salted_join(lines, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"], 4)
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"))


@R.query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta_within_key(spark, sf_dir):
    a, b = (table(spark, sf_dir, "nation").alias(x) for x in "ab")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@R.query("SELECT count(*) AS n FROM (SELECT nullif(p_size % 5, 0) AS k FROM part) a JOIN (SELECT DISTINCT nullif(p_size % 5, 0) AS k FROM part) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.nullif(F.col("p_size") % 5, F.lit(0)).alias("k"))
    b = a.distinct().select(F.col("k").alias("j"))
    return a.join(b, F.col("k").eqNullSafe(F.col("j"))).agg(F.count("*").alias("n"))


@R.query("""SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    purchases = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    looks = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("last_view"))
    return asof_join(purchases, looks, ["user_id"], "ts", "seen", ["last_view"]).select("event_id", "last_view")


@R.query("""SELECT a.event_id AS click, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR""")
def join_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), F.col("ts").alias("failed"))
    return interval_join(clicks, errors, "clicked", "failed", 7200, ["user_id"]).select("click", "error")


@R.query("""SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 100 AND s_acctbal + 100 GROUP BY s_suppkey""")
def join_range(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    ranges = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", (F.col("s_acctbal") - 100).alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))
    return range_join(points, ranges, "c_acctbal", "lo", "hi", 200, ["nation"]).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@R.query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2")
def join_lateral_top(spark, sf_dir):
    """The two largest orders of each customer: a lateral top-k, as a window."""
    w = "row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r"
    best = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", w).where("r <= 2")
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@R.query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_lateral_aggregate(spark, sf_dir):
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("SELECT c_custkey, n, coalesce(most, 0) AS most FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_custkey = c_custkey)")


@R.query("SELECT n_name, c_custkey, c_acctbal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500")
def join_lateral_frame(spark, sf_dir):
    """A lateral join of frames: the inner one refers to the outer row; nations without such a customer stay."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    rich = customer.where((F.col("c_nationkey") == F.col("n_nationkey").outer()) & (F.col("c_acctbal") > 9500)).select("c_custkey", "c_acctbal")
    return nation.lateralJoin(rich, how="left").select("n_name", "c_custkey", "c_acctbal")


@R.query("SELECT doc_id, i, word FROM (SELECT doc_id, unnest(string_split(text, ' ')[:8]) AS word, unnest(range(len(string_split(text, ' ')[:8]))) AS i FROM documents) WHERE length(word) > 6")
def join_lateral_generator(spark, sf_dir):
    """A lateral join with a generator: each text's first words, with their places, filtered within the join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.split("text", " "), 1, 8).alias("words"))
    each = spark.tvf.posexplode(F.col("words").outer()).toDF("i", "word").where(F.length("word") > 6)
    return docs.lateralJoin(each).select("doc_id", F.col("i").cast("long").alias("i"), "word")
