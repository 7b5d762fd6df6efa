"""Functions of one's own: vectorised, grouped, cogrouped, table functions and SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.functions.tables import register
from millrace.plans.registry import Registry
from millrace.plans.selections import views
from millrace.session import table

R = Registry()


@R.query("SELECT p_partkey, round(p_retailprice * 1.19, 4) AS gross FROM part")
def pandas_scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.19

    return table(spark, sf_dir, "part").select("p_partkey", F.round(gross("p_retailprice"), 4).alias("gross"))


@R.query("SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY p_brand")
def pandas_aggregate(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(price: pd.Series) -> float:
        return float(price.max() - price.min())

    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(spread("p_retailprice"), 4).alias("spread"))


@R.query("SELECT user_id, event_id, round(value - min(value) OVER (PARTITION BY user_id), 3) AS apart FROM events")
def grouped_map(spark, sf_dir):
    def apart(pdf):
        return pdf[["user_id", "event_id"]].assign(apart=(pdf["value"] - pdf["value"].min()))

    found = table(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(apart, "user_id long, event_id long, apart double")
    return found.select("user_id", "event_id", F.round("apart", 3).alias("apart"))


@R.query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def cogrouped_map(spark, sf_dir):
    def both(key, a, b):
        return pd.DataFrame({"k": [key[0]], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    counts = [table(spark, sf_dir, t).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return counts[0].groupBy("k").cogroup(counts[1].groupBy("k")).applyInPandas(both, "k int, customers long, suppliers long")


@R.query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 100")
def arrow_map(spark, sf_dir):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            kept = batch.filter(pc.greater(batch.column(1), 100.0))
            yield pa.RecordBatch.from_arrays([kept.column(0), pc.multiply(kept.column(1), 2.0)], names=["event_id", "twice"])

    return table(spark, sf_dir, "events").select("event_id", "value").mapInArrow(run, "event_id long, twice double")


@R.query("SELECT event_type, count(*) AS n, CAST(max(event_id) - min(event_id) AS BIGINT) AS span FROM events GROUP BY event_type")
def grouped_batches(spark, sf_dir):
    """A grouped map that takes a group batch by batch, so that no group is held whole."""

    def spans(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = 0, None, None
        for batch in batches:
            own = pc.min_max(batch.column("event_id")).as_py()
            n, least, most = n + batch.num_rows, min(own["min"], own["min"] if least is None else least), max(own["max"], own["max"] if most is None else most)
        yield pa.RecordBatch.from_pydict({"event_type": [key[0].as_py()], "n": [n], "span": [most - least]})

    return table(spark, sf_dir, "events").select("event_type", "event_id").groupBy("event_type").applyInArrow(spans, "event_type string, n long, span long")


@R.query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation")
def python_table_function(spark, sf_dir):
    """A table function in Python, joined laterally."""
    register(spark)
    views(spark, sf_dir, "nation")
    return spark.sql("SELECT n_nationkey, part FROM nation, LATERAL parts_of(n_name, '_')")


@R.query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, event_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(event_id) AS event_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s GROUP BY user_id, k""")
def python_table_sessions(spark, sf_dir):
    """A table function over a partitioned and ordered table: rows stream through it, and its schema follows its arguments."""
    register(spark)
    views(spark, sf_dir, "events")
    return spark.sql("SELECT * FROM sessions_of(TABLE(SELECT user_id, event_id, ts FROM events) PARTITION BY (user_id) ORDER BY (ts), 'ts', 21600, 'user_id, event_id')")


@R.query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '') AS letters FROM part")
def python_scalar(spark, sf_dir):
    """A plain Python function, for logic that has no vectorised form; its rows go to Python in Arrow batches."""

    @F.udf("string", useArrow=True)
    def letters(name: str) -> str | None:
        return None if name is None else "".join(w[:1] for w in name.split(" "))

    return table(spark, sf_dir, "part").select("p_partkey", letters("p_name").alias("letters"))


@R.query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_quantity > 45")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION charge(price DOUBLE, discount DOUBLE, tax DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount) * (1 + tax)")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, charge(l_extendedprice, l_discount, l_tax) AS charge FROM lineitem WHERE l_quantity > 45")
