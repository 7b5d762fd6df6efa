"""Further functions and statements: pieces of text, pairs of arrays, maps, JSON, modes, sketches, scripts, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import Registry
from millrace.plans.selections import views
from millrace.session import table

R = Registry()


@R.query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id")
def conversations_assembled(spark, sf_dir):
    """The turns of each conversation in their order; one conversation is one row, so it is held whole."""
    views(spark, sf_dir, "conversations")
    return spark.sql("SELECT conv_id, count(*) AS turns, listagg(role || ': ' || text, '\\n') WITHIN GROUP (ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id")


@R.query("SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0")
def labelled_clean(spark, sf_dir):
    """The documents that labels call good and not toxic; texts are not read."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(good, "doc_id")


@R.query("""SELECT c_custkey, array_to_string(regexp_extract_all(c_name, '[0-9]{3}'), '-') AS parts, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title, left(c_name, 2) || '##' || substr(c_name, 5) AS laid FROM customer""")
def string_parts(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(F.regexp_extract_all(name, F.lit("[0-9]{3}"), F.lit(0)), "-").alias("parts"), F.initcap("c_mktsegment").alias("title"), F.overlay(name, F.lit("##"), 3, 2).alias("laid")
    )


@R.query("""SELECT event_id, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS hours, CAST(ts + INTERVAL 90 MINUTE AS TIMESTAMP) AS later FROM events""")
def intervals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts)").alias("hours"), F.expr("ts + interval 90 minutes").alias("later"))


@R.query("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS mirrored, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS strong, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS size FROM embeddings""")
def array_pairs(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(F.zip_with(e, F.reverse(e), lambda a, b: a * b)).alias("mirrored"), F.exists("embedding", lambda x: x > 0.3).alias("strong"), total(F.transform(e, F.abs)).alias("size"))


@R.query("""SELECT o_orderkey, 2 * o_totalprice AS doubled, '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS json FROM orders""")
def maps_and_json(spark, sf_dir):
    doubled = F.transform_values(F.create_map(F.col("o_orderstatus"), F.col("o_totalprice")), lambda k, v: 2 * v)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(doubled, F.col("o_orderstatus")).alias("doubled"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("json"))


@R.query("SELECT p_partkey, unnest(['size', 'price']) AS what, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part")
def inlined(spark, sf_dir):
    rows = F.array(F.struct(F.lit("size").alias("what"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("price").alias("what"), F.col("p_retailprice").alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(rows))


@R.query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def most_frequent(spark, sf_dir):
    """The mode, ties to the smaller value: by counts that combine before the shuffle."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("best")).select("user_id", "best.event_type")


@R.query()
def frequent_items(spark, sf_dir):
    """Frequent items and quantiles by sketches of fixed size."""
    views(spark, sf_dir, "events")
    return spark.sql("SELECT approx_top_k(user_id, 5) AS users, kll_sketch_get_quantile_double(kll_sketch_agg_double(value), 0.5D) AS median, count(*) AS n FROM events")


@R.query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_orderstatus")
def scripted(spark, sf_dir):
    """An SQL script with a variable."""
    views(spark, sf_dir, "orders")
    return spark.sql("""BEGIN
        DECLARE bound DOUBLE;
        SET bound = (SELECT avg(o_totalprice) FROM orders);
        SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > bound GROUP BY o_orderstatus;
    END""")


@R.query("SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def table_function(spark, sf_dir):
    """An SQL table function, joined laterally."""
    views(spark, sf_dir, "nation", "customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rich_of(nation INT) RETURNS TABLE (c_custkey BIGINT) RETURN SELECT c_custkey FROM customer WHERE c_nationkey = nation AND c_acctbal > 9000")
    return spark.sql("SELECT n_name, r.c_custkey FROM nation, LATERAL rich_of(n_nationkey) AS r")
