"""Scalar functions on strings, times, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import day_of_week, kurtosis_sample, logarithm, ratio, rounded, skewness_sample, truncated
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()


@R.query("""SELECT c_custkey, upper(c_mktsegment) || '-' || right(c_name, 4) AS tag, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS code, split_part(c_name, '#', 2) AS number, CAST(length(c_name) AS BIGINT) AS n,
    translate(c_mktsegment, 'AEIOU', 'aeiou') AS soft, regexp_replace(c_name, '[0-9]', 'x', 'g') AS masked, regexp_extract(c_name, '([0-9]+)', 1) AS digits, reverse(c_mktsegment) AS back, CAST(levenshtein(c_mktsegment, 'BUILDINGS') AS BIGINT) AS far, replace(c_mktsegment, 'IN', '_') AS swapped FROM customer""")
def strings(spark, sf_dir):
    s, name = F.col("c_mktsegment"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.upper(s), F.lit("-"), F.right(name, F.lit(4))).alias("tag"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("code"), F.split_part(name, F.lit("#"), F.lit(2)).alias("number"),
        F.length(name).cast("long").alias("n"), F.translate(s, "AEIOU", "aeiou").alias("soft"), F.regexp_replace(name, "[0-9]", "x").alias("masked"), F.regexp_extract(name, "([0-9]+)", 1).alias("digits"),
        F.reverse(s).alias("back"), F.levenshtein(s, F.lit("BUILDINGS")).cast("long").alias("far"), F.replace(s, F.lit("IN"), F.lit("_")).alias("swapped"),
    )


@R.query("SELECT s_suppkey, md5(s_name) AS md5, sha256(s_name) AS sha, base64(encode(s_name)) AS b64, hex(s_name) AS hex FROM supplier")
def hashes(spark, sf_dir):
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(name).alias("md5"), F.sha2(name, 256).alias("sha"), F.base64(name.cast("binary")).alias("b64"), F.hex(name).alias("hex"))


@R.query("""SELECT o_orderkey, CAST(extract('year' FROM o_orderdate) AS BIGINT) AS y, CAST(extract('quarter' FROM o_orderdate) AS BIGINT) AS q, CAST(extract('dow' FROM o_orderdate) AS BIGINT) AS dow, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS ends, strftime(o_orderdate, '%Y/%m') AS label, CAST(CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS due FROM orders""")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), day_of_week(d).alias("dow"), truncated("month", d).alias("month"),
        F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.last_day(d).cast("string").alias("ends"), F.date_format(d, "yyyy/MM").alias("label"), F.add_months(d, 3).cast("string").alias("due"),
    )


@R.query("""SELECT event_id, round(ln(value), 9) AS ln, round(log10(value), 9) AS lg, CAST(floor(value) AS BIGINT) % 7 AS m, round(sqrt(value), 9) AS root, CAST(sign(value - 50) AS BIGINT) AS s, round(pow(value, 1.5), 4) AS p, greatest(value, 20) AS g,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE round(value / (user_id % 5), 6) END AS per FROM events""")
def numbers(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", rounded(logarithm(v), 9).alias("ln"), rounded(logarithm(v, F.log10), 9).alias("lg"), (F.floor(v) % 7).alias("m"), rounded(F.sqrt(v), 9).alias("root"), F.signum(v - 50).cast("long").alias("s"),
        rounded(F.pow(v, F.lit(1.5)), 4).alias("p"), F.greatest(v, F.lit(20.0)).alias("g"), rounded(ratio(v, F.col("user_id") % 5), 6).alias("per"),
    )


@R.query("SELECT event_type, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM events GROUP BY event_type")
def sample_moments(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(skewness_sample(v), 6).alias("skew"), F.round(kurtosis_sample(v), 6).alias("kurt"))


@R.query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive,
    round(CAST(list_sort(embedding)[1] AS DOUBLE), 6) AS least, CAST(len(embedding[3:10]) AS BIGINT) AS part FROM embeddings""")
def arrays(spark, sf_dir):
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(norm, 6).alias("norm"), F.round(F.array_max(e).cast("double"), 6).alias("most"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(F.element_at(F.array_sort(e), 1).cast("double"), 6).alias("least"), F.size(F.slice(e, 3, 8)).cast("long").alias("part"),
    )


@R.query("""SELECT user_id, 'view' AS kind, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id UNION ALL SELECT user_id, 'click', count(*) FROM events WHERE event_type = 'click' GROUP BY user_id""")
def maps(spark, sf_dir):
    """Counts by user as a map, filtered and taken apart again."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by_user = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    some = F.map_filter("m", lambda k, _: k.isin("view", "click"))
    return by_user.select("user_id", F.explode(some).alias("kind", "n"))


@R.query("SELECT vec_id, CAST(p AS INTEGER) AS pos, round(CAST(embedding[p + 1] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS p) WHERE label = 3")
def generators(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@R.query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def json_fields(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"), F.get_json_object("props", "$.k").alias("k"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count_distinct("k").alias("kinds"))


@R.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def variant_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return rows.where("k > 50")


@R.query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


@R.query("SELECT doc_id, length(text) AS n, lang AS lang FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'E500' WHEN 'fr' THEN 'F600' WHEN 'de' THEN 'D000' ELSE 'E200' END AS lang FROM documents)")
def soundex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.soundex("lang").alias("lang"))


@R.query("""SELECT s_suppkey, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s_name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc FROM supplier""")
def checksums(spark, sf_dir):
    """Cyclic checksums; in SQL bit by bit."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.crc32(F.col("s_name").cast("binary")).alias("crc"))
