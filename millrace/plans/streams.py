"""Streaming queries, each run to the end of what is there and returned as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import Registry
from millrace.sources import scratch
from millrace.streaming import events, finished
from millrace.streaming.stateful import first_seen, rocksdb, visits

R = Registry()


def plain(c: str):
    return F.col(c).cast("timestamp_ntz")


@R.query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def stream_totals(spark, sf_dir):
    """Running totals in complete mode."""
    return finished(events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users")), "complete")


@R.query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    """Days that the watermark has passed, in append mode."""
    counts = events(spark, sf_dir, "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return finished(counts).select(plain("window.start").alias("day"), "event_type", "n")


@R.query("""SELECT CAST(s AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s""")
def stream_sliding(spark, sf_dir):
    """Windows of two days that begin each day, complete."""
    counts = events(spark, sf_dir).groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    return finished(counts, "complete").select(plain("window.start").alias("start"), "n")


@R.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Sessions with gaps of six hours, complete."""
    counts = events(spark, sf_dir).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return finished(counts, "complete").select("user_id", plain("session_window.start").alias("start"), "n")


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The first event of each user and type; the watermark bounds the state by the whole span of the data."""
    rows = events(spark, sf_dir, "365 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return finished(rows.select("user_id", "event_type"))


@R.query("""SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR""")
def stream_stream_join(spark, sf_dir):
    """Purchases within an hour after a click; both watermarks bound the state."""
    rows = events(spark, sf_dir, "2 hours")
    clicks = rows.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    bought = events(spark, sf_dir, "2 hours").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    joined = clicks.join(bought, F.expr("u = user_id and bought >= clicked and bought <= clicked + interval 1 hour"))
    return finished(joined.select("click", "purchase"))


@R.query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_custom_state(spark, sf_dir):
    """Count and maximum by user in state of one's own; the last state of each user counts."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        n, most = state.get if state.exists else (0, float("-inf"))
        for pdf in frames:
            n, most = n + len(pdf), max(most, float(pdf["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    rows = events(spark, sf_dir).select("user_id", "value").groupBy("user_id")
    out = rows.applyInPandasWithState(update, "user_id long, n long, most double", "n long, most double", "update", GroupStateTimeout.NoTimeout)
    return finished(out, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("most").alias("most"))


@R.query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_foreach_batch(spark, sf_dir):
    """Each micro-batch is written by a function; its number makes a repeated batch overwrite itself."""
    path = scratch(spark)
    rows = events(spark, sf_dir).select("event_type")
    finished(rows, each=lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_restarted_with_late_rows(spark, sf_dir):
    """A stream that is stopped, then goes on from its checkpoint with copies of the first days' rows: behind the
    watermark, they are left out and change nothing."""
    source, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    late = rows.join(F.broadcast(rows.agg(F.min("ts").alias("begin"))), F.col("ts") < F.col("begin") + F.expr("interval 2 days")).drop("begin")
    for part in (rows, late):
        part.write.mode("append").parquet(source)
        counts = events(spark, sf_dir, "1 hour", source).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
        found = finished(counts, path=out, checkpoint=checkpoint)
    return found.select(plain("window.start").alias("day"), "n")


@R.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, CAST(k AS BIGINT) AS number, min(ts) AS begins, max(ts) AS ends, count(*) AS n, coalesce(string_agg(event_id, ',' ORDER BY ts) FILTER (WHERE event_type = 'purchase'), '') AS purchases
    FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_visits(spark, sf_dir):
    """Visits that an event-time timer closes after six idle hours: state in a map, a list and a value, in RocksDB."""
    rows = events(spark, sf_dir, "1 hour").withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    with rocksdb(spark):
        found = finished(visits(rows, "user_id", "ts", "purchase", 6 * 3600))
    return found.select("user_id", "number", plain("begins").alias("begins"), plain("ends").alias("ends"), "n", F.col("marked").alias("purchases"))


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    """The first row of each user and type, by state that expires a day after it was last written."""
    with rocksdb(spark, clock=True):
        return finished(first_seen(events(spark, sf_dir), ["user_id", "event_type"], 86400))
