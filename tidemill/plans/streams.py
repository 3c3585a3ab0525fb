"""The incremental operators over the events as a file stream; their results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.registry import query
from tidemill.plans.relations import STARTS, VERDICT, now, starts
from tidemill.session import table
from tidemill.streaming import keyed, state


def event_stream(spark, sf_dir):
    """The table events, read as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, epoch_us(min(ts))::BIGINT AS first_at FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY".replace("HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY", "HAVING epoch(date_trunc('second', max(ts))) >= (SELECT epoch(date_trunc('second', max(ts))) FROM events) - 259200"))
def stream_first_seen(spark, sf_dir):
    out = state.first_seen_stream(event_stream(spark, sf_dir), "user_id", "ts", 3)
    return out.select("user_id", F.unix_micros("first").alias("first_at"))


@query(f"SELECT event_type, verdict, count(*) AS n FROM (SELECT event_type, {VERDICT} AS verdict FROM events JOIN {STARTS} USING (event_type)) GROUP BY ALL")
def stream_verdicts(spark, sf_dir):
    return state.verdict_stream(event_stream(spark, sf_dir), starts(spark), "event_type", "ts", now())


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    once = state.dedup_stream(event_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"], "ts", "90 days")
    return state.stream_to_table(once, "dedup").select("user_id")


@query("""
WITH p AS (SELECT user_id AS id, count(*) FILTER (event_type = 'error')::INT % 4 AS retries FROM events GROUP BY 1), t AS (SELECT user_id AS id, bool_or(event_type = 'purchase') AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT id, retries + (ok IS NOT NULL)::INT AS retries, retries + (ok IS NOT NULL)::INT > 3 AS dropped FROM p LEFT JOIN t USING (id) WHERE NOT coalesce(ok, false)
""")
def pending_retries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pending = e.groupBy(F.col("user_id").alias("id")).agg((F.count_if(F.col("event_type") == "error") % 4).cast("int").alias("retries"))
    tried = e.where("ts >= '2024-01-29'").select(F.col("user_id").alias("id"), (F.col("event_type") == "purchase").alias("ok"))
    left, dropped = state.pending_retries(pending, tried, 3)
    return left.withColumn("dropped", F.lit(False)).unionByName(dropped.drop("reason").withColumn("dropped", F.lit(True))).select("id", "retries", "dropped")


@query("""
WITH e AS (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'view'), top AS (SELECT max(ts) AS top FROM e),
g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 DAY THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT user_id, max(run) AS last FROM r GROUP BY 1), l AS (SELECT user_id, min(ts) AS first, max(ts) AS newest FROM r JOIN k USING (user_id) WHERE run = last GROUP BY 1)
SELECT user_id, epoch(first)::BIGINT AS first_at, epoch(newest)::BIGINT AS newest_at, newest + INTERVAL 2 DAY <= top AS expired FROM l, top
""")
def stream_timed_keys(spark, sf_dir):
    """Users without views, forgotten two days after their last event; the timers fire as the watermark passes."""
    e = event_stream(spark, sf_dir).where("event_type <> 'view'").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    now = keyed.latest(keyed.first_seen(e, "user_id", "ts", 2), ["user_id"])
    return now.select("user_id", F.unix_timestamp("first").alias("first_at"), F.unix_timestamp("newest").alias("newest_at"), (F.col("state") == "expired").alias("expired"))


@query("""
WITH e AS (SELECT user_id, date_trunc('second', ts) AS ts, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, ok) AS i FROM e),
f AS (SELECT user_id, i, count(*) FILTER (ok) OVER w AS done, ok FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT user_id, i, ok, row_number() OVER (PARTITION BY user_id, coalesce(done, 0), ok ORDER BY i) AS nth FROM f),
l AS (SELECT user_id, arg_max(ok, i) AS ok, arg_max(nth, i) AS nth, max(i) AS last FROM n GROUP BY 1)
SELECT user_id, CASE WHEN NOT ok AND nth % 4 > 0 THEN nth % 4 ELSE 0 END AS waiting FROM l
""")
def stream_retries(spark, sf_dir):
    """Users whose last event of the two is an error: their tries since the last purchase, dropped past three."""
    e = event_stream(spark, sf_dir).where("event_type IN ('error', 'purchase')").select("user_id", F.date_trunc("second", "ts").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    users = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").select("user_id").distinct()
    last = keyed.latest(keyed.retries(e, "user_id", "ts", "ok", 3, 400), ["user_id"])
    return users.join(last, "user_id", "left").select("user_id", F.when(F.col("state") == "pending", F.col("tries")).otherwise(0).alias("waiting"))
