"""Runs, their log lines and a record for each day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import observations
from tidemill.operators.observations import Fact
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query

#: What lines tell of a run.
FACTS = (Fact("errors", r"^error\b", "count"), Fact("total", r'"k":\s*([0-9]+)', "sum"), Fact("largest", r'"k":\s*([0-9]+)', "max"), Fact("first_kind", r"^([a-z]+) ", "first"), Fact("last_kind", r"^([a-z]+) ", "last"), Fact("none", r"never (x)", "last"))

STITCHED = """
r AS (SELECT event_id AS run, user_id % 3 AS job, ts AS started, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 20 MINUTE END AS ended, value > 5 AS ok FROM events WHERE event_type = 'signup'),
f AS (SELECT *, row_number() OVER (PARTITION BY started ORDER BY run DESC) AS n FROM r), l AS (SELECT event_id AS line, ts, event_type || ' ' || props AS text, props FROM events WHERE event_type <> 'signup'),
j AS (SELECT line, ts, text, props, CASE WHEN ended IS NULL OR ts <= ended THEN run END AS run FROM l ASOF LEFT JOIN (SELECT * FROM f WHERE n = 1) g ON l.ts >= g.started)"""


def log(spark, sf_dir):
    """(lines, runs) of one log: every sign-up begins a run, all other events are lines."""
    e = instants(spark, sf_dir)
    runs = e.where("event_type = 'signup'").select(F.lit("log").alias("key"), F.col("event_id").alias("run"), (F.col("user_id") % 3).alias("job"), F.col("ts").alias("started"), F.when(F.col("event_id") % 4 == 0, F.timestamp_micros(F.unix_micros("ts") + 1_200_000_000)).alias("ended"), (F.col("value") > 5).alias("ok"))
    lines = e.where("event_type <> 'signup'").select(F.lit("log").alias("key"), F.col("event_id").alias("line"), "ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    return lines, runs


@query(f"WITH {STITCHED} SELECT line, run FROM j")
def stitched_lines(spark, sf_dir):
    lines, runs = log(spark, sf_dir)
    return observations.stitched(lines, runs, "key", "ts", "started", "ended", "run").select("line", "run")


@query(f"""
WITH {STITCHED}, k AS (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS n, split_part(text, ' ', 1) AS kind FROM j WHERE run IS NOT NULL)
SELECT run, count(*) FILTER (kind = 'error') AS errors, sum(n) AS total, max(n) AS largest, arg_min(kind, (ts, kind)) AS first_kind, arg_max(kind, ts) AS last_kind, NULL::VARCHAR AS "none", count(*) AS lines FROM k GROUP BY run
""")
def run_facts(spark, sf_dir):
    lines, runs = log(spark, sf_dir)
    return observations.facts(observations.stitched(lines, runs, "key", "ts", "started", "ended", "run"), "run", "ts", "text", FACTS)


@query(f"""
WITH {STITCHED}, k AS (SELECT run, count(*) FILTER (text LIKE 'error %') AS errors, sum(regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE) AS total FROM j WHERE run IS NOT NULL GROUP BY run),
d AS (SELECT unnest(range(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day), p AS (SELECT started::DATE AS day, job, ok, k.run AS told, errors, total FROM r LEFT JOIN k USING (run)),
s AS (SELECT day, count(*) AS runs, count(DISTINCT job) AS jobs, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (told IS NULL) AS silent, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(total), 0) AS total FROM p GROUP BY day)
SELECT day::VARCHAR AS day, coalesce(runs, 0) AS runs, coalesce(jobs, 0) AS jobs, coalesce(failed, 0) AS failed, coalesce(silent, 0) AS silent, coalesce(errors, 0) AS errors, coalesce(total, 0) AS total, CASE WHEN runs IS NULL THEN 'missing' WHEN failed = runs THEN 'bad' ELSE 'good' END AS state FROM d LEFT JOIN s USING (day)
""")
def observation_days(spark, sf_dir):
    lines, runs = log(spark, sf_dir)
    told = observations.facts(observations.stitched(lines, runs, "key", "ts", "started", "ended", "run"), "run", "ts", "text", FACTS)
    day = lambda s: F.lit(s).cast("date")
    return observations.day_records(runs, told, "run", "job", "started", "ok", ["errors", "total"], day("2023-12-30"), day("2024-02-01")).withColumn("day", F.col("day").cast("string"))
