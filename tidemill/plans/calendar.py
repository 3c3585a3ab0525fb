"""Date and time queries. The tables' local times are read as UTC."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.plans.registry import query
from tidemill.session import table

ZONE = "Asia/Seoul"


def instants(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, extract(hour FROM ts + INTERVAL 9 HOUR)::INT AS hour FROM events")
def zoned_parts(spark, sf_dir):
    ts = F.col("ts")
    return instants(spark, sf_dir).select("event_id", dates.local_date(ts, ZONE).cast("string").alias("day"), dates.local_month(ts, ZONE).alias("month"), F.hour(F.from_utc_timestamp(ts, ZONE)).alias("hour"))


@query("""
SELECT DISTINCT ts::DATE::VARCHAR AS day, epoch(ts::DATE - INTERVAL 9 HOUR)::BIGINT AS opens, epoch(ts::DATE + INTERVAL 15 HOUR)::BIGINT AS closes,
       epoch(ts::DATE + INTERVAL 13 HOUR)::BIGINT AS night_from, epoch(ts::DATE + INTERVAL 22 HOUR)::BIGINT AS night_to FROM events
""")
def day_ranges(spark, sf_dir):
    days = instants(spark, sf_dir).select(F.to_date("ts").alias("d")).distinct()
    sec = lambda c: F.unix_timestamp(c)
    a, b = dates.day_range(F.col("d"), ZONE)
    c, e = dates.overnight_range(F.col("d"), 22, 7, ZONE)
    return days.select(F.col("d").cast("string").alias("day"), sec(a).alias("opens"), sec(b).alias("closes"), sec(c).alias("night_from"), sec(e).alias("night_to"))


@query("SELECT strftime(o_orderdate, '%G-%V') AS week, count(*) AS n FROM orders GROUP BY 1")
def iso_weeks(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(dates.iso_week(F.to_date("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query("""
WITH y AS (SELECT o_orderkey, o_orderdate AS t, year(o_orderdate) AS y FROM orders),
b AS (SELECT *, make_date(y, 3, 31) - dayofweek(make_date(y, 3, 31))::INT AS spring, make_date(y, 10, 31) - dayofweek(make_date(y, 10, 31))::INT AS autumn FROM y)
SELECT o_orderkey, t >= spring + INTERVAL 1 HOUR AND t < autumn + INTERVAL 1 HOUR AS summer FROM b
""")
def eu_summer_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.is_eu_summer(F.col("o_orderdate").cast("timestamp")).alias("summer"))


@query("""
SELECT c_custkey AS o_custkey, min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, len(range(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS days
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def day_spine(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    span = o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return span.select("o_custkey", F.col("a").cast("string").alias("first"), F.col("b").cast("string").alias("last"), F.size(dates.days_between(F.col("a"), F.col("b"))).cast("long").alias("days"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS at FROM events")
def compact_utc(spark, sf_dir):
    text = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    return instants(spark, sf_dir).select("event_id", F.unix_timestamp(dates.compact_utc(text)).alias("at"))


@query("SELECT event_id, (epoch(date_trunc('second', ts)) - CASE event_id % 3 WHEN 0 THEN 32400 WHEN 1 THEN 0 ELSE -18000 END)::BIGINT AS at FROM events")
def feed_dates(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "d MMM yyyy HH:mm:ss '+0900'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("Tue, "), F.date_format("ts", "d MMM yyyy HH:mm:ss 'EST'")))
    return instants(spark, sf_dir).select("event_id", F.unix_timestamp(dates.feed_date(text, F.lit(None).cast("string"))).alias("at"))


@query("""
SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN m // 60 || ' h' ELSE m // 1440 || ' d' END AS ago
FROM (SELECT event_id, floor((epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts))) / 60)::BIGINT AS m FROM events)
""")
def relative_times(spark, sf_dir):
    return instants(spark, sf_dir).select("event_id", dates.relative(F.col("ts"), F.lit("2024-01-31").cast("timestamp")).alias("ago"))


WINDOWS = "(VALUES (TIMESTAMP '1993-01-01', TIMESTAMP '1993-02-01'), (TIMESTAMP '1993-07-01', TIMESTAMP '1993-09-01'), (TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-15')) w(opens, closes)"


@query(f"""
SELECT o_orderkey, EXISTS (SELECT 1 FROM {WINDOWS} WHERE o_orderdate >= opens AND o_orderdate < closes)
  OR coalesce(o_orderdate < (SELECT max(closes) FROM {WINDOWS} WHERE closes <= o_orderdate) + INTERVAL 24 HOUR, false) AS active FROM orders
""")
def transfer_window(spark, sf_dir):
    spans = [("1993-01-01", "1993-02-01"), ("1993-07-01", "1993-09-01"), ("1995-01-01", "1995-01-15")]
    t = F.col("o_orderdate").cast("timestamp")
    active = F.lit(False)
    for a, b in spans:  # a season's windows are a handful of literals; grace lasts a day after each close
        active = active | ((t >= F.lit(a).cast("timestamp")) & (F.unix_timestamp(t) < F.unix_timestamp(F.lit(b).cast("timestamp")) + 86400))
    return table(spark, sf_dir, "orders").select("o_orderkey", active.alias("active"))


@query("SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, count(*) AS n, min(o_orderdate::DATE + 30)::VARCHAR AS due FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def shift_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    return rows.groupBy(F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days")).agg(F.count("*").alias("n"), F.date_add(F.min(F.to_date("o_orderdate")), 30).cast("string").alias("due"))
