"""Composed views: what a page shows, from several operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import aggregate, windows
from tidemill.plans.calendar import instants
from tidemill.plans.ranking import orders
from tidemill.plans.registry import query
from tidemill.plans.relations import SIDES, sides
from tidemill.session import table


@query(f"""
WITH {SIDES}, t AS (SELECT team, 3 * count(*) FILTER (result = 'W') + count(*) FILTER (result = 'D') AS pts, (sum(gf) - sum(ga))::BIGINT AS gd, sum(gf)::BIGINT AS gf FROM r GROUP BY team), p AS (SELECT *, row_number() OVER (ORDER BY pts DESC, gd DESC, gf DESC, team)::INT AS pos FROM t),
f AS (SELECT team, string_agg(result, '' ORDER BY kickoff, l_orderkey, l_linenumber, venue) AS form FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, l_orderkey DESC, l_linenumber DESC, venue DESC) AS rn FROM r) WHERE rn <= 5 GROUP BY team)
SELECT pos, n_name AS name, pts, form, CASE WHEN pos <= 4 THEN 'champions' WHEN pos <= 6 THEN 'cup' WHEN pos >= 23 THEN 'relegation' END AS zone FROM p JOIN f USING (team) JOIN nation ON n_nationkey = team
""")
def standings_view(spark, sf_dir):
    rows = sides(spark, sf_dir)
    t = aggregate.standings(rows).withColumn("gd", F.col("gf") - F.col("ga"))
    t = t.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "team")))
    form = windows.last_list(rows, ["team"], ["kickoff", "l_orderkey", "l_linenumber", "venue"], "result", 5)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("name"))
    zone = F.when(F.col("pos") <= 4, "champions").when(F.col("pos") <= 6, "cup").when(F.col("pos") >= 23, "relegation")
    return t.join(form, "team").join(names, "team").select("pos", "name", "pts", F.array_join("result", "").alias("form"), zone.alias("zone"))


@query("""
WITH d AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY))::DATE AS day), e AS (SELECT ts::DATE AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, min(ts) FILTER (event_type = 'purchase') AS first_ok FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, CASE WHEN first_ok IS NULL THEN 'missed' WHEN first_ok <= day + INTERVAL 6 HOUR THEN 'ontime' ELSE 'late' END AS state FROM d LEFT JOIN e USING (day)
""")
def status_view(spark, sf_dir):
    spine = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("day"))
    e = instants(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok"))
    due = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + 6 * 3600)
    state = F.when(F.col("ok").isNull(), "missed").when(F.col("ok") <= due, "ontime").otherwise("late")
    return spine.join(e, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failed", F.lit(0)).alias("failed"), state.alias("state"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate)::DATE::VARCHAR AS last FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n, last, count(*) OVER (PARTITION BY c_mktsegment) AS group_size FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def roster_view(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.to_date(F.max("at")).cast("string").alias("last"))
    sizes = c.groupBy("c_mktsegment").agg(F.count("*").alias("group_size"))
    return c.join(o, "c_custkey", "left").join(sizes, "c_mktsegment").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), "last", "group_size")


@query("""
WITH e AS (SELECT user_id % 20 AS follower, user_id, ts::DATE AS day FROM events WHERE event_type = 'view'), f AS (SELECT user_id, day, string_agg(DISTINCT follower::VARCHAR, ',' ORDER BY follower::VARCHAR) AS followers, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, day::VARCHAR AS day, followers, n FROM f
""")
def follow_board(spark, sf_dir):
    e = instants(spark, sf_dir).where("event_type = 'view'").select((F.col("user_id") % 20).cast("string").alias("follower"), "user_id", F.to_date("ts").cast("string").alias("day"))
    return e.groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_set("follower")), ",").alias("followers"), F.count("*").alias("n"))


@query("SELECT page_id, '{\"@type\":\"WebPage\",\"id\":' || page_id || ',\"url\":\"' || url || '\"}' AS node FROM pages")
def structured_data(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.col("page_id").alias("id"), "url")).alias("node"))


@query("""
WITH w AS (SELECT unnest([0.5, 1.0, 2.0]) AS w), s AS (SELECT w::DOUBLE AS weight, o_orderkey, w * (o_totalprice > 150000)::INT * 3 + (o_orderpriority = '1-URGENT')::INT * 2 AS score FROM orders, w), r AS (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY score DESC, o_orderkey) AS rn FROM s)
SELECT weight, o_orderkey, score::DOUBLE AS score FROM r WHERE rn <= 10
""")
def weight_what_if(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in (0.5, 1.0, 2.0)])))
    score = F.col("weight") * (F.col("o_totalprice") > 150000).cast("int") * 3 + (F.col("o_orderpriority") == "1-URGENT").cast("int") * 2
    return windows.top(rows.withColumn("score", score), ["weight"], [F.desc("score"), F.col("o_orderkey")], 10).select("weight", "o_orderkey", "score")
