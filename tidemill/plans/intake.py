"""Items, runs, names, standings and evaluations as they come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import intake
from tidemill.plans.registry import query
from tidemill.session import table
from tidemill.sources import adapters


@query("""
WITH k AS (SELECT c_custkey AS k, c_custkey % 8 AS c FROM customer)
SELECT k, CASE c WHEN 1 THEN '' WHEN 2 THEN repeat('long ', 41)[:-2] ELSE 'Title & more' END AS title, CASE WHEN c NOT IN (3, 4) THEN 'https://news.example.com/a/' || k END AS url, CASE WHEN c NOT IN (5, 6) THEN 1704164645 + k - CASE WHEN c = 7 THEN 32400 ELSE 0 END END::BIGINT AS at,
 CASE c WHEN 0 THEN 'no-source' WHEN 1 THEN 'no-title' WHEN 2 THEN 'title-too-long' WHEN 3 THEN 'bad-link' WHEN 4 THEN 'bad-link' WHEN 5 THEN 'no-date' WHEN 6 THEN 'no-date' END AS reason FROM k
""")
def item_reasons(spark, sf_dir):
    k = F.col("c_custkey")
    c = k % 8
    at = F.timestamp_seconds(F.lit(1_704_164_645) + k)
    rows = table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(c == 1, " \u0007\n ").when(c == 2, F.repeat(F.lit("long "), 41)).otherwise("Title &amp; more").alias("title"),
        F.when(c == 3, "ftp://x.org/a").when(c == 4, "https:///a").otherwise(F.concat(F.lit(" https://news.example.com/a/"), k, F.lit("?utm_source=x"))).alias("link"),
        F.when(c == 5, F.lit(None)).when(c == 6, "soon").when(c == 7, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+09:00'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published"),
        F.lit(None).cast("string").alias("summary"), F.when(c == 0, " ").otherwise("s").alias("source"), F.lit("UTC").alias("zone"),
    )
    # the summary carries the number of an item
    out = intake.normalised(rows.withColumn("summary", F.col("k").cast("string")))
    return out.select(F.col("summary").cast("long").alias("k"), "title", "url", F.unix_timestamp("at").alias("at"), "reason")


@query("""
WITH r AS (SELECT user_id AS run, count(*) FILTER (value > 80) > 0 AS ok, min(event_type) AS least FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT run, run % 5 <> 0 AND run % 7 <> 0 AND least <> 'error' AND ok AS published FROM r
""")
def published_runs(spark, sf_dir):
    """Users as runs, their events as sources."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.collect_list(F.struct((F.col("value") > 80).alias("ok"))).alias("sources"), F.min("event_type").alias("least"))
    k = F.col("run")
    status = F.when(F.col("least") == "error", "failed").when(k % 2 == 0, "success").otherwise("partial")
    return runs.select("run", intake.published(F.when(k % 5 == 0, "test").otherwise("prod"), F.when(k % 7 == 0, "brief").otherwise("collect"), status, F.col("sources")).alias("published"))


@query("""
WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Zoë-' || 'Lee ' || s_nationkey WHEN 1 THEN 'zoe LEE ' || s_nationkey WHEN 2 THEN 'Z. Lee' ELSE NULL END AS written, s_suppkey % 3 AS ord, s_name AS shown FROM supplier),
k AS (SELECT id, ord, shown, trim(regexp_replace(strip_accents(lower(written)), '[\\s.,-]+', ' ', 'g')) AS key FROM n WHERE written IS NOT NULL AND written <> 'Z. Lee' AND s_two(written))
SELECT key, arg_min(shown, (ord, id)) AS shown, min((ord, id)).id AS id FROM k GROUP BY key
""".replace(" AND s_two(written)", " AND length(regexp_extract(written, '[0-9]+$')) > 1").replace("min((ord, id)).id", "arg_min(id, (ord, id))"))
def display_names(spark, sf_dir):
    k = F.col("s_suppkey")
    written = F.when(k % 4 == 0, F.concat(F.lit("Zoë-Lee "), "s_nationkey")).when(k % 4 == 1, F.concat(F.lit("zoe LEE "), "s_nationkey")).when(k % 4 == 2, "Z. Lee")
    return intake.display_index(table(spark, sf_dir, "supplier").select(k.alias("id"), written.alias("written"), F.col("s_name").alias("shown"), (k % 3).alias("ord")))


PLACES = """p AS (SELECT c_nationkey % 3 AS competition, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_acctbal DESC, c_custkey)::INT AS pos, c_custkey % 9 AS w, c_custkey % 5 AS d, c_custkey % 4 AS l FROM customer)"""


def standing_records(spark, sf_dir):
    """A record for each of three competitions: customers as teams, one in eleven unknown."""
    from tidemill.operators.windows import positions

    c = table(spark, sf_dir, "customer").withColumn("competition", F.col("c_nationkey") % 3)
    k = F.col("c_custkey")
    place = positions(c, ["competition"], [F.desc("c_acctbal"), F.col("c_custkey")]).withColumn("position", (F.col("_i") + 1).cast("int"))
    line = F.struct("position", F.struct(k.alias("id"), F.col("c_name").alias("name")).alias("team"), (k % 9 + k % 5 + k % 4 + F.when(k % 50 == 0, 1).otherwise(0)).alias("playedGames"), (k % 9).alias("won"), (k % 5).alias("draw"), (k % 4).alias("lost"), (k % 30).alias("goalsFor"), (k % 20).alias("goalsAgainst"), (k % 9 * 3 + k % 5 - F.when(k % 70 == 0, 6).otherwise(0)).alias("points"))
    tables = place.groupBy("competition").agg(F.array_sort(F.collect_list(line)).alias("table"))
    record = F.to_json(F.struct(F.array(F.struct(F.lit("TOTAL").alias("type"), "table"), F.struct(F.lit("HOME").alias("type"), "table")).alias("standings")))
    teams = c.where(k % 11 != 0).select(k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("slug"))
    zones = spark.createDataFrame([(x, a, b, z) for x in (0, 1, 2) for a, b, z in ((1, 4, "top"), (3, 6, "cup"), (100, 120, "down"))], "competition int, `from` int, `to` int, zone string")
    return adapters.standing_rows(tables.select(F.col("competition").cast("int").alias("competition"), record.alias("json")), "json", "competition", teams, zones)


@query(f"""
WITH {PLACES} SELECT competition, pos, 't' || id AS team, w + d + l + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS played, w, d, l, id % 30 AS gf, id % 20 AS ga, w * 3 + d - CASE WHEN id % 70 = 0 THEN 6 ELSE 0 END AS pts,
 CASE WHEN pos <= 4 THEN 'top' WHEN pos <= 6 THEN 'cup' WHEN pos BETWEEN 100 AND 120 THEN 'down' END AS zone, CASE WHEN id % 50 = 0 THEN 'games' WHEN id % 70 = 0 THEN 'points' END AS problem FROM p WHERE id % 11 <> 0
""")
def standings_adapter(spark, sf_dir):
    return standing_records(spark, sf_dir)[0]


@query(f"WITH {PLACES} SELECT competition, id, 'Customer#' || lpad(id::VARCHAR, 9, '0') AS name, 1::BIGINT AS rows FROM p WHERE id % 11 = 0".replace(" AS rows", ' AS "rows"'))
def standings_unmatched(spark, sf_dir):
    return standing_records(spark, sf_dir)[1]


@query("""
WITH e AS (SELECT o_orderdate::DATE AS day, o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 > 0), f AS (SELECT o_orderdate::DATE AS day, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 > 0),
j AS (SELECT coalesce(e.day, f.day) AS day, e.k AS ek, f.k AS fk, e.v AS ev, f.v AS fv FROM e FULL JOIN f ON e.day = f.day AND e.k = f.k),
c AS (SELECT day, count(*) FILTER (ev = fv) AS "right", count(*) FILTER (ev <> fv) AS wrong, count(*) FILTER (fk IS NULL) AS missing, count(*) FILTER (ek IS NULL) AS extra FROM j GROUP BY day)
SELECT day::VARCHAR AS day, "right", wrong, missing, extra, "right" / nullif("right" + wrong + extra, 0) AS precision, "right" / nullif("right" + wrong + missing, 0) AS recall FROM c
""")
def golden_days(spark, sf_dir):
    """A replay of each day's orders: some left out, some with another status."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), k.alias("k"), F.col("o_orderstatus").alias("value"))
    return intake.evaluation(o.where("k % 7 > 0"), o.where("k % 4 > 0").withColumn("value", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("value"))), ["k"])
