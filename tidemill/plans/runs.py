"""Runs, gates, scopes, slots and names on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import dates, text, urls
from tidemill.operators import aggregate, cards, checks, cluster, keywords
from tidemill.plans.calendar import instants
from tidemill.plans.matches import orders
from tidemill.plans.registry import query
from tidemill.session import table


def _last_sunday(month: int) -> str:
    return f"(make_date(year(t), {month}, 31) - (isodow(make_date(year(t), {month}, 31)) % 7)::INT)::TIMESTAMP"


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 10 YEAR + INTERVAL 30 MINUTE * (1 + o_orderkey % 4) AS t FROM orders),
z AS (SELECT *, {_last_sunday(3)} AS spring, {_last_sunday(10)} AS autumn FROM o),
k AS (SELECT *, t >= spring + INTERVAL 1 HOUR AND t < spring + INTERVAL 2 HOUR AS gap, t >= autumn + INTERVAL 1 HOUR AND t < autumn + INTERVAL 2 HOUR AS twice, t >= spring + INTERVAL 2 HOUR AND t < autumn + INTERVAL 1 HOUR AS summer FROM z)
SELECT o_orderkey, epoch(CASE WHEN summer OR twice THEN t - INTERVAL 1 HOUR ELSE t END)::BIGINT AS instant, epoch(CASE WHEN summer OR gap OR twice THEN t - INTERVAL 1 HOUR ELSE t END)::BIGINT AS earlier,
       epoch(CASE WHEN summer THEN t - INTERVAL 1 HOUR ELSE t END)::BIGINT AS later, CASE WHEN NOT gap AND NOT twice THEN epoch(CASE WHEN summer THEN t - INTERVAL 1 HOUR ELSE t END)::BIGINT END AS sure FROM k
""")
def local_to_utc(spark, sf_dir):
    local = F.add_months(F.to_date("o_orderdate"), 120).cast("timestamp")
    rows = orders(spark, sf_dir).select("o_orderkey", F.timestamp_seconds(F.unix_timestamp(local) + 1800 * (1 + F.col("o_orderkey") % 4)).alias("t"))
    at = lambda choice, name: F.unix_timestamp(dates.to_utc(F.col("t"), "Europe/London", choice)).alias(name)
    return rows.select("o_orderkey", at("compatible", "instant"), at("earlier", "earlier"), at("later", "later"), at("reject", "sure"))


@query(f"""
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::TIMESTAMP - INTERVAL 9 HOUR AS t FROM orders),
s AS (SELECT *, t >= {_last_sunday(3)} + INTERVAL 1 HOUR AND t < {_last_sunday(10)} + INTERVAL 1 HOUR AS summer FROM d)
SELECT day::VARCHAR AS day, CASE WHEN summer THEN 'summer' ELSE 'winter' END AS season, epoch(t + CASE WHEN summer THEN INTERVAL 390 MINUTE ELSE INTERVAL 430 MINUTE END)::BIGINT AS collect,
       epoch(t + CASE WHEN summer THEN INTERVAL 420 MINUTE ELSE INTERVAL 450 MINUTE END)::BIGINT AS publish, epoch(t + CASE WHEN summer THEN INTERVAL 410 MINUTE ELSE INTERVAL 440 MINUTE END)::BIGINT AS deadline FROM s
""")
def publish_slots(spark, sf_dir):
    days = orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("day")).distinct()
    slots = days.select("day", dates.slot(F.col("day"), "Asia/Seoul", {"collect": ("06:30", "07:10"), "publish": ("07:00", "07:30")}, 10, "publish").alias("s"))
    return slots.select(F.col("day").cast("string").alias("day"), "s.season", *[F.unix_timestamp(f"s.{n}").alias(n) for n in ("collect", "publish", "deadline")])


@query("""
WITH p(k, tin, tout, lin, lout) AS (VALUES ('1-URGENT', 3.0, 15.0, 6.0, 22.5), ('2-HIGH', 1.0, 5.0, 2.0, 7.5), ('5-LOW', 0.1, 0.4, 0.1, 0.4)),
u AS (SELECT o_orderkey, o_orderpriority AS k, (o_orderkey % 5000)::DECIMAL(18,0) AS n_in, (o_custkey % 900)::DECIMAL(18,0) AS n_out, o_orderkey % 2 = 0 AS batch FROM orders)
SELECT o_orderkey, ((n_in * (CASE WHEN n_in > 4000 THEN lin ELSE tin END)::DECIMAL(6,2) + n_out * (CASE WHEN n_in > 4000 THEN lout ELSE tout END)::DECIMAL(6,2)) * CASE WHEN batch THEN 0.5 ELSE 1.0 END)::DOUBLE / 1000000 AS cost FROM u JOIN p USING (k)
""")
def long_context_cost(spark, sf_dir):
    prices = spark.createDataFrame([("1-URGENT", 3.0, 15.0, 6.0, 22.5), ("2-HIGH", 1.0, 5.0, 2.0, 7.5), ("5-LOW", 0.1, 0.4, 0.1, 0.4)], "o_orderpriority string, tin double, tout double, lin double, lout double")
    uses = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 5000).alias("n_in"), (F.col("o_custkey") % 900).alias("n_out"), (F.col("o_orderkey") % 2 == 0).alias("batch"))
    cost = aggregate.token_cost(uses, prices, "o_orderpriority", {"n_in": "tin", "n_out": "tout"}, "batch", long=(F.col("n_in") > 4000, {"n_in": "lin", "n_out": "lout"}))
    return cost.select("o_orderkey", F.col("cost").cast("double").alias("cost"))


@query("""
WITH c AS (SELECT o_orderkey::VARCHAR AS key, o_orderdate::DATE AS day, o_orderpriority AS p, o_totalprice AS price FROM orders)
SELECT 'floor' AS rule, 'error' AS severity, day::VARCHAR AS key, count(*) AS n FROM c GROUP BY day HAVING count(*) < CASE WHEN month(day) IN (6, 7) THEN 5 ELSE 10 END
UNION ALL SELECT 'future', 'error', key, 1 FROM c WHERE day > DATE '1998-06-30' UNION ALL SELECT 'flag', 'warning', key, 1 FROM c WHERE p = '4-NOT SPECIFIED' AND price > 200000
""")
def publish_gate(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    floor = F.when(F.month("day").isin(6, 7), 5).otherwise(10)
    rules = [("future", "error", F.col("day") > F.lit("1998-06-30").cast("date")), ("flag", "warning", (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_totalprice") > 200000))]
    return checks.too_few("floor", rows, ["day"], floor).unionByName(checks.row_issues(rows, "o_orderkey", rules))


@query("""
WITH n AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM events),
r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND ts::DATE = now::DATE AND ts >= now - INTERVAL 12 HOUR) AS n, max(ts) FILTER (event_type = 'purchase' AND ts::DATE = now::DATE AND ts >= now - INTERVAL 12 HOUR) AS recent,
      bool_or(event_type = 'error' AND ts::DATE = now::DATE) AS waits FROM n GROUP BY 1)
SELECT user_id, CASE WHEN n = 0 THEN 'run' WHEN waits AND n = 1 THEN 'retry' ELSE 'skip' END AS decision, epoch_us(recent) AS recent FROM r
""")
def run_decisions(spark, sf_dir):
    e = instants(spark, sf_dir)
    rows = e.join(e.groupBy("user_id").agg(F.max("ts").alias("now")), "user_id").withColumn("today", F.to_date("now")).withColumn("day", F.to_date("ts"))
    rows = rows.withColumn("done_at", F.when(F.col("event_type") == "purchase", F.col("ts"))).withColumn("waits", (F.col("event_type") == "error") & (F.col("day") == F.col("today")))
    return checks.run_decision(rows, "user_id", "done_at", "day", "today", "now", 12, "waits").withColumn("recent", F.unix_micros("recent"))


@query("""
WITH a AS (SELECT o_custkey AS id, min(o_orderkey) AS lead, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS id, min(o_orderkey) AS lead, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT id, coalesce(a.lead, b.lead) AS lead, array_to_string(list_concat(coalesce(a.s, []), list_filter(coalesce(b.s, []), lambda x: NOT list_contains(coalesce(a.s, []), x))), ',') AS sources FROM a FULL JOIN b USING (id)
""")
def rerun_cards(spark, sf_dir):
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "id")
    side = lambda rows: rows.groupBy("id").agg(F.min("o_orderkey").alias("lead"), F.array_sort(F.collect_set("o_orderpriority")).alias("sources"))
    existing, incoming = side(o.where("o_orderstatus = 'F'")), side(o.where("o_orderstatus <> 'F'"))
    once = cards.rerun(existing, incoming, "id", "sources")
    return cards.rerun(once, incoming, "id", "sources").withColumn("sources", F.array_join("sources", ","))


@query("""
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS c, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN o_orderkey END AS card, CASE WHEN o_orderkey % 13 > 0 THEN o_orderstatus = 'P' END AS seen FROM orders),
k AS (SELECT c, min(card) AS card_id, bool_or(coalesce(seen, false) AND card IS NULL) AS old FROM m WHERE c IS NOT NULL GROUP BY 1),
j AS (SELECT m.*, CASE WHEN m.c IS NULL THEN card ELSE k.card_id END AS card_id, coalesce(k.old, m.seen, false) AS old FROM m LEFT JOIN k USING (c))
SELECT o_orderkey, CASE WHEN card_id IS NOT NULL THEN CASE WHEN card IS NULL AND NOT coalesce(seen, false) THEN 'addition' ELSE 'existing' END WHEN old THEN 'suppressed' ELSE 'fresh' END AS plan, card_id FROM j
""")
def cluster_plans(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = orders(spark, sf_dir).select("o_orderkey", F.when(k % 11 > 0, F.col("o_custkey")).alias("c"), F.when((F.col("o_orderpriority") == "1-URGENT") & (k % 3 == 0), k).alias("card"), F.when(k % 13 > 0, F.col("o_orderstatus") == "P").alias("seen"))
    return cluster.cluster_plan(rows, "c", "card", "seen").select("o_orderkey", "plan", "card_id")


@query("""
WITH w AS (SELECT source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
t AS (SELECT source, CASE WHEN list_has_any(w, ['that', 'than']) AND NOT list_has_any(w, ['was', 'were']) THEN 'strong' WHEN list_has_any(w, ['les', 'des']) AND NOT list_has_any(w, ['un', 'une']) THEN 'weak' END AS reason FROM w)
SELECT source, reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY ALL
""")
def scope_counts(spark, sf_dir):
    has = lambda *words: keywords.hits(F.col("text"), keywords.Group("", words))
    reason = keywords.out_of_scope([("strong", has("that", "than"), has("was", "were")), ("weak", has("les", "des"), has("un", "une"))])
    return table(spark, sf_dir, "documents").select("source", reason.alias("reason")).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT n_nationkey, n_name, CASE n_name WHEN 'FRANCE' THEN '프랑스' WHEN 'JAPAN' THEN '일본' WHEN 'BRAZIL' THEN '브라질' END AS ko FROM nation)
SELECT n_nationkey, CASE WHEN ko IS NULL THEN n_name || '은 x' || n_name || ' ' || n_name || '으로' ELSE ko || CASE n_name WHEN 'FRANCE' THEN '는' ELSE '은' END || ' x' || n_name || ' ' || ko || CASE n_name WHEN 'JAPAN' THEN '으로' ELSE '로' END END AS line FROM n
""")
def name_substitution(spark, sf_dir):
    line = F.concat("n_name", F.lit("은 x"), "n_name", F.lit(" "), "n_name", F.lit("으로"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.substitute(line, [("France", "프랑스"), ("Japan", "일본"), ("Brazil", "브라질")], text.PARTICLES).alias("line"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'José Ángel|Real B' WHEN 1 THEN 'Real B' ELSE '' END AS spans FROM supplier")
def latin_runs(spark, sf_dir):
    line = F.when(F.col("s_suppkey") % 3 == 0, "축구 José Ángel, 김 Real B").when(F.col("s_suppkey") % 3 == 1, "Ajax: Real B 와 Real B").otherwise("Ajax 팀")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.latin_spans(line, ["Ajax"]), "|").alias("spans"))


@query("SELECT c_custkey, c_mktsegment || '|a%7Cb|50%25%7C' AS code, c_mktsegment || ' a|b 50%|' AS back FROM customer")
def tag_codec(spark, sf_dir):
    code = text.encode_tags(F.array(F.col("c_mktsegment"), F.lit("a|b"), F.lit("50%|")))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), F.array_join(text.decode_tags(code), " ").alias("back"))


@query("""
WITH w AS (SELECT strftime(o_orderdate, '%G-%V') AS week, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1)
SELECT week, n, total::DOUBLE AS total, lag(week) OVER (ORDER BY week) AS before, lead(week) OVER (ORDER BY week) AS after, n - lag(n) OVER (ORDER BY week) AS change FROM w
""")
def weekly_view(spark, sf_dir):
    weeks = orders(spark, sf_dir).groupBy(dates.iso_week(F.to_date("o_orderdate")).alias("week")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    w = Window.orderBy("week")  # one row per week: the size of a calendar
    return weeks.select("week", "n", F.col("total").cast("double").alias("total"), F.lag("week").over(w).alias("before"), F.lead("week").over(w).alias("after"), (F.col("n") - F.lag("n").over(w)).alias("change"))


@query("""
SELECT page_id, 'https://example.com/a/c' || CASE WHEN page_id % 2 = 0 THEN '?a=x+y&b=%C3%A9' ELSE '?a=x%2By' END AS url_key FROM pages
""")
def url_equivalents(spark, sf_dir):
    raw = F.when(F.col("page_id") % 2 == 0, "HTTP://www.Example.com:80/a/./b/%2E%2e/c/?b=%c3%a9&utm%5Fsource=z&a=x%20y#top").otherwise("https://example.com/../a/b/../c?a=x%2by")
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise(raw).alias("url_key"))
