"""States, results, links, budgets and ledgers on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import keywords, matches
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query
from tidemill.session import table


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def at(x):
    return F.lit(x).cast("timestamp")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'postponed' ELSE 'open' END"


@query(f"""
WITH o AS (SELECT o_orderkey, {STATUS} AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS start FROM orders)
SELECT o_orderkey, CASE WHEN status IN ('finished', 'postponed') THEN status WHEN start IS NULL THEN 'tbc' WHEN start + INTERVAL 3 HOUR <= TIMESTAMP '1997-06-01 03:00:00' THEN 'pending' ELSE 'scheduled' END AS state FROM o
""")
def match_state(spark, sf_dir):
    start = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return orders(spark, sf_dir).select("o_orderkey", matches.match_state(F.expr(STATUS), start, at("1997-06-01 03:00:00")).alias("state"))


@query("""
WITH m AS (SELECT o_orderkey, o_custkey % 25 AS home, o_orderkey % 25 AS away, o_orderkey % 4 AS hs, o_custkey % 3 AS aw, o_orderstatus = 'F' AS fin FROM orders),
t AS (SELECT *, home AS team FROM m UNION ALL SELECT *, away FROM m UNION ALL SELECT *, 99 FROM m WHERE o_orderkey % 50 = 0), r AS (SELECT team, CASE WHEN fin AND team IN (home, away) THEN sign(CASE WHEN team = home THEN hs - aw ELSE aw - hs END) END AS s FROM t)
SELECT team, CASE s WHEN 1 THEN 'W' WHEN 0 THEN 'D' WHEN -1 THEN 'L' END AS result, count(*) AS n FROM r GROUP BY ALL
""")
def match_results(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = orders(spark, sf_dir).select((c % 25).alias("home"), (k % 25).alias("away"), (k % 4).alias("hs"), (c % 3).alias("aw"), (F.col("o_orderstatus") == "F").alias("fin"), F.explode(F.concat(F.array(c % 25, k % 25), F.when(k % 50 == 0, F.array(F.lit(99).cast("long"))).otherwise(F.array().cast("array<long>")))).alias("team"))
    return m.groupBy("team", matches.result_for(*[F.col(x) for x in ("team", "home", "away", "hs", "aw", "fin")]).alias("result")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR greatest(l_quantity - 40, 0) > 0 OR coalesce(CASE WHEN l_tax > 0.05 THEN l_discount END, 0) > 0 AS played FROM lineitem")
def appeared(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", matches.appeared(F.col("l_returnflag") == "R", F.col("l_quantity") - 40, F.when(F.col("l_tax") > 0.05, F.col("l_discount"))).alias("played"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') = l_orderkey % 3 AND count(*) FILTER (l_returnflag <> 'R') = l_orderkey % 4 AS complete FROM lineitem GROUP BY 1
""")
def sides_complete(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "R", "home").otherwise("away")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(side.alias("side"))).alias("entries"))
    return rows.select("l_orderkey", matches.sides_complete(F.col("entries"), "side", F.col("l_orderkey") % 3, F.col("l_orderkey") % 4).alias("complete"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 < 4 AND c_nationkey % 2 = 0 THEN 'manual' ELSE c_mktsegment END AS value FROM customer")
def manual_override(spark, sf_dir):
    manual = F.when(F.col("c_nationkey") % 2 == 0, "manual")
    return table(spark, sf_dir, "customer").select("c_custkey", matches.override(F.col("c_mktsegment"), F.col("c_custkey") % 7, manual, 4).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 IN (1, 2) THEN 'league' WHEN (o_custkey % 25 IN (3, 4) OR o_orderkey % 25 IN (3, 4)) AND o_orderstatus <> 'P' THEN 'team' WHEN o_orderstatus = 'P' THEN 'friendly' ELSE 'other' END AS target FROM orders")
def target_class(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, sf_dir).select("o_orderkey", matches.target_class(c % 9, c % 25, k % 25, [1, 2], [3, 4], F.col("o_orderstatus") == "P").alias("target"))


@query("""
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), s(a, b) AS (VALUES (DATE '1993-08-01', DATE '1994-05-31'), (DATE '1995-08-01', DATE '1996-05-31')), f AS (SELECT DISTINCT ts::DATE - 10000 AS day FROM events WHERE event_type = 'purchase' AND extract(day FROM ts) <= 4)
SELECT day::VARCHAR AS day, CASE WHEN EXISTS (SELECT 1 FROM f WHERE abs(f.day - d.day) <= 2) THEN 'fixture' WHEN NOT EXISTS (SELECT 1 FROM s WHERE d.day BETWEEN a AND b) THEN 'season' END AS rest FROM d
""")
def rest_days(spark, sf_dir):
    days = orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("day")).distinct()
    seasons = spark.createDataFrame([("1993-08-01", "1994-05-31"), ("1995-08-01", "1996-05-31")], "a string, b string").select(F.to_date("a").alias("first"), F.to_date("b").alias("last"))
    fixtures = instants(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.dayofmonth("ts") <= 4)).select(F.date_sub(F.to_date("ts"), 10000).alias("day")).distinct()
    return matches.rest_days(days, "day", seasons, fixtures, 2).select(F.col("day").cast("string").alias("day"), "rest")


@query("""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2)) AS spent, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus <> 'F'), 0) AS dev, CASE WHEN strftime(o_orderdate, '%m') = '01' THEN 0.0 ELSE 5000000.0 END AS lim FROM orders GROUP BY 1, 4)
SELECT month, spent::DOUBLE AS spent, dev::DOUBLE AS dev, CASE WHEN lim > 0 THEN spent::DOUBLE / lim::DOUBLE END AS share, CASE WHEN lim > 0 THEN dev::DOUBLE / lim::DOUBLE END AS dev_share, CASE WHEN lim > 0 THEN spent::DOUBLE / lim::DOUBLE > 0.5 ELSE spent > 0 END AS alert FROM c
""")
def budget_usage(spark, sf_dir):
    costs = orders(spark, sf_dir).select("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), F.when(F.col("o_orderstatus") == "F", "prod").otherwise("dev").alias("env"))
    limit = F.when(F.col("month").endswith("-01"), F.lit(0.0)).otherwise(F.lit(5000000.0))
    out = matches.budget_usage(costs, F.date_format("o_orderdate", "yyyy-MM"), "cost", "env", limit)
    return out.withColumn("spent", F.col("spent").cast("double")).withColumn("dev", F.col("dev").cast("double"))


@query("""
WITH r AS (SELECT o_custkey % 40 AS comp, strftime(o_orderdate, '%Y-%m') AS round, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders WHERE o_custkey % 40 <> 5 OR o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL), n AS (SELECT *, TIMESTAMP '1996-06-15' AS now FROM r)
SELECT comp, coalesce(arg_min(round, (a, round)) FILTER (a <= now AND b >= now), arg_min(round, (a, round)) FILTER (a > now), arg_max(round, (a, round))) AS round, CASE WHEN bool_or(a <= now AND b >= now) THEN 'live' WHEN bool_or(a > now) THEN 'ahead' ELSE 'over' END AS state FROM n GROUP BY 1
""")
def current_round(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("comp", F.col("o_custkey") % 40).where("comp <> 5 OR o_orderdate < '1996-01-01'")
    rounds = o.groupBy("comp", F.date_format("o_orderdate", "yyyy-MM").alias("round")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return matches.current_round(rounds, "comp", "a", "b", at("1996-06-15"))


def two_lists(spark, sf_dir):
    """The events of two providers: a day's orders per customer group, with scores and ways of finishing, some unknown."""
    o = orders(spark, sf_dir)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = lambda d: F.when((k + d) % 11 != 0, k % 4)
    a = o.where(k % 2 == 0).select(k.alias("a"), (c % 50).alias("slot"), F.col("o_orderdate").alias("at"), (c % 7).alias("home"), (k % 7).alias("away"), score(0).alias("score"), (k % 3).alias("finish"))
    b = o.where(k % 3 == 0).select(k.alias("b"), (c % 50).alias("slot"), F.col("o_orderdate").alias("at"), (c % 7 + 100).alias("home"), (k % 7 + 100).alias("away"), score(2).alias("score"), (k % 3).alias("finish"))
    return a, b, spark.range(4).select(F.col("id").alias("team"), (F.col("id") + 100).alias("other"))


LINKS = """
WITH x AS (SELECT o_orderkey AS a, o_custkey % 50 AS slot, o_orderdate AS at, o_custkey % 7 AS home, o_orderkey % 7 AS away, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS sa, o_orderkey % 3 AS fa FROM orders WHERE o_orderkey % 2 = 0),
y AS (SELECT o_orderkey AS b, o_custkey % 50 AS slot, o_orderdate AS at, o_custkey % 7 AS home, o_orderkey % 7 AS away, CASE WHEN (o_orderkey + 2) % 11 <> 0 THEN o_orderkey % 4 END AS sb, o_orderkey % 3 AS fb FROM orders WHERE o_orderkey % 3 = 0),
p AS MATERIALIZED (SELECT a, b, sa, sb, fa, fb, x.home = y.home AND x.home < 4 AND x.away = y.away AND x.away < 4 AS sure FROM x JOIN y ON x.slot = y.slot AND abs(epoch(x.at) - epoch(y.at)) <= 86400 * 3),
s AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p WHERE sure), first AS MATERIALIZED (SELECT a, b FROM s WHERE na = 1 AND nb = 1),
l AS MATERIALIZED (SELECT * FROM p WHERE a NOT IN (SELECT a FROM first) AND b NOT IN (SELECT b FROM first)),
q AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM l WHERE sa = sb),
c AS MATERIALIZED (SELECT * FROM q WHERE na = 1 AND nb = 1 AND a NOT IN (SELECT a FROM l WHERE sa IS NULL OR sb IS NULL) AND b NOT IN (SELECT b FROM l WHERE sa IS NULL OR sb IS NULL)),
k AS (SELECT a, b FROM first UNION ALL SELECT a, b FROM c WHERE fa IS NOT DISTINCT FROM fb),
r AS (SELECT a, bool_or(sa IS NULL OR sb IS NULL) AS blind, coalesce(bool_or(sa = sb), false) AS same FROM l GROUP BY a)
SELECT x.a, k.b, CASE WHEN k.b IS NOT NULL THEN NULL WHEN x.a NOT IN (SELECT a FROM p) THEN 'no-candidate' WHEN r.a IS NULL THEN 'taken' WHEN blind THEN 'unknown-score' WHEN NOT same THEN 'other-score' WHEN x.a NOT IN (SELECT a FROM c) THEN 'many' ELSE 'finish' END AS reason
FROM x LEFT JOIN k ON k.a = x.a LEFT JOIN r ON r.a = x.a
"""


@query(LINKS)
def evidence_links(spark, sf_dir):
    a, b, confirmed = two_lists(spark, sf_dir)
    return matches.evidence_links(a, b, confirmed, 86400 * 3)


@query("""
WITH x AS (SELECT o_orderkey AS a, o_orderdate AS at_, o_custkey AS team, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS na FROM orders WHERE o_orderkey % 2 = 0), y AS (SELECT o_orderkey AS b, o_orderdate AS at_, o_custkey AS team, CASE WHEN o_orderkey % 5 <> 0 THEN lower(o_orderpriority) END AS nb FROM orders WHERE o_orderkey % 2 = 1),
p AS (SELECT a, b, na, nb, count(*) OVER (PARTITION BY a) AS ca, count(*) OVER (PARTITION BY b) AS cb FROM x JOIN y ON x.team = y.team AND abs(epoch(x.at_) - epoch(y.at_)) <= 2592000),
f AS (SELECT a, min(b) AS b, max(ca) AS ca, max(cb) AS cb, bool_and(na IS NULL OR nb IS NULL OR lower(na) = lower(nb)) AS ok FROM p GROUP BY a)
SELECT x.a, CASE WHEN ca = 1 AND cb = 1 AND ok THEN f.b END AS b, CASE WHEN f.a IS NULL THEN 'no-candidate' WHEN ca > 1 OR cb > 1 THEN 'many' WHEN NOT ok THEN 'name' END AS reason FROM x LEFT JOIN f ON f.a = x.a
""")
def pending_links(spark, sf_dir):
    o, k = orders(spark, sf_dir), F.col("o_orderkey")
    a = o.where(k % 2 == 0).select(k.alias("a"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("team"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("name"))
    b = o.where(k % 2 == 1).select(k.alias("b"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("team"), F.when(k % 5 != 0, F.lower("o_orderpriority")).alias("name"))
    return matches.pending_links(a, b, 30 * 86400)


@query("""
WITH e AS (SELECT o_custkey, o_orderdate AS at_, o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS rank FROM orders WHERE o_custkey % 6 <> 1),
n AS (SELECT o_custkey, max(rank) AS status, min(at_) AS first, max(at_) AS last FROM e GROUP BY 1), r AS (SELECT o_custkey, max(CASE o_orderpriority WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END) + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS status, min(o_orderdate) + CASE WHEN o_custkey % 4 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS first, max(o_orderdate) AS last FROM orders WHERE o_custkey % 7 <> 2 GROUP BY o_custkey)
SELECT coalesce(r.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN r.o_custkey IS NULL THEN 'missing' WHEN n.o_custkey IS NULL THEN 'orphan' WHEN r.status <> n.status THEN 'status' WHEN r.first <> n.first THEN 'first' WHEN r.last <> n.last THEN 'last' END AS problem
FROM r FULL JOIN n ON r.o_custkey = n.o_custkey WHERE problem IS NOT NULL
""")
def record_problems(spark, sf_dir):
    p, c = F.col("o_orderpriority"), F.col("o_custkey")
    rank = F.when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).when(p == "4-NOT SPECIFIED", 1).otherwise(0)
    o = orders(spark, sf_dir).select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey", rank.alias("rank"))
    records = o.where(c % 7 != 2).groupBy("o_custkey").agg(F.max("rank").alias("s"), F.min("at").alias("f"), F.max("at").alias("last"))
    records = records.select("o_custkey", (F.col("s") + F.when(c % 5 == 0, 1).otherwise(0)).alias("status"), F.when(c % 4 == 0, F.col("f") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("f")).alias("first"), "last")
    return matches.record_problems(records, o.where(c % 6 != 1), "o_custkey", ["at", "o_orderkey"], "rank")


@query("""
WITH c AS (SELECT c_custkey AS id, 2020 + c_custkey % 3 AS season, c_custkey % 9 AS runs, TIMESTAMP '2024-01-10' AS last FROM customer WHERE c_custkey % 4 <> 0), f AS (SELECT user_id AS id, 2020 + user_id % 4 AS season, max(ts) AS at_ FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT coalesce(c.id, f.id) AS id, CASE WHEN c.id IS NULL OR f.season > c.season THEN f.season ELSE c.season END AS season, CASE WHEN c.id IS NULL OR f.season > c.season THEN 1 WHEN f.season = c.season THEN runs + 1 ELSE runs END AS runs,
  epoch_us(CASE WHEN c.id IS NULL OR f.season > c.season THEN at_ WHEN f.season = c.season THEN greatest(last, at_) ELSE last END)::BIGINT AS last FROM c FULL JOIN f ON c.id = f.id
""")
def season_reset(spark, sf_dir):
    k, u = F.col("c_custkey"), F.col("user_id")
    current = table(spark, sf_dir, "customer").where(k % 4 != 0).select(k.alias("id"), (k % 3 + 2020).alias("season"), (k % 9).alias("runs"), at("2024-01-10").alias("last"))
    facts = instants(spark, sf_dir).where("event_type = 'signup'").groupBy(u.alias("id"), (u % 4 + 2020).alias("season")).agg(F.max("ts").alias("at"))
    return matches.next_meta(current, facts, "id").withColumn("last", F.unix_micros("last"))


@query("""
WITH e AS (SELECT user_id, ts, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT user_id, epoch_us(max(ts))::BIGINT AS "at", arg_max(event_id, (ts, event_id)) AS event_id FROM e GROUP BY 1
""")
def pruned_runs(spark, sf_dir):
    e = instants(spark, sf_dir).select("user_id", "ts", "event_id")
    out = matches.pruned(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts", at("2024-01-20"))
    return out.select("user_id", F.unix_micros("ts").alias("at"), "event_id")


@query("""
WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), m AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 500 = 4 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 < 2),
b AS (SELECT DISTINCT *, strftime(day, '%Y-%m') AS month FROM (SELECT * FROM d UNION ALL SELECT * FROM m)), u AS (SELECT month FROM b GROUP BY month HAVING last_day(min(day)) + 90 < DATE '1996-06-30'), r AS (SELECT * FROM b WHERE month IN (SELECT month FROM u)),
c AS (SELECT month FROM (SELECT month, id FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY month)
SELECT month, count(*) FILTER (month NOT IN (SELECT month FROM c)) AS merged, bool_or(month IN (SELECT month FROM c)) AS refused FROM r GROUP BY month
""")
def month_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    o = orders(spark, sf_dir).select(k.alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("s"))
    monthly = o.where("id % 4 < 2").withColumn("s", F.when(F.col("id") % 500 == 4, "X").otherwise(F.col("s")))
    rows, conflicts = matches.merge_months(o.where("id % 2 = 0"), monthly, "id", "day", F.to_date(F.lit("1996-06-30")), 90)
    return rows.groupBy("month").agg(F.count("*").alias("merged")).withColumn("refused", F.lit(False)).unionByName(conflicts.select("month", F.lit(0).cast("long").alias("merged"), F.lit(True).alias("refused")))


@query("""
WITH n AS (SELECT o_custkey AS url, max(o_orderdate) AS at_, 0 AS old FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderdate), 1 FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1),
f AS (SELECT * FROM n WHERE url % 8 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY old, at_ DESC) = 1) SELECT url, epoch_us(at_)::BIGINT AS "at", old = 0 AS fresh FROM f ORDER BY old, at_ DESC, url LIMIT 100
""")
def reading_merge(spark, sf_dir):
    o, k = orders(spark, sf_dir), F.col("o_orderkey")
    new = o.where(k % 3 == 0).groupBy(F.col("o_custkey").alias("url")).agg(F.max("o_orderdate").alias("at"))
    old = o.where(k % 3 == 1).groupBy(F.col("o_custkey").alias("url")).agg(F.min("o_orderdate").alias("at"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 8 = 0").select(F.col("c_custkey").alias("url"))
    return matches.reading_merge(old, new, "url", "at", 100, gone).withColumn("at", F.unix_micros("at"))


@query("""
WITH fx AS (SELECT o_orderkey AS key, o_custkey % 25 AS team FROM orders WHERE o_orderstatus = 'P'), pl AS (SELECT o_custkey AS player, o_orderkey AS key, o_custkey % 25 AS team FROM orders WHERE o_orderstatus = 'P'),
t(name, team) AS (VALUES ('ann', 3), ('bob', 3), ('ann', 4)), u AS (SELECT 'cat' AS name, c_custkey AS player FROM customer WHERE c_custkey % 10 = 3),
own AS (SELECT key, team, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM fx JOIN t USING (team) GROUP BY ALL)
SELECT key, team, 'team' AS kind, names FROM own UNION ALL SELECT key, team, 'player', string_agg(DISTINCT name, ',' ORDER BY name) FROM pl JOIN u USING (player) WHERE (key, team) NOT IN (SELECT (key, team) FROM own) GROUP BY ALL
""")
def merged_board(spark, sf_dir):
    o = orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 25).alias("team"), F.col("o_custkey").alias("player"))
    named = spark.createDataFrame([("ann", "team", 3), ("bob", "team", 3), ("ann", "team", 4)], "name string, kind string, target long")
    people = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.lit("cat").alias("name"), F.lit("player").alias("kind"), F.col("c_custkey").alias("target"))
    return matches.follow_board(named.unionByName(people), o.select("key", "team"), o)


@query("""
WITH p AS (SELECT c_custkey, [trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN [c_name, '  ' || lower(c_name), c_mktsegment, '', '손흥민']] AS l FROM customer), q AS (SELECT c_custkey, list_filter(l, lambda x: x <> '') AS l FROM p)
SELECT c_custkey, c_name || '|' || c_mktsegment || '|손흥민|흥민' AS aliases FROM customer
""")
def alias_lists(spark, sf_dir):
    parts = F.array("c_name", F.concat(F.lit("  "), F.lower("c_name")), "c_mktsegment", F.lit(""), F.lit(None).cast("string"), F.lit(" 손흥민 "))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(matches.alias_list(parts), "|").alias("aliases"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 60) AS query FROM documents")
def query_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", matches.query_text(F.col("text")).alias("query"))


SIGNALS = (keywords.Group("result", ("steel", "brass")), keywords.Group("event", ("polished",), ("polished steel",)), keywords.Group("report", ("large", "small")))


@query("""
WITH s AS (SELECT p_partkey, p_type, lower(p_type) AS t, p_name AS title FROM part),
g AS (SELECT *, list_has_any(string_split(t, ' '), ['steel', 'brass']) AS result, list_contains(string_split(regexp_replace(t, '\\bpolished steel\\b', ' ', 'g'), ' '), 'polished') AS event, list_has_any(string_split(t, ' '), ['large', 'small']) AS report, p_partkey % 2 = 0 AS subject FROM s)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN result THEN 'result' END, CASE WHEN event THEN 'event' END, CASE WHEN report THEN 'report' END], lambda x: x IS NOT NULL), ',') AS signals, p_partkey % 5 <> 0 AS scored, (result AND subject) OR event OR report OR (p_partkey % 5 <> 0 AND p_partkey % 3 = 0) AS spoiler FROM g
""")
def text_signals(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.lit(" "), k % 9, F.when(k % 5 == 0, "/").otherwise("-"), k % 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", keywords.signals(F.col("p_type"), SIGNALS).alias("s"), F.size(text.scores(title)).alias("n"), title.alias("title"))
    # for the flag only the score of every third title counts
    flag = keywords.spoiler(F.col("s"), (F.col("n") > 0) & (k % 3 == 0), k % 2 == 0, likely=("result",), sure=("event", "report"))
    return rows.select("p_partkey", F.array_join(F.filter(F.array(*[F.when(F.col("s")[g.name], g.name) for g in SIGNALS]), lambda x: x.isNotNull()), ",").alias("signals"), (F.col("n") > 0).alias("scored"), flag.alias("spoiler"))


@query("""
WITH m AS (SELECT o_custkey AS cluster, o_orderkey, o_orderstatus AS source, o_orderpriority AS tag, o_totalprice > 300000 AS spoiler, o_orderdate AS at_ FROM orders)
SELECT cluster, count(*) AS n, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, bool_or(spoiler) AS spoiler, arg_min(o_orderkey, (at_, o_orderkey)) AS lead, epoch_us(min(at_))::BIGINT AS first FROM m GROUP BY 1
""")
def cluster_analysis(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), F.array("o_orderpriority").alias("tags"), (F.col("o_totalprice") > 300000).alias("spoiler"), F.col("o_orderdate").alias("at"))
    return keywords.cluster_facts(rows, "cluster").select("cluster", "n", "sources", F.array_join("tags", ",").alias("tags"), "spoiler", "lead", F.unix_micros("first").alias("first"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part), d(term, slug, shared) AS (VALUES ('Steel', 1, false), ('Polished', 2, true), ('Polished Steel', 3, false), ('Small', 4, false), ('Brass', 5, true)),
r AS (SELECT p_partkey, i AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT p_partkey, [upper(x[1]) || lower(x[2:]) FOR x IN w] AS w FROM p), unnest(range(1, 7)) a(i), unnest(range(1, 4)) b(n) WHERE i + n - 1 <= len(w)),
h AS (SELECT p_partkey, pos, n, slug, shared FROM r JOIN d USING (term)), o AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.p_partkey = h.p_partkey AND g.pos <= h.pos AND g.pos + g.n >= h.pos + h.n AND g.n > h.n))
SELECT p_partkey AS id, slug, min(pos)::INT AS pos FROM o WHERE (NOT shared OR EXISTS (SELECT 1 FROM o e WHERE e.p_partkey = o.p_partkey AND e.slug = 4)) AND NOT (slug = 5 AND EXISTS (SELECT 1 FROM o e WHERE e.p_partkey = o.p_partkey AND e.slug = 2)) GROUP BY p_partkey, slug
""")
def context_tags(spark, sf_dir):
    terms = spark.createDataFrame([("steel", 1, False), ("polished", 2, True), ("polished steel", 3, False), ("small", 4, False), ("brass", 5, True)], "term string, slug int, shared boolean")
    evidence = spark.createDataFrame([(2, 4), (5, 4)], "slug int, evidence int")
    vetoes = spark.createDataFrame([(5, 2)], "slug int, veto int")
    rows = table(spark, sf_dir, "part").withColumn("w", F.split(F.initcap("p_type"), " "))
    return keywords.tags_in_context(rows, "p_partkey", "w", terms, evidence, vetoes, 3)


@query("""
WITH l AS (SELECT o_custkey AS player, o_orderkey AS key, o_orderdate AS at_, o_orderkey % 3 AS goals FROM orders), p AS (SELECT * FROM l WHERE at_ < TIMESTAMP '1998-01-01'), u AS (SELECT player, arg_min(key, (at_, key)) AS next FROM l WHERE at_ >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT c_custkey AS player, c_name AS name, coalesce(g, 0) AS games, coalesce(s, 0) AS goals, last, next FROM customer LEFT JOIN (SELECT player, count(*) AS g, sum(goals)::BIGINT AS s, arg_max(key, (at_, key)) AS last FROM p GROUP BY 1) t ON t.player = c_custkey LEFT JOIN u ON u.player = c_custkey
""")
def player_detail(spark, sf_dir):
    log = orders(spark, sf_dir).select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 3).alias("goals"))
    now, order = at("1998-01-01"), F.struct("at", "key")
    totals = log.groupBy("player").agg(F.count_if(F.col("at") < now).alias("games"), F.sum(F.when(F.col("at") < now, F.col("goals")).otherwise(0)).alias("goals"), F.max(F.when(F.col("at") < now, order))["key"].alias("last"), F.min(F.when(F.col("at") >= now, order))["key"].alias("next"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_name").alias("name"))
    return people.join(totals, "player", "left").select("player", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("games", "goals")], "last", "next")


@query("""
WITH l AS (SELECT o_custkey AS player, o_orderkey AS key, o_orderkey % 3 AS goals, o_totalprice AS score, o_orderdate::DATE AS day FROM orders)
SELECT player, key, goals, row_number() OVER (ORDER BY score DESC, key)::INT AS place FROM l WHERE day = DATE '1996-06-15' - 1 AND goals > 0
""")
def last_night(spark, sf_dir):
    from pyspark.sql import Window

    log = orders(spark, sf_dir).where(F.to_date("o_orderdate") == F.date_sub(F.to_date(F.lit("1996-06-15")), 1)).select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3).alias("goals"), F.col("o_totalprice").alias("score"))
    return log.where("goals > 0").select("player", "key", "goals", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("place"))


@query("""
WITH r AS (SELECT o_custkey, max(o_orderdate) AS at_, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS claims FROM orders WHERE o_orderpriority <= '3-MEDIUM' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS extra FROM orders WHERE o_orderpriority > '3-MEDIUM' GROUP BY 1)
SELECT r.o_custkey, status, claims, coalesce(extra, 0) AS extra, n_name AS league FROM r LEFT JOIN a USING (o_custkey) JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def transfers_view(spark, sf_dir):
    o = orders(spark, sf_dir)
    claim = F.col("o_orderpriority") <= "3-MEDIUM"
    records = o.groupBy("o_custkey").agg(F.max(F.when(claim, F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))["o_orderstatus"].alias("status"), F.count_if(claim).alias("claims"), F.count_if(~claim).alias("extra")).where("claims > 0")
    leagues = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("league"))
    return records.join(leagues, "o_custkey").select("o_custkey", "status", "claims", "extra", "league")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_custkey % 10 = 3")
def auxiliary_cards(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "transfer").otherwise("news").alias("category"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("claim"), F.array(F.col("o_custkey") % 10).alias("mentions"))
    return rows.where(keywords.auxiliary(F.col("category"), F.col("claim"), F.col("mentions"), F.lit(3))).select("o_orderkey")


@query("""
SELECT 'c' || c_custkey AS id, c_name AS title, c_name || '|' || c_mktsegment AS aliases, coalesce(n_name, '') AS tags FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def search_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("title"), F.array_join(matches.alias_list(F.array("c_name", "c_mktsegment", F.upper("c_name"))), "|").alias("aliases"), F.coalesce("n_name", F.lit("")).alias("tags"))


@query("""
SELECT n_nationkey, lower(n_name) AS folded, ' ' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS latin, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '%7C' ELSE '' END AS tag, array_to_string(list_sort(list_distinct([lower(trim(x)) FOR x IN regexp_split_to_array(n_name || ' and ' || upper(n_name) || ', Desk', '(?i)[,;&/|]|\\band\\b')])), ',') AS authors FROM nation
""")
def text_keys(spark, sf_dir):
    name = F.col("n_name")
    tag = F.concat(name, F.when(F.col("n_nationkey") % 3 == 0, "|").otherwise(""))
    authors = text.author_keys(F.concat(name, F.lit(" and "), F.upper(name), F.lit(", Desk")))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.fold_name(name).alias("folded"), text.latin_key(name).alias("latin"), text.encode_tags(F.array(tag)).alias("tag"), F.array_join(F.array_sort(authors), ",").alias("authors"))


@query("""
WITH b AS (SELECT s_suppkey, nfc_normalize(CASE s_suppkey % 4 WHEN 0 THEN 'Zoe' || chr(776) || ' Lee and ZOË lee, Bo' WHEN 1 THEN 'desk@x.org (Ann  Park); ann park' WHEN 2 THEN s_name || ' | Anderson' ELSE ' , ' END) AS line FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'zoë lee=Zoë Lee,bo=Bo' WHEN 1 THEN 'ann park=Ann Park' WHEN 2 THEN lower(trim(split_part(line, '|', 1))) || '=' || trim(split_part(line, '|', 1)) || ',anderson=Anderson' ELSE '' END AS authors FROM b
""")
def byline_authors(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    line = F.when(k == 0, "Zoe\u0308 Lee and ZOË lee, Bo").when(k == 1, "desk@x.org (Ann  Park); ann park").when(k == 2, F.concat("s_name", F.lit(" | Anderson"))).otherwise(" , ")
    found = F.transform(text.authors("line"), lambda a: F.concat_ws("=", a["key"], a["name"]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.composed(line).alias("line")).select("s_suppkey", F.array_join(found, ",").alias("authors"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '손흥민 abc 12' WHEN 1 THEN lower(c_name) || ' 한글' ELSE lower(c_mktsegment) || ' x' END AS key,
  CASE c_custkey % 3 WHEN 0 THEN '12,abc,손흥민' WHEN 1 THEN 'customer#' || c_name[10:] || ',한글' ELSE lower(c_mktsegment) || ',x' END AS parts FROM customer
""")
def hangul_keys(spark, sf_dir):
    """Wide and narrow forms, letters of syllables on their own, and blanks of several kinds, as one key; and its parts as those of a name."""
    from tidemill.operators.joins import name_parts

    k = F.col("c_custkey") % 3
    syllables = "\u1109\u1169\u11ab\u1112\u1173\u11bc\u1106\u1175\u11ab"  # the letters of a name of three syllables
    raw = F.when(k == 0, syllables + "\u3000ＡＢＣ  １２").when(k == 1, F.concat("c_name", F.lit(" \u1112\u1161\u11ab\u1100\u1173\u11af "))).otherwise(F.concat(F.lit("\t"), "c_mktsegment", F.lit("\nＸ")))
    key = text.wide_key(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), F.array_join(F.array_sort(name_parts(key)), ",").alias("parts"))


@query("SELECT doc_id FROM documents WHERE source IS NOT NULL AND list_contains(['s1', lower(source)], lower(source)) AND doc_id % 3 = 0")
def author_filter(spark, sf_dir):
    authors = F.when(F.col("doc_id") % 3 == 0, text.author_keys("source")).otherwise(F.array(F.lit("nobody")))
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").where(text.has_author(authors, F.lower("source"))).select("doc_id")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'closed' WHEN n_nationkey % 4 = 1 THEN 'rieul' WHEN n_nationkey % 4 = 2 THEN 'open' END AS sound, CASE WHEN n_nationkey % 4 IN (0) THEN '집으로' WHEN n_nationkey % 4 = 1 THEN '서울로' WHEN n_nationkey % 4 = 2 THEN '사과로' ELSE 'x(으)로' END AS phrase FROM nation
""")
def particles(spark, sf_dir):
    word = F.element_at(F.array(F.lit("집"), F.lit("서울"), F.lit("사과"), F.lit("x")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", word.alias("word"))
    return rows.select("n_nationkey", text.final_sound(F.col("word")).alias("sound"), text.with_particle(F.col("word"), "으로", "로", "로", "(으)로").alias("phrase"))
