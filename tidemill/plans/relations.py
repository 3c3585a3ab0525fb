"""Filters, joins, aggregations, set operations and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import aggregate, checks, joins, select
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query
from tidemill.session import table

NOW = "2024-01-30 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


STARTS = "(VALUES ('view', TIMESTAMP '2024-01-10'), ('click', TIMESTAMP '2024-01-15'), ('error', TIMESTAMP '2024-01-29 09:00:00'), ('purchase', TIMESTAMP '2024-01-01'), ('signup', TIMESTAMP '2024-01-20')) s(event_type, start)"


def starts(spark):
    rows = [("view", "2024-01-10"), ("click", "2024-01-15"), ("error", "2024-01-29 09:00:00"), ("purchase", "2024-01-01"), ("signup", "2024-01-20")]
    return spark.createDataFrame(rows, "event_type string, start string").withColumn("start", F.col("start").cast("timestamp"))


VERDICT = f"CASE WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 3 HOUR THEN 'future' WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE THEN 'clamp' WHEN ts < start THEN 'out' ELSE 'in' END"


@query(f"SELECT event_id, {VERDICT} AS verdict FROM events JOIN {STARTS} USING (event_type)")
def window_verdict(spark, sf_dir):
    rows = instants(spark, sf_dir).join(starts(spark), "event_type")
    return rows.select("event_id", select.window_verdict(F.col("ts"), F.col("start"), now()).alias("verdict"))


@query(f"""
WITH v AS (SELECT *, {VERDICT} AS verdict FROM events JOIN {STARTS} USING (event_type))
SELECT event_type, count(*) FILTER (verdict = 'in') AS "in", count(*) FILTER (verdict = 'clamp') AS clamp, count(*) FILTER (verdict = 'out') AS "out", count(*) FILTER (verdict = 'future') AS future,
       greatest(0, max(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '{NOW}')))::BIGINT AS max_ahead FROM v GROUP BY 1
""")
def window_counts(spark, sf_dir):
    return select.apply_window(instants(spark, sf_dir), starts(spark), "event_type", "ts", now())[1]


@query(f"SELECT event_id, epoch_us(CASE WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE THEN TIMESTAMP '{NOW}' ELSE ts END)::BIGINT AS at, ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE AS clamped FROM events JOIN {STARTS} USING (event_type) WHERE ts <= TIMESTAMP '{NOW}' + INTERVAL 3 HOUR AND ts >= start")
def window_apply(spark, sf_dir):
    kept, _ = select.apply_window(instants(spark, sf_dir), starts(spark), "event_type", "ts", now())
    return kept.select("event_id", F.unix_micros("ts").alias("at"), "clamped")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['ECONOMY', 'SMALL']) AND p_brand IN ('Brand#2', 'Brand#17', 'Brand#13')")
def facet_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.where(select.facet_match(F.split("p_type", " "), ["ECONOMY", "SMALL"]) & select.facet_match(F.array("p_brand"), ["Brand#2", "Brand#17", "Brand#13"]) & select.facet_match(F.array("p_name"), [])).select("p_partkey")


@query("SELECT value, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS value FROM part) GROUP BY 1")
def facet_counts(spark, sf_dir):
    return select.facet_counts(table(spark, sf_dir, "part").withColumn("words", F.split("p_type", " ")), "words")


@query("""
WITH seen AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03'), today AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND (user_id NOT IN (SELECT user_id FROM seen) OR user_id IN (SELECT user_id FROM today))
""")
def seen_filter(spark, sf_dir):
    e = instants(spark, sf_dir)
    seen, today = e.where("ts < '2024-01-03'").select("user_id").distinct(), e.where("ts >= '2024-01-30'").select("user_id").distinct()
    return select.unseen(e.where("ts >= '2024-01-29'"), "user_id", seen, today).select("event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no-price' WHEN o_totalprice > 200000 THEN 'too-large' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'too-old' END AS reason FROM orders
""")
def item_verdict(spark, sf_dir):
    return checks.first_reason(table(spark, sf_dir, "orders"), [("no-price", F.col("o_totalprice").isNull()), ("too-large", F.col("o_totalprice") > 200000), ("too-old", F.col("o_orderdate").cast("timestamp") < "1993-01-01")]).select("o_orderkey", "reason")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'relegation' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'top' END AS zone FROM supplier")
def zone_lookup(spark, sf_dir):
    rules = spark.createDataFrame([(-100, -1, 1, "relegation"), (0, 49, 2, "mid"), (50, 200, 3, "top")], "`from` int, `to` int, ord int, zone string")
    rows = table(spark, sf_dir, "supplier").withColumn("pos", F.floor(F.col("s_acctbal") / 100).cast("int"))
    return joins.range_lookup(rows, "pos", rules, ["zone"], "ord").select("s_suppkey", "zone")


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN n_name END AS slug FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def cross_walk(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.lit("s").alias("prefix"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("slug"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("s").alias("prefix"), F.col("s_nationkey").alias("id"))
    return joins.cross_walk(rows, ids, ["prefix", "id"], "slug")[0].select("s_suppkey", "slug")


@query("""
WITH p AS (SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND abs(epoch_us(v.ts) - epoch_us(p.ts)) <= 3600000000)
SELECT view_id, min(purchase_id) AS purchase_id FROM p GROUP BY view_id HAVING count(*) = 1
""")
def interval_unique_link(spark, sf_dir):
    e = instants(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("at"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("buy_at"))
    return joins.unique_links(joins.within(views, buys, ["user_id"], "at", "buy_at", 3600), "view_id").select("view_id", "purchase_id")


@query("""
WITH p AS (SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 129600000000),
q AS (SELECT *, count(*) OVER (PARTITION BY click_id) AS a, count(*) OVER (PARTITION BY purchase_id) AS b FROM p)
SELECT click_id, purchase_id FROM q WHERE a = 1 AND b = 1
""")
def mutual_unique_pairs(spark, sf_dir):
    e = instants(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("at"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("buy_at"))
    pairs = joins.within(clicks, buys, ["user_id"], "at", "buy_at", 36 * 3600).select("click_id", "purchase_id")
    once = pairs.groupBy("click_id").agg(F.count("*").alias("n"), F.first("purchase_id").alias("purchase_id")).where("n = 1")
    other = pairs.groupBy("purchase_id").count().where("count = 1")
    return once.join(other, "purchase_id", "left_semi").select("click_id", "purchase_id")


@query("""
SELECT e.event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND abs(epoch_us(c.ts) - epoch_us(e.ts)) <= 10800000000)
""")
def gap_detection(spark, sf_dir):
    e = instants(spark, sf_dir)
    views, clicks = (e.where(F.col("event_type") == t).select("event_id", "user_id", F.col("ts").alias(f"{t}_at")) for t in ("view", "click"))
    return joins.gaps(views, clicks.drop("event_id"), ["user_id"], "view_at", "click_at", 10800, "event_id").select("event_id")


@query("""
SELECT e.event_id, l.event_id AS last_view FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') l ON e.user_id = l.user_id AND e.ts >= l.ts WHERE e.event_type = 'purchase'
""")
def as_of(spark, sf_dir):
    e = instants(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_at"), F.col("event_id").alias("last_view"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_at", ["last_view"]).select("event_id", "last_view")


@query("""
SELECT least(c.c_nationkey, s.s_nationkey) AS a, greatest(c.c_nationkey, s.s_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL
""")
def derby_pairs(spark, sf_dir):
    return matches(spark, sf_dir).withColumn("_", F.lit(1)).groupBy(*[c.alias(n) for c, n in zip(joins.unordered(F.col("home"), F.col("away")), "ab")]).agg(F.count("*").alias("n"))


def matches(spark, sf_dir):
    """Lineitems as matches: customer's nation at home, supplier's away, quantities as goals, ship date as kick-off."""
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    q = F.col("l_quantity").cast("long")
    return rows.select("l_orderkey", "l_linenumber", F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"), (q % 5).alias("hg"), (F.floor(q / 5) % 5).alias("ag"), F.col("l_shipdate").cast("timestamp").alias("kickoff"))


MATCHES = "m AS (SELECT l_orderkey, l_linenumber, c_nationkey AS home, s_nationkey AS away, l_quantity::BIGINT % 5 AS hg, l_quantity::BIGINT // 5 % 5 AS ag, l_shipdate AS kickoff FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
SIDES = MATCHES + ", s AS (SELECT l_orderkey, l_linenumber, kickoff, home AS team, 'home' AS venue, hg AS gf, ag AS ga FROM m UNION ALL SELECT l_orderkey, l_linenumber, kickoff, away, 'away', ag, hg FROM m), r AS (SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' ELSE 'D' END AS result FROM s)"


def sides(spark, sf_dir):
    return aggregate.result_rows(matches(spark, sf_dir), "home", "away", "hg", "ag", ["l_orderkey", "l_linenumber", "kickoff"])


@query(f"WITH {SIDES} SELECT team, count(*) AS played, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'D') AS d, count(*) FILTER (result = 'L') AS l, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, 3 * count(*) FILTER (result = 'W') + count(*) FILTER (result = 'D') AS pts FROM r GROUP BY team")
def unpivot_standings(spark, sf_dir):
    return aggregate.standings(sides(spark, sf_dir))


@query(f"WITH {SIDES} SELECT team, venue, count(*) FILTER (ga = 0) AS clean_sheets, count(*) FILTER (gf = 0) AS scoreless, count(*) FILTER (gf + ga >= 3) AS open_games FROM r GROUP BY ALL")
def venue_splits(spark, sf_dir):
    return sides(spark, sf_dir).groupBy("team", "venue").agg(F.count_if(F.col("ga") == 0).alias("clean_sheets"), F.count_if(F.col("gf") == 0).alias("scoreless"), F.count_if(F.col("gf") + F.col("ga") >= 3).alias("open_games"))


@query(f"""
WITH {MATCHES}, t AS (SELECT year(kickoff)::INT AS season, least(home, away) AS a, greatest(home, away) AS b, CASE WHEN home < away THEN hg ELSE ag END AS x, CASE WHEN home < away THEN ag ELSE hg END AS y FROM m WHERE home <> away)
SELECT season, a, b, count(*) AS legs, sum(x)::BIGINT AS goals_a, sum(y)::BIGINT AS goals_b, CASE WHEN sum(x) > sum(y) THEN a WHEN sum(x) < sum(y) THEN b END AS winner FROM t GROUP BY season, a, b
""")
def two_leg_ties(spark, sf_dir):
    return aggregate.two_legs(matches(spark, sf_dir).withColumn("season", F.year("kickoff")), ["season"], "home", "away", "hg", "ag")


@query("SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'signup') AS attempts, count(*) FILTER (event_type IN ('click', 'purchase')) AS ok, floor(count(*) FILTER (event_type IN ('click', 'purchase')) / nullif(count(*) FILTER (event_type <> 'signup'), 0) * 1000 + 0.5) / 1000 AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1")
def source_stats(spark, sf_dir):
    ok, tried = F.count_if(F.col("event_type").isin("click", "purchase")), F.count_if(F.col("event_type") != "signup")
    return instants(spark, sf_dir).where("ts >= '2024-01-23'").groupBy("user_id").agg(F.count("*").alias("runs"), tried.alias("attempts"), ok.alias("ok"), aggregate.ratio(ok, tried, 3).alias("rate"))


@query("SELECT strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m') AS month, o_orderpriority AS env, sum(o_totalprice::DECIMAL(18,6))::VARCHAR AS spent FROM orders GROUP BY ALL")
def money_by_month(spark, sf_dir):
    month = F.date_format(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Seoul"), "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month"), F.col("o_orderpriority").alias("env")).agg(aggregate.money(F.col("o_totalprice")).cast("string").alias("spent"))


@query("""
WITH v AS (SELECT l_suppkey, l_quantity > 5 AS appeared, CASE WHEN l_linenumber % 7 = 0 AND l_suppkey % 3 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem)
SELECT l_suppkey, count(*) FILTER (appeared) AS apps, CASE WHEN count(*) FILTER (appeared AND x IS NULL) = 0 THEN coalesce(sum(x) FILTER (appeared), 0) END AS minutes FROM v GROUP BY 1
""")
def null_poison_sum(spark, sf_dir):
    x = F.when((F.col("l_linenumber") % 7 == 0) & (F.col("l_suppkey") % 3 == 0), None).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 5).alias("appeared"), x.alias("x"))
    return rows.groupBy("l_suppkey").agg(F.count_if("appeared").alias("apps"), aggregate.poisoned_sum(F.col("x"), F.col("appeared")).alias("minutes"))


@query("""
WITH p(o_orderpriority, tin, tout) AS (VALUES ('1-URGENT', 3.0, 15.0), ('2-HIGH', 1.0, 5.0), ('3-MEDIUM', 0.8, 4.0), ('4-NOT SPECIFIED', 0.25, 1.25), ('5-LOW', 0.1, 0.4))
SELECT o_orderkey, ((((o_orderkey % 5000) * tin::DECIMAL(12,6) + (o_custkey % 900) * tout::DECIMAL(12,6)) * CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1.0 END)::DECIMAL(28,7)::DOUBLE / 1000000) AS cost FROM orders JOIN p USING (o_orderpriority)
""")
def token_cost(spark, sf_dir):
    prices = spark.createDataFrame([("1-URGENT", 3.0, 15.0), ("2-HIGH", 1.0, 5.0), ("3-MEDIUM", 0.8, 4.0), ("4-NOT SPECIFIED", 0.25, 1.25), ("5-LOW", 0.1, 0.4)], "o_orderpriority string, tin double, tout double")
    uses = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 5000).alias("n_in"), (F.col("o_custkey") % 900).alias("n_out"), (F.col("o_orderkey") % 2 == 0).alias("batch"))
    return aggregate.token_cost(uses, prices, "o_orderpriority", {"n_in": "tin", "n_out": "tout"}, "batch").select("o_orderkey", F.col("cost").cast("double").alias("cost"))


@query("""
WITH t AS (SELECT user_id, count(DISTINCT ts::DATE) AS days, count(DISTINCT value::INT) AS errors, string_agg(DISTINCT ts::DATE::VARCHAR, ',' ORDER BY ts::DATE::VARCHAR) AS dates FROM events WHERE event_type = 'error' GROUP BY 1) SELECT * FROM t
""")
def failure_days(spark, sf_dir):
    e = instants(spark, sf_dir).where("event_type = 'error'").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id").agg(F.count_distinct("day").alias("days"), F.count_distinct(F.bround("value").cast("int")).alias("errors"), F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ",").alias("dates"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 3 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS score,
 array_to_string(list_filter([CASE WHEN o_totalprice > 150000 THEN 'big' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders
""")
def additive_rules(spark, sf_dir):
    score, names = aggregate.additive_score({"big": (F.col("o_totalprice") > 150000, 3), "urgent": (F.col("o_orderpriority") == "1-URGENT", 2), "final": (F.col("o_orderstatus") == "F", 1)})
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"), F.array_join(names, ",").alias("reasons"))


@query("SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (l_linenumber <= 3), 0) = sum(l_quantity) AS complete FROM lineitem GROUP BY 1")
def array_completeness(spark, sf_dir):
    goals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("g"), F.sum("l_quantity").alias("total"))
    return goals.select("l_orderkey", (F.expr("aggregate(filter(g, x -> x.l_linenumber <= 3), 0D, (a, x) -> a + x.l_quantity)") == F.col("total")).alias("complete"))


@query("""
SELECT 'lineitem.l_suppkey' AS rule, l_suppkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY ALL
UNION ALL SELECT 'orders.o_custkey', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY ALL
""")
def fk_audit(spark, sf_dir):
    l, o, s, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer"))
    return joins.missing_keys("lineitem.l_suppkey", l, "l_suppkey", s.where("s_acctbal >= 0"), "s_suppkey").unionByName(joins.missing_keys("orders.o_custkey", o, "o_custkey", c.where("c_mktsegment <> 'BUILDING'"), "c_custkey"))


@query("""
WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'O'), o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P')
SELECT id, CASE WHEN n.id IS NOT NULL THEN n.price ELSE o.price END AS price, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN n.price = o.price AND n.status = o.status THEN 'same' ELSE 'replaced' END AS change FROM n FULL JOIN o USING (id)
""")
def upsert_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    new = o.where("status <> 'O'").withColumn("price", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("price") + 1).otherwise(F.col("price")))
    return select.upsert(o.where("status <> 'P'").drop("o_orderpriority"), new, "id", ["status", "price"]).select("id", "price", "change")


@query("SELECT user_id, epoch_us(min(ts))::BIGINT AS first_at FROM events GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-01 12:00:00'")
def first_seen_ttl(spark, sf_dir):
    e = instants(spark, sf_dir)
    kept = select.first_seen(e.where("ts < '2024-01-15'"), e.where("ts >= '2024-01-15'"), "user_id", "ts", F.lit("2024-03-31 12:00:00").cast("timestamp"), 90)
    return kept.select("user_id", F.unix_micros("ts").alias("first_at"))


@query("""
WITH l AS (SELECT l_orderkey AS id, l_linenumber - 1 AS pos, 's' || (l_suppkey % 4) AS name, l_shipdate AS seen, o_orderdate AS created, CASE l_suppkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 700 END AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
g AS (SELECT *, coalesce(epoch(least(seen, created)) + days * 86400 - 108000 <= epoch(TIMESTAMP '1994-01-01'), false) AS gone, row_number() OVER (PARTITION BY id ORDER BY pos, name, seen) AS rn FROM l)
SELECT id, coalesce(string_agg(name, ',' ORDER BY rn) FILTER (NOT gone), '') AS names, count(*) FILTER (gone) AS dropped FROM g GROUP BY id HAVING NOT bool_or(gone AND rn = 1)
""")
def retention_purge(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    src = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("name"), F.col("l_shipdate").cast("timestamp").alias("at")))), lambda x: F.struct(x["name"].alias("name"), x["at"].alias("at"))).alias("src"))
    cards = src.join(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created")), "id")
    sources = spark.createDataFrame([("s0", 30), ("s1", 700)], "name string, days int")
    gone = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return select.purge_sources(cards, sources, gone, F.lit("1994-01-01").cast("timestamp")).select("id", F.array_join("names", ",").alias("names"), "dropped")


@query("SELECT r_name AS publisher, count(DISTINCT coalesce(n_nationkey % 3, -1)) AS settings FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(DISTINCT coalesce(n_nationkey % 3, -1)) > 1")
def retention_conflict(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return checks.conflicts(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("publisher"), (F.col("n_nationkey") % 3).alias("days")), "publisher", "days")


@query("""
SELECT 'duplicate' AS rule, l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT 'range', count(*) FILTER (l_discount > 0.08)::VARCHAR, count(*) FROM lineitem
UNION ALL SELECT 'floor', 'O', count(*) FROM orders WHERE o_orderstatus = 'O' HAVING count(*) < 1000000
""")
def constraint_report(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    twice = checks.duplicates("duplicate", l.where("l_linenumber <= 2"), "l_orderkey")
    over = l.agg(F.count_if(F.col("l_discount") > 0.08).cast("string").alias("key"), F.count("*").alias("n")).select(F.lit("range").alias("rule"), "key", "n")
    return twice.unionByName(over).unionByName(checks.at_least("floor", o.where("o_orderstatus = 'O'"), "O", 1_000_000))


@query("SELECT p_partkey, (greatest(a, b) + 0.05) / (least(a, b) + 0.05) AS ratio FROM (SELECT p_partkey, CASE WHEN p_size / 50.0 <= 0.04045 THEN p_size / 50.0 / 12.92 ELSE pow((p_size / 50.0 + 0.055) / 1.055, 2.4) END AS a, 1.0 AS b FROM part)")
def contrast(spark, sf_dir):
    grey = (F.col("p_size") / 50.0).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", checks.contrast((grey, grey, grey), (F.lit(1.0),) * 3).alias("ratio"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS \"right\", count(*) FILTER (value <= 50) AS wrong, count(*) FILTER (value IS NULL) AS unjudged, count(*) FILTER (value > 50) / nullif(count(value), 0) AS accuracy FROM events GROUP BY 1")
def judgement_tally(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*aggregate.tally(F.col("value") > 50))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority)::INT + grouping(o_orderstatus)::INT AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def facet_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), (F.grouping("o_orderpriority") + F.grouping("o_orderstatus")).cast("int").alias("level"))
