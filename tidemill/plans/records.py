"""Records of moves, analyses of clusters, and the registry of rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import audit, records
from tidemill.operators.audit import Refers, Row, Size, Unique
from tidemill.plans.folding import ranked
from tidemill.plans.registry import query
from tidemill.session import table

NOW = "1998-06-01"
EVIDENCE = f"""
e AS (SELECT o_orderkey AS card, o_custkey % 300 AS player, CASE WHEN o_custkey % 5 > 0 THEN 't' || o_custkey % 5 END AS "to", CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_orderkey % 4 END AS "from", o_orderdate AS at_, 1 + o_orderkey % 3 AS tier,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS rank FROM orders WHERE o_orderkey % 97 <> 5)"""


@query(f"""
WITH RECURSIVE {EVIDENCE}, n AS (SELECT *, coalesce("to", '-') AS t, row_number() OVER (PARTITION BY player, "to" ORDER BY at_, card) AS i FROM e),
f AS (SELECT player, t, i, rank AS s, CASE WHEN rank = 4 THEN -1 ELSE rank END AS p, true AS changed, at_, card FROM n WHERE i = 1
  UNION ALL SELECT n.player, n.t, n.i, CASE WHEN n.rank = 4 THEN CASE WHEN f.s IN (3, 4) THEN f.s ELSE 4 END WHEN f.s = 4 THEN CASE WHEN n.rank > f.p THEN n.rank ELSE f.s END WHEN n.rank > f.s THEN n.rank ELSE f.s END,
    CASE WHEN n.rank = 4 THEN f.p WHEN f.s = 4 THEN greatest(n.rank, f.p) WHEN n.rank > f.s THEN greatest(f.p, n.rank) ELSE f.p END,
    f.s <> CASE WHEN n.rank = 4 THEN CASE WHEN f.s IN (3, 4) THEN f.s ELSE 4 END WHEN f.s = 4 THEN CASE WHEN n.rank > f.p THEN n.rank ELSE f.s END WHEN n.rank > f.s THEN n.rank ELSE f.s END, n.at_, n.card
  FROM f JOIN n ON n.player = f.player AND n.t = f.t AND n.i = f.i + 1),
h AS (SELECT player, t, arg_max(s, i) AS s, string_agg(CASE WHEN changed THEN (['rumor', 'negotiating', 'agreed', 'official', 'collapsed'])[s + 1] || ':' || card END, ',' ORDER BY at_, card) AS history FROM f GROUP BY ALL),
g AS (SELECT player, t, any_value("to") AS "to", arg_max("from", (at_, card)) FILTER ("from" IS NOT NULL) AS "from", min(tier)::BIGINT AS best_tier, max(at_) AS top, count(*) AS cards FROM n GROUP BY ALL)
SELECT player, "to", (['rumor', 'negotiating', 'agreed', 'official', 'collapsed'])[s + 1] AS status, "from", best_tier, epoch_us(top)::BIGINT AS updated, s = 0 AND top <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS quiet, cards::INT AS cards, history FROM g JOIN h USING (player, t)
""")
def move_records(spark, sf_dir):
    """Orders as evidence of moves, one in 97 taken down."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = ranked(spark, sf_dir)
    evidence = rows.select(k.alias("card"), (c % 300).alias("player"), F.when(c % 5 > 0, F.concat(F.lit("t"), (c % 5).cast("string"))).alias("to"), F.when(k % 3 == 0, F.concat(F.lit("f"), (k % 4).cast("string"))).alias("from"), "rank", (1 + k % 3).alias("tier"), "at")
    twice = evidence.unionByName(evidence.where("card % 50 = 0").withColumn("at", F.timestamp_seconds(F.unix_timestamp("at") + 60)))
    out = records.move_records(twice, evidence.where("card % 97 = 5").select("card"), F.lit(NOW).cast("timestamp"))
    history = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["status"], h["card"].cast("string"))), ",")
    return out.select("player", "to", "status", "from", "best_tier", F.unix_micros("updated").alias("updated"), "quiet", "cards", history.alias("history"))


@query("""
WITH m AS (SELECT o_custkey AS cluster, o_orderkey AS id, o_orderdate AS at_, o_orderpriority AS p, o_orderstatus AS s FROM orders),
t AS (SELECT id, 't' || id % 7 AS slug, 'team' AS kind, 5 AS start FROM m UNION ALL SELECT id, 't' || id % 3, 'team', 9 FROM m WHERE s = 'F' UNION ALL SELECT id, 'p' || id % 5, 'player', 0 FROM m WHERE s = 'O'),
o AS (SELECT cluster, kind, slug, min((at_, id, start)) AS o FROM m JOIN t USING (id) GROUP BY ALL), l AS (SELECT cluster, string_agg(slug, ',' ORDER BY o, slug) FILTER (kind = 'team') AS teams, string_agg(slug, ',' ORDER BY o, slug) FILTER (kind = 'player') AS players, count(*) FILTER (kind = 'player') AS np FROM o GROUP BY 1),
g AS (SELECT cluster, count(*) AS titles, list_sort(list_distinct(list(lower(p[3:6])))) AS signals FROM m GROUP BY 1),
c AS (SELECT cluster, count(DISTINCT 'p' || id % 2) AS n, min('p' || id % 2) AS player, count(DISTINCT id % 3) FILTER (id % 3 > 0) AS nt, min('c' || id % 3) FILTER (id % 3 > 0) AS "to", max(CASE s WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 4 END) AS r FROM m WHERE id % 6 < 4 GROUP BY 1)
SELECT cluster, titles, coalesce(teams, '') AS teams, coalesce(players, '') AS players, array_to_string(signals, ',') AS signals, CASE WHEN list_contains(signals, 'urge') AND np > 0 THEN 'transfer' WHEN list_contains(signals, 'high') THEN 'result' WHEN coalesce(teams, '') <> '' THEN 'club' END AS category,
 list_contains(signals, 'high') AS spoiler, CASE WHEN n = 1 THEN player END AS player, CASE WHEN n = 1 AND nt = 1 THEN "to" END AS "to", CASE WHEN n = 1 THEN CASE r WHEN 0 THEN 'collapsed' WHEN 1 THEN 'rumor' ELSE 'official' END END AS status FROM g JOIN l USING (cluster) LEFT JOIN c USING (cluster)
""")
def cluster_reports(spark, sf_dir):
    """Customers as clusters of their orders' titles."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), k.alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderpriority", "o_orderstatus")
    i = F.col("id")
    tag = lambda where, letter, n, kind, start: m.where(where).select("id", F.concat(F.lit(letter), (i % n).cast("string")).alias("slug"), F.lit(kind).alias("kind"), F.lit(start).alias("start"))
    tags = tag("true", "t", 7, "team", 5).unionByName(tag("o_orderstatus = 'F'", "t", 3, "team", 9)).unionByName(tag("o_orderstatus = 'O'", "p", 5, "player", 0))
    signals = m.select("id", F.array(F.lower(F.substring("o_orderpriority", 3, 4))).alias("names"))
    claims = m.where(i % 6 < 4).select("id", F.concat(F.lit("p"), (i % 2).cast("string")).alias("player"), F.when(i % 3 > 0, F.concat(F.lit("c"), (i % 3).cast("string"))).alias("to"), F.when(s == "P", "collapsed").when(s == "O", "rumor").otherwise("official").alias("status"))
    has = lambda x: F.array_contains("signals", x)
    out = records.cluster_analysis(m, tags, signals, claims, [("transfer", has("urge") & (F.size("players") > 0)), ("result", has("high")), ("club", F.size("teams") > 0)], ("high",))
    return out.withColumns({c: F.array_join(c, ",") for c in ("teams", "players", "signals")})


def rules():
    return (
        Row("discount", "lineitem", F.col("l_discount") > 0.09), Row("late", "lineitem", F.col("l_tax") > 0.07, audit.WARN), Row("price", "orders", F.col("o_totalprice") > 499_000), Row("status", "orders", ~F.col("o_orderstatus").isin("F", "O", "P")),
        Unique("line", "lineitem", ("l_orderkey", "l_linenumber")), Unique("order", "orders", ("o_orderkey",)), Refers("customer", "orders", "o_custkey", "small", "c_custkey"), Refers("nation", "small", "c_nationkey", "nation", "n_nationkey"),
        Size("open", "orders", 10**9, F.col("o_orderstatus") == "O", audit.WARN), Size("some", "orders", 1), Size("nations", "nation", 26),
    )


@query("""
SELECT 'discount' AS rule, 'error' AS severity, l_orderkey::VARCHAR AS key, 1::BIGINT AS n FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'late', 'warn', l_orderkey::VARCHAR, 1 FROM lineitem WHERE l_tax > 0.07
UNION ALL SELECT 'price', 'error', o_orderkey::VARCHAR, 1 FROM orders WHERE o_totalprice > 499000 UNION ALL SELECT 'status', 'error', o_orderkey::VARCHAR, 1 FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')
UNION ALL SELECT 'line', 'error', l_orderkey || ':' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'order', 'error', o_orderkey::VARCHAR, count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'customer', 'error', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) GROUP BY o_custkey
UNION ALL SELECT 'open', 'warn', 'orders', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'nations', 'error', 'nation', count(*) FROM nation
""")
def rule_registry(spark, sf_dir):
    """Rules over four tables; customers deep in debt count as missing."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "nation")} | {"small": table(spark, sf_dir, "customer").where("c_acctbal > -900")}
    return audit.audit(t, {"lineitem": "l_orderkey", "orders": "o_orderkey"}, rules())
