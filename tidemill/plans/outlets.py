"""Provider records, registries, search plans, links, entities and what is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.functions.text import srcset_urls
from tidemill.operators import aggregate, cards, joins, select
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query
from tidemill.scratch import new_path
from tidemill.session import table
from tidemill.sources import adapters, readers, sinks

STATUSES = {"F": "finished", "O": "scheduled"}


def provided(spark, sf_dir):
    """Match records as JSON; every 50th text is cut short."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda x: F.struct(x.alias("id"))
    score = F.struct(F.when(k % 7 != 0, k % 5).alias("home"), (k % 4).alias("away"))
    record = F.to_json(F.struct(k.alias("id"), F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, k % 38 + 1).alias("matchday"), F.lit("FINAL").alias("stage"), side(c % 20).alias("home"), side(c % 19).alias("away"), score.alias("score")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 50 == 0, F.lit("{")).otherwise(record).alias("json"))


@query("""
WITH p AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' END AS st FROM orders)
SELECT o_orderkey AS id, st AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'md-' || (o_orderkey % 38 + 1) ELSE 'final' END AS round, o_custkey % 20 AS home, o_custkey % 19 AS away,
  CASE WHEN st = 'finished' AND o_orderkey % 7 <> 0 THEN o_orderkey % 5 END::INT AS home_score, CASE WHEN st = 'finished' AND o_orderkey % 7 <> 0 THEN o_orderkey % 4 END::INT AS away_score,
  CASE WHEN st IS NULL THEN 'unknown-status' WHEN st = 'finished' AND o_orderkey % 7 = 0 THEN 'no-score' WHEN o_custkey % 20 = o_custkey % 19 THEN 'same-side' END AS problem FROM p WHERE o_orderkey % 50 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unreadable' FROM p WHERE o_orderkey % 50 = 0
""")
def match_adapter(spark, sf_dir):
    return adapters.match_rows(provided(spark, sf_dir), "json", STATUSES)


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS place FROM lineitem)
SELECT l_orderkey AS list, place::INT AS place, l_suppkey AS player, 'P' || l_suppkey AS name, l_suppkey % 20 AS team, (l_linenumber % 4)::INT AS goals, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END::INT AS assists FROM s WHERE l_linenumber % 4 > 0
""")
def scorer_adapter(spark, sf_dir):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    entry = F.struct(n.alias("_n"), F.struct(s.alias("id"), F.concat(F.lit("P"), s.cast("string")).alias("name")).alias("player"), F.struct((s % 20).alias("id")).alias("team"), (n % 4).alias("goals"), F.when(n % 3 != 0, n).alias("assists"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("list")).agg(F.array_sort(F.collect_list(entry)).alias("scorers"))
    return adapters.scorer_rows(lists.select("list", F.to_json(F.struct("scorers")).alias("json")), "json", ["list"])


@query("""
WITH e AS (SELECT o_orderkey AS id, unnest(range(0, o_orderkey % 4)) AS ord FROM orders), t AS (SELECT *, (id + ord) % 5 AS kind, (id + ord) % 2 = 0 AS home, (id * 7 + ord * 13) % 90 + 1 AS minute FROM e)
SELECT id, ord::INT AS ord, CASE WHEN home = (kind <> 1) THEN 'home' ELSE 'away' END AS side, id % 11 AS player, minute::INT AS minute, CASE WHEN minute % 45 = 0 THEN 2 ELSE 0 END AS extra, CASE kind WHEN 0 THEN 'goal' WHEN 1 THEN 'own' ELSE 'penalty' END AS kind FROM t WHERE kind < 3
""")
def goal_adapter(spark, sf_dir):
    k = F.col("o_orderkey")

    def event(i):
        minute = (k * 7 + i * 13) % 90 + 1
        return F.struct(F.element_at(F.array(*map(F.lit, ("goal", "own", "penalty", "missed", "card"))), ((k + i) % 5 + 1).cast("int")).alias("type"), F.when((k + i) % 2 == 0, "home").otherwise("away").alias("side"), (k % 11).alias("player"), minute.alias("minute"), F.when(minute % 45 == 0, 2).alias("extra"))

    events = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k % 4 - 1, F.lit(0))), event)).otherwise(F.array())
    return adapters.goal_rows(table(spark, sf_dir, "orders").select(F.to_json(F.struct(k.alias("id"), events.alias("events"))).alias("json")), "json")


@query("""
SELECT o_orderkey, (o_orderkey % 90 + 1)::INT AS minute, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 ELSE 0 END::INT AS extra, (o_orderkey % 5)::INT AS home, CASE WHEN o_orderkey % 5 = 4 THEN 12 ELSE o_orderkey % 3 END::INT AS away FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 = 0
""")
def text_clocks(spark, sf_dir):
    k = F.col("o_orderkey")
    clock = F.concat((k % 90 + 1).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("+"), (k % 6).cast("string"))).otherwise(""), F.lit("'"))
    score = F.concat((k % 5).cast("string"), F.lit(" - "), F.when(k % 5 == 4, 12).otherwise(k % 3).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 10 == 0, "HT").otherwise(clock).alias("c"), F.when(k % 10 == 0, "-").otherwise(score).alias("s"))
    rows = rows.select("o_orderkey", adapters.clock(F.col("c")).alias("c"), adapters.score_pair(F.col("s")).alias("s"))
    return rows.select("o_orderkey", "c.minute", "c.extra", "s.home", "s.away")


@query("""
WITH p AS (SELECT n_name, n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'data/' || lower(n_name) || '.json' WHEN 1 THEN 'data/log/' || n_nationkey || '.txt' WHEN 2 THEN 'conf.jsn' ELSE 'x/' || n_name END AS path FROM nation)
SELECT path, CASE n_nationkey % 4 WHEN 0 THEN 'data/*.json' WHEN 1 THEN 'data/log/?*.txt' END AS pattern, CASE n_nationkey % 4 WHEN 2 THEN 'conf.json' END AS nearest FROM p
""")
def registry_lookup(spark, sf_dir):
    k, name = F.col("n_nationkey"), F.col("n_name")
    path = F.when(k % 4 == 0, F.concat(F.lit("data/"), F.lower(name), F.lit(".json"))).when(k % 4 == 1, F.concat(F.lit("data/log/"), k.cast("string"), F.lit(".txt"))).when(k % 4 == 2, "conf.jsn").otherwise(F.concat(F.lit("x/"), name))
    return readers.registered(table(spark, sf_dir, "nation").select(path.alias("path")), "path", ["data/*.json", "data/log/?*.txt", "conf.json"])


@query("""
WITH q AS (SELECT c_nationkey AS source, c_custkey AS ord, CASE WHEN c_acctbal <= 0 THEN 'disabled' WHEN c_nationkey = 7 THEN 'source missing' WHEN c_nationkey % 5 = 0 THEN 'source blocked' END AS r FROM customer)
SELECT source, ord, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY source, r IS NULL ORDER BY ord) > 3 THEN 'over cap' ELSE 'run' END) AS plan FROM q
""")
def search_plans(spark, sf_dir):
    n = F.col("c_nationkey")
    asked = table(spark, sf_dir, "customer").select(n.alias("source"), F.col("c_custkey").alias("ord"), (F.col("c_acctbal") > 0).alias("enabled"), (n != 7).alias("known"), (n % 5 == 0).alias("blocked"))
    return readers.paged_search(asked, 3).select("source", "ord", "plan")


@query("""
SELECT p_partkey, string_split('/news/img/' || p_partkey || '.png|/news/' || p_size || '.png|/a.png', '|') AS paths FROM part
""")
def page_references(spark, sf_dir):
    srcset = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png?v=1 1x, ./x/../"), F.col("p_size").cast("string"), F.lit(".png 2x, /a.png#b 3x, https://cdn.example/x.png 4x, //cdn.example/y.png"))
    paths = F.transform(srcset_urls(srcset), lambda u: urls.site_path(u, F.lit("/news/today.html")))
    return table(spark, sf_dir, "part").select("p_partkey", F.filter(paths, lambda p: p.isNotNull()).alias("paths"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(run, wrote)")
def unchanged_writes(spark, sf_dir):
    """A table written, written again with another time and order, and written with one more row."""
    rows = table(spark, sf_dir, "nation").withColumn("at", F.current_timestamp())
    path, columns = new_path(spark, "no-op"), ["n_nationkey", "n_name", "n_regionkey"]
    more = rows.unionByName(rows.where("n_nationkey = 0").withColumn("n_nationkey", F.lit(99)))
    wrote = [sinks.write_if_changed(r, path, columns) for r in (rows, rows.orderBy(F.desc("n_name")), more)]
    return spark.createDataFrame(list(enumerate(wrote, 1)), "run int, wrote boolean")


@query(r"""
SELECT o_orderkey, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || o_orderkey, 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(o_orderdate + INTERVAL 2 HOUR, '%Y%m%dT%H%M%SZ'), 'SUMMARY:' || o_orderstatus || '\, ' || o_orderpriority || '\; v', 'END:VEVENT') AS event FROM orders
""")
def calendar_events(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.concat("o_orderstatus", F.lit(", "), "o_orderpriority", F.lit("; v")).alias("summary"))
    return sinks.calendar_event(rows, "o_orderkey", "summary", "at").select("o_orderkey", "event")


@query("""
SELECT event_id, '<item><title>' || event_type || ' &amp; &lt;' || user_id || '&gt;</title><link>https://example.com/' || event_id || '?a=1&amp;b=2</link><pubDate>' || strftime(ts, '%d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS item FROM events
""")
def feed_documents(spark, sf_dir):
    rows = instants(spark, sf_dir).select("event_id", "ts", F.concat("event_type", F.lit(" & <"), F.col("user_id").cast("string"), F.lit(">")).alias("title"), F.concat(F.lit("https://example.com/"), F.col("event_id").cast("string"), F.lit("?a=1&b=2")).alias("link"))
    return sinks.feed_xml(rows, "title", "link", "ts").select("event_id", "item")


@query("""
WITH e AS (SELECT event_id AS id, user_id % 5 AS category, ts, event_type, [user_id] AS players, list_distinct([event_id % 50, event_id % 61 + 50, event_id % 7 + 200]) AS teams FROM events),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.event_type = 'signup' AND b.event_type = 'purchase' AND a.category = b.category AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 129600000000
  AND (len(list_intersect(a.players, b.players)) >= 1 OR len(list_intersect(a.teams, b.teams)) >= 2)), q AS (SELECT *, count(*) OVER (PARTITION BY a) AS x, count(*) OVER (PARTITION BY b) AS y FROM p)
SELECT a, b FROM q WHERE x = 1 AND y = 1
""")
def shared_entity_pairs(spark, sf_dir):
    k = F.col("event_id")
    teams = F.array(*[x.cast("string") for x in (k % 50, k % 61 + 50, k % 7 + 200)])
    rows = instants(spark, sf_dir).select(k.alias("id"), (F.col("user_id") % 5).alias("category"), F.col("ts").alias("at"), "event_type", F.array(F.col("user_id").cast("string")).alias("players"), teams.alias("teams"))
    return joins.shared_links(rows.where("event_type = 'signup'"), rows.where("event_type = 'purchase'"), 36 * 3600)


@query("""
WITH m AS (SELECT year(o_orderdate)::INT AS season, o_orderkey AS at_, o_custkey % 12 AS home, o_orderkey % 13 % 12 AS away, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey % 3 END AS hg, o_custkey % 3 AS ag, CASE WHEN o_orderkey % 5 = 0 THEN 3 + o_custkey % 3 END AS hp, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS ap FROM orders),
t AS (SELECT season, at_, least(home, away) AS a, greatest(home, away) AS b, CASE WHEN home < away THEN hg ELSE ag END AS x, CASE WHEN home < away THEN ag ELSE hg END AS y, CASE WHEN home < away THEN hp - ap ELSE ap - hp END AS p FROM m WHERE home <> away),
g AS (SELECT season, a, b, count(*) AS legs, sum(x)::BIGINT AS goals_a, sum(y)::BIGINT AS goals_b, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS w, arg_max(p, at_) FILTER (p IS NOT NULL) AS p FROM t GROUP BY ALL),
d AS (SELECT *, CASE WHEN w THEN CASE WHEN goals_a <> goals_b THEN goals_a - goals_b ELSE p END END AS lead FROM g)
SELECT season, a, b, legs, goals_a, goals_b, CASE WHEN lead > 0 THEN a WHEN lead < 0 THEN b END AS winner, CASE WHEN coalesce(lead, 0) = 0 THEN 'unresolved' WHEN goals_a <> goals_b THEN 'aggregate' ELSE 'pens' END AS by FROM d
""")
def tie_decisions(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), k.alias("at"), (c % 12).alias("home"), (k % 13 % 12).alias("away"), F.when(k % 101 != 0, k % 3).alias("hg"), (c % 3).alias("ag"), F.when(k % 5 == 0, c % 3 + 3).alias("hp"), F.when(k % 5 == 0, F.lit(4).cast("long")).alias("ap"))
    return aggregate.tie_decisions(m, ["season"], "home", "away", "hg", "ag", "at", "hp", "ap")


@query("SELECT l_orderkey, arg_min(l_linenumber, (-coalesce(i, -1), l_linenumber)) AS lead FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_partkey % 4 END AS i FROM lineitem) GROUP BY 1")
def lead_index(spark, sf_dir):
    n = F.col("l_linenumber")
    return cards.lead_index(table(spark, sf_dir, "lineitem").withColumn("imp", F.when(n != 2, F.col("l_partkey") % 4)), ["l_orderkey"], "imp", "l_linenumber")


@query("""
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS rank FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND NOT (event_type = 'purchase' AND event_id % 3 = 0)) SELECT * FROM c WHERE rank <= 8
""")
def auxiliary_list(spark, sf_dir):
    e = instants(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    evidence = e.where("event_type = 'purchase' AND event_id % 3 = 0")
    return cards.auxiliary_list(e, evidence, ["user_id"], "event_id", "ts", F.lit("2024-01-10").cast("timestamp"), 8).select("user_id", "event_id", "rank")


@query("""
WITH RECURSIVE n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, ts AS anchor FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN epoch_us(n.ts) - epoch_us(w.anchor) <= 43200000000 THEN w.anchor ELSE n.ts END FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1),
s AS (SELECT user_id, anchor, event_id, unnest(list_distinct([event_id % 3, event_id // 3 % 3])) AS score FROM w), m AS (SELECT user_id, anchor, count(*) AS n, min(event_id) AS entity, min(CASE WHEN event_id % 6 = 0 THEN event_id END) AS card, count(DISTINCT CASE WHEN event_id % 6 = 0 THEN event_id END) AS cards FROM w GROUP BY 1, 2),
k AS (SELECT user_id, anchor, max(c) AS c FROM (SELECT user_id, anchor, score, count(*) AS c FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT w.event_id, m.entity, m.card FROM w JOIN m USING (user_id, anchor) JOIN k USING (user_id, anchor) WHERE m.n >= 2 AND m.cards <= 1 AND k.c = m.n
""")
def entity_merges(spark, sf_dir):
    k = F.col("event_id")
    rows = instants(spark, sf_dir).select("user_id", "event_id", "ts", F.array(k % 3, F.floor(k / 3) % 3).alias("scores"), F.when(k % 6 == 0, k).alias("card"))
    return cards.entity_merges(rows, "user_id", "event_id", "ts", "scores", "card")


@query("SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS gone, (SELECT avg((c_custkey NOT IN (SELECT o_custkey FROM orders))::INT) > 0.2 FROM customer) AS refused FROM customer")
def roster_prune(spark, sf_dir):
    return select.prune_plan(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 0.2)


@query("""
WITH m AS (SELECT o_orderkey, o_custkey % 20 AS home, o_orderkey % 19 AS away, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 END AS hg, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 3 END AS ag FROM orders)
SELECT o_orderkey, home AS team, 'home' AS venue, hg AS gf, ag AS ga, CASE WHEN hg > ag THEN 'W' WHEN hg < ag THEN 'L' WHEN hg = ag THEN 'D' END AS result FROM m WHERE home = 3
UNION ALL SELECT o_orderkey, away, 'away', ag, hg, CASE WHEN ag > hg THEN 'W' WHEN ag < hg THEN 'L' WHEN ag = hg THEN 'D' END FROM m WHERE away = 3
""")
def team_fixtures(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    done = F.col("o_orderstatus") == "F"
    m = table(spark, sf_dir, "orders").select("o_orderkey", (c % 20).alias("home"), (k % 19).alias("away"), F.when(done, k % 4).alias("hg"), F.when(done, c % 3).alias("ag"))
    return aggregate.result_rows(m.where("home = 3 OR away = 3"), "home", "away", "hg", "ag", ["o_orderkey"]).where("team = 3")
