"""Cards, leads, merges, claims and plans of work on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import cards, checks, joins, select, selection, windows
from tidemill.plans.calendar import instants
from tidemill.plans.ranking import orders
from tidemill.plans.registry import query
from tidemill.session import table


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_shipdate").cast("timestamp"))


@query("SELECT l_orderkey, string_agg(n, ',' ORDER BY n <> 's' || lead, tier, at_ DESC, u, n) AS sources FROM (SELECT l_orderkey, 's' || l_suppkey AS n, l_suppkey % 3 AS tier, l_shipdate AS at_, l_partkey AS u, max(l_suppkey) OVER (PARTITION BY l_orderkey) AS lead FROM lineitem) GROUP BY 1")
def source_order(spark, sf_dir):
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("n"), (F.col("l_suppkey") % 3).alias("tier"), F.col("at"), F.col("l_partkey").alias("u"))).alias("s"), F.concat(F.lit("s"), F.max("l_suppkey").cast("string")).alias("lead"))
    return rows.select("l_orderkey", F.array_join(cards.source_order(F.col("s"), F.col("lead")), ",").alias("sources"))


@query("SELECT l_orderkey, l_suppkey AS lead FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R')::INT, l_suppkey % 3, l_quantity DESC, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate END DESC NULLS LAST, l_linenumber * 100000 + l_partkey % 100000, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def lead_election(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("tier", F.col("l_suppkey") % 3).withColumn("ord", F.struct(F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000, F.col("l_suppkey")))
    at = F.when(F.col("l_linestatus") != "O", F.col("at"))
    return cards.lead(rows, ["l_orderkey"], F.col("l_returnflag") == "R", "tier", "l_quantity", at, "ord", "l_suppkey")


@query("""
WITH RECURSIVE c AS (SELECT doc_id AS id, unnest([md5(text), source || (doc_id // 100)]) AS k FROM documents),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM c a JOIN c b USING (k)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS owner FROM r GROUP BY 1
""")
def card_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    keys = F.explode(F.array(F.md5("text"), F.concat("source", F.floor(F.col("doc_id") / 100).cast("string"))))
    return cards.merge_by_keys(docs.select("doc_id", keys.alias("k")), "doc_id", "k")


@query("""
WITH g AS (SELECT l_suppkey % 50 AS team, l_partkey AS player, count(*) AS goals, sum(l_quantity) AS assists FROM lineitem GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY team) AS n, min(goals) OVER (PARTITION BY team) AS m FROM g)
SELECT team, player, row_number() OVER (PARTITION BY team ORDER BY goals DESC, assists DESC, player)::INT AS rank FROM s WHERE n < 30 OR goals > m QUALIFY rank <= 3
""")
def top_players(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy((F.col("l_suppkey") % 50).alias("team"), F.col("l_partkey").alias("player")).agg(F.count("*").alias("goals"), F.sum("l_quantity").alias("assists"))
    return cards.top_with_cut(g, ["team"], "goals", [F.desc("goals"), F.desc_nulls_last("assists"), F.col("player")], 3, 30).select("team", "player", "rank")


@query("""
WITH g AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'home' ELSE 'away' END AS side, l_linenumber * 1000000 + l_partkey AS ord, 'p' || (l_suppkey % 4) AS scorer FROM lineitem),
s AS (SELECT *, count(*) FILTER (side = 'home') OVER (PARTITION BY l_orderkey) AS h, count(*) FILTER (side = 'away') OVER (PARTITION BY l_orderkey) AS a, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY ord, scorer) AS n FROM g),
w AS (SELECT *, CASE WHEN h > a THEN 'home' WHEN h < a THEN 'away' END AS winner FROM s), t AS (SELECT l_orderkey, string_agg(scorer, ',' ORDER BY scorer) AS three FROM (SELECT l_orderkey, scorer FROM g GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1)
SELECT l_orderkey, max(winner) AS winner, max(CASE WHEN side = winner AND n = least(h, a) + 1 THEN scorer END) AS decisive, coalesce(max(three), '') AS three FROM w LEFT JOIN t USING (l_orderkey) GROUP BY 1
""")
def decisive_goals(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_returnflag") == "N", "home").otherwise("away").alias("side"), F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("scorer"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    out = cards.decisive(rows.withColumn("ord", F.struct("o", "scorer")), "l_orderkey", "side", "ord", "scorer")
    return out.select("l_orderkey", "winner", "decisive", F.array_join("three", ",").alias("three"))


@query("""
WITH c AS (SELECT o_custkey, 'p' || (o_orderkey % 40 // 39) AS player, 't' || (o_orderkey % 5 // 4) AS "to", CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS rank, o_orderkey % 3 + 1 AS tier, o_orderstatus AS publisher, o_orderdate AS seen FROM orders),
r AS (SELECT o_custkey, rank FROM c WHERE rank <> 4 GROUP BY ALL HAVING rank = 0 OR min(tier) <= 2 OR count(DISTINCT publisher) >= 2), s AS (SELECT o_custkey, max(rank) AS stage FROM r GROUP BY 1),
f AS (SELECT o_custkey, min(player) AS player, CASE WHEN count(DISTINCT "to") = 1 THEN max("to") END AS "to", arg_max(rank, (seen, rank)) AS last FROM c GROUP BY 1 HAVING count(DISTINCT player) = 1)
SELECT o_custkey, player, "to", (CASE WHEN last = 4 AND coalesce(stage, 0) <> 3 THEN 4 ELSE stage END)::INT AS status FROM f LEFT JOIN s USING (o_custkey)
""")
def claim_combination(spark, sf_dir):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).when(p == "4-NOT SPECIFIED", 1).otherwise(0)
    word = lambda c, n: F.concat(F.lit(c), n.cast("string"))
    rows = orders(spark, sf_dir).select("o_custkey", word("p", F.floor(F.col("o_orderkey") % 40 / 39)).alias("player"), word("t", F.floor(F.col("o_orderkey") % 5 / 4)).alias("to"), rank.alias("rank"), (F.col("o_orderkey") % 3 + 1).alias("tier"), F.col("o_orderstatus").alias("publisher"), "at")
    return cards.claims(rows, "o_custkey")


@query("""
WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1)
SELECT user_id, greatest(epoch(TIMESTAMP '2024-01-30') - 183600, coalesce(epoch(date_trunc('second', last)) - 10800, 0))::BIGINT AS start,
 CASE WHEN last IS NULL THEN 'first-run' WHEN epoch(date_trunc('second', last)) - 10800 < epoch(TIMESTAMP '2024-01-30') - 183600 THEN 'capped' ELSE 'last-success' END AS basis FROM l
""")
def low_watermark(spark, sf_dir):
    e = instants(spark, sf_dir)
    out = cards.low_watermark(e, e.select("user_id").distinct(), "user_id", "ts", F.col("event_type") == "purchase", F.lit("2024-01-30").cast("timestamp"), 10800, 51 * 3600)
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "basis")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40")
def fetch_plan(spark, sf_dir):
    done = lines(spark, sf_dir).where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return cards.fetch_plan(orders(spark, sf_dir), done, "o_orderkey", [F.col("o_orderpriority"), F.col("at")], 40).select("o_orderkey")


@query("""
WITH o AS (SELECT c_name AS name, c_custkey % 5 + 1 AS count FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')), s AS (SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), k AS (SELECT c_name AS name FROM customer WHERE c_acctbal < 0)
SELECT name, coalesce(count, 0) + (s.name IS NOT NULL)::INT AS count, CASE WHEN s.name IS NOT NULL THEN '2026-02-01' ELSE '2026-01-15' END AS last, CASE WHEN o.name IS NULL THEN '2026-02-01' ELSE '2026-01-01' END AS first FROM o FULL JOIN s USING (name) WHERE name NOT IN (SELECT name FROM k)
""")
def name_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey", "c_mktsegment", "c_acctbal")
    old = c.where("c_mktsegment IN ('BUILDING', 'AUTOMOBILE')").select("name", (F.col("c_custkey") % 5 + 1).alias("count"), F.lit("2026-01-01").alias("first"), F.lit("2026-01-15").alias("last"))
    return cards.name_counts(old, c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')"), c.where("c_acctbal < 0"), F.lit("2026-02-01"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'old' || s_suppkey ELSE s_name END AS a, CASE WHEN s_nationkey > 12 THEN 'old' ELSE 'new' END AS b, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'a' END, CASE WHEN s_nationkey > 12 THEN 'b' END], lambda x: x IS NOT NULL), ',') AS kept FROM supplier")
def partial_fallback(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    new = s.select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("a"), F.when(F.col("s_nationkey") <= 12, F.lit("new")).alias("b"))
    old = s.select("s_suppkey", F.concat(F.lit("old"), F.col("s_suppkey").cast("string")).alias("a"), F.lit("old").alias("b"))
    return cards.prefer_new(["a", "b"], old, new, "s_suppkey").withColumn("kept", F.array_join("kept", ","))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1")
def history_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", F.md5("text"))
    left = docs.join(docs.where("source = 'src3'").select("doc_id"), "doc_id", "left_anti")
    n = left.groupBy("key").agg(F.count("*").alias("n"))
    return select.first_of(left.select("key", "doc_id", "lang"), ["key"], [F.col("doc_id")]).join(n, "key").select("key", "doc_id", "n")


@query("""
WITH d AS (SELECT md5(text) AS key, doc_id, DATE '2026-01-01' + (doc_id % 40)::INT AS day, lang FROM documents), f AS (SELECT key, arg_min(doc_id, (day, doc_id)) AS doc_id, arg_min(day, (day, doc_id)) AS day, arg_min(lang, (day, doc_id)) AS lang FROM d WHERE day > (SELECT max(day) - 7 FROM d) GROUP BY 1)
SELECT doc_id, day::VARCHAR AS day FROM f WHERE lang = 'en' ORDER BY f.day DESC, doc_id LIMIT 30
""")
def feed_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("day"), "lang")
    latest = d.agg(F.max("day")).first()[0]
    recent = d.where(F.col("day") > F.date_sub(F.lit(latest), 7))
    first = select.first_of(recent, ["key"], [F.col("day"), F.col("doc_id")])
    return first.where("lang = 'en'").orderBy(F.desc("day"), "doc_id").limit(30).select("doc_id", F.col("day").cast("string").alias("day"))


@query("""
WITH p AS (SELECT user_id, max(ts) FILTER (event_type = 'click') AS c, max(ts) FILTER (event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p IS NOT NULL AND epoch_us(p) > epoch_us(c) THEN 'skip: done' WHEN e THEN 'retry' ELSE 'run' END AS decision FROM p
""")
def run_guard(spark, sf_dir):
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    p = instants(spark, sf_dir).groupBy("user_id").agg(at("click").alias("c"), at("purchase").alias("p"), F.bool_or(F.col("event_type") == "error").alias("e"))
    return p.select("user_id", F.when(F.col("p").isNotNull() & (F.col("p") > F.col("c")), "skip: done").when(F.col("e"), "retry").otherwise("run").alias("decision"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE o_orderkey <= before")
def ordered_check(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("place", F.struct("at", "o_orderkey"))
    return checks.out_of_order(rows, ["o_custkey"], "place", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT slug, term FROM (SELECT n_nationkey AS slug, lower(n_name)[1:4] AS term, row_number() OVER (PARTITION BY lower(n_name)[1:4] ORDER BY n_nationkey) AS rn FROM nation WHERE length(n_name) > 4) WHERE rn = 1")
def name_index(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where(F.length("n_name") > 4).select(F.substring(F.lower("n_name"), 1, 4).alias("term"), F.col("n_nationkey").alias("slug"))
    return select.first_of(names, ["term"], [F.col("slug")]).select("slug", "term")


@query("SELECT a.n_name AS x, b.n_name AS y, CASE WHEN list_sort(string_split(lower(a.n_name), ' ')) = list_sort(string_split(lower(b.n_name), ' ')) THEN 'full' END AS basis FROM nation a JOIN nation b ON string_split(lower(a.n_name), ' ')[-1] = string_split(lower(b.n_name), ' ')[-1] WHERE a.n_nationkey < b.n_nationkey OR a.n_nationkey = b.n_nationkey")
def name_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("family", F.element_at(F.split(F.lower("n_name"), " "), -1))
    a, b = n.select("family", F.col("n_name").alias("x"), F.col("n_nationkey").alias("i")), n.select("family", F.col("n_name").alias("y"), F.col("n_nationkey").alias("j"))
    return a.join(b, "family").where("i <= j").select("x", "y", joins.name_match(F.col("x"), F.col("y")).alias("basis"))


#: Parts of the names of query fuzzy_name_join.
FIRST, FAMILY = ("Ann", "Bo", "Zoë", "A.", "B"), ("Lee", "Park", "Diaz", "L", "Ann")


@query("""
WITH n AS (SELECT c_custkey AS id, concat_ws(' ', (['Ann', 'Bo', 'Zoë', 'A.', 'B'])[c_custkey % 5 + 1], CASE WHEN c_nationkey % 3 = 0 THEN (['Ann', 'Bo', 'Zoë', 'A.', 'B'])[c_nationkey % 5 + 1] END, (['Lee', 'Park', 'Diaz', 'L', 'Ann'])[c_nationkey % 5 + 1]) AS name FROM customer),
p AS (SELECT id, list_sort(list_filter(string_split(replace(strip_accents(lower(name)), '.', ' '), ' '), lambda x: x <> '')) AS parts FROM n),
a AS (SELECT DISTINCT parts AS l FROM p WHERE id % 2 = 0), b AS (SELECT DISTINCT parts AS r FROM p WHERE id % 2 = 1),
o AS (SELECT l, r, list_permute FROM a, b, (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS list_permute) WHERE len(l) = len(r) AND l <> r AND len(list_filter(l, lambda x: length(x) > 1 AND list_contains(r, x))) > 0),
q AS (SELECT l, r, list_transform(list_permute[1:3], lambda i: r[i]) AS s FROM o WHERE len(l) = 3 OR list_permute[3] = 3),
f AS (SELECT DISTINCT l, r FROM q WHERE len(list_filter(range(1, len(l) + 1), lambda i: l[i] = s[i] OR (length(l[i]) = 1 AND starts_with(s[i], l[i])) OR (length(s[i]) = 1 AND starts_with(l[i], s[i])))) = len(l))
SELECT array_to_string(l, ' ') AS l, array_to_string(r, ' ') AS r, 'initial' AS basis FROM f UNION ALL SELECT array_to_string(l, ' '), array_to_string(r, ' '), 'full' FROM a JOIN b ON l = r
""")
def fuzzy_name_join(spark, sf_dir):
    """Names of even customers beside those of odd ones."""
    part = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    middle = F.when(F.col("c_nationkey") % 3 == 0, part(FIRST, F.col("c_nationkey")))
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", part(FIRST, F.col("c_custkey")), middle, part(FAMILY, F.col("c_nationkey"))).alias("name"))
    out = joins.fuzzy_names(n.where("id % 2 = 0"), n.where("id % 2 = 1"))
    return out.select(F.array_join("l", " ").alias("l"), F.array_join("r", " ").alias("r"), "basis")


@query()
def ordered_card_merge(spark, sf_dir):
    """Orders as cards in turn, their parts as keys, their customers as ids; the first thousand stand already."""
    ord_ = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(ord_.alias("ord"), F.when(ord_ < 1000, -ord_ - 1).otherwise(F.col("o_custkey")).alias("id"), (ord_ < 1000).alias("existing"))
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("key"))
    return cards.merge_in_order(own, keys.join(own.select("ord"), "ord", "left_semi"))


@query("""
WITH c AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 10)) AS v, list(DISTINCT l_suppkey % 10) FILTER (l_linenumber <= 2) AS w FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_intersect(v, coalesce(w, []))) AS common, len(v) AS all_values FROM c
""")
def common_values(spark, sf_dir):
    v = F.col("l_suppkey") % 10
    c = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set(v).alias("v"), F.collect_set(F.when(F.col("l_linenumber") <= 2, v)).alias("w"))
    return c.select("l_orderkey", F.size(F.array_intersect("v", "w")).cast("long").alias("common"), F.size("v").cast("long").alias("all_values"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_totalprice DESC, o_orderkey)::INT AS rank FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1993-01-01') WHERE rank <= 5")
def hot_list(spark, sf_dir):
    rows = orders(spark, sf_dir).where("o_orderstatus <> 'P' AND at >= '1993-01-01'")
    return windows.top(rows, ["o_custkey"], [F.to_date("at").desc(), F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("""
WITH r AS (SELECT o_orderpriority AS round, min(o_orderdate) AS opens, max(o_orderdate) AS closes FROM orders GROUP BY 1)
SELECT round, CASE WHEN opens <= TIMESTAMP '1995-06-01' AND closes >= TIMESTAMP '1995-06-01' THEN 'live' WHEN opens > TIMESTAMP '1995-06-01' THEN 'ahead' ELSE 'over' END AS state FROM r
""")
def round_state(spark, sf_dir):
    now = F.lit("1995-06-01").cast("timestamp")
    r = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("round")).agg(F.min("at").alias("opens"), F.max("at").alias("closes"))
    return r.select("round", F.when((F.col("opens") <= now) & (F.col("closes") >= now), "live").when(F.col("opens") > now, "ahead").otherwise("over").alias("state"))


@query("SELECT event_id, regexp_extract(props, '\"k\":\\s*([0-9]+)', 1) AS k, len(regexp_extract_all(props, '[0-9]+')) AS numbers FROM events")
def log_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.regexp_extract("props", r'"k":\s*([0-9]+)', 1).alias("k"), F.regexp_count("props", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("""
SELECT strftime(ts, '%G-%V') AS week, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, median(value) AS typical, '- ' || count(*) || ' runs, ' || count(*) FILTER (event_type = 'error') || ' failed' AS line FROM events GROUP BY 1
""")
def ops_report(spark, sf_dir):
    from tidemill.functions.dates import iso_week

    failed = F.count_if(F.col("event_type") == "error")
    rows = instants(spark, sf_dir).withColumn("week", iso_week(F.to_date("ts")))
    out = rows.groupBy("week").agg(F.count("*").alias("runs"), failed.alias("failed")).join(selection.median(rows.withColumn("typical", F.col("value")), ["week"], "typical"), "week", "left")
    return out.withColumn("line", F.format_string("- %d runs, %d failed", "runs", "failed"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/(en|fr)/') THEN true WHEN regexp_matches(url, '/es/') THEN false END AS on_topic FROM pages")
def path_topic(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(u.rlike("/(en|fr)/"), True).when(u.rlike("/es/"), False).alias("on_topic"))


@query("SELECT lang, source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (rn <= 3) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) GROUP BY ALL")
def news_feed_view(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    first = windows.top(d, ["lang", "source"], [F.col("doc_id")], 3).groupBy("lang", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n")).join(first, ["lang", "source"])


@query("SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS peers, n_name = max(n_name) OVER (PARTITION BY n_regionkey) AS last FROM nation")
def peer_counts(spark, sf_dir):
    w = Window.partitionBy("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.count("*").over(w).alias("peers"), (F.col("n_name") == F.max("n_name").over(w)).alias("last"))


@query("""
WITH o AS (SELECT o_orderpriority AS reason, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000),
l AS (SELECT * FROM o WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT reason, count(*) AS n, min(id) AS first, max(id) AS last FROM l GROUP BY 1
""")
def gap_ledger(spark, sf_dir):
    o = orders(spark, sf_dir).select(F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    healed = lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    out = cards.gap_ledger(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F' AND o_totalprice > 300000"), healed, ["reason"])
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type <> 'error') / count(*) AS rate, median(value) AS latency FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, rate, latency, CASE WHEN rate >= 0.9 AND latency < 60 THEN 'good' WHEN rate >= 0.7 THEN 'fair' ELSE 'poor' END AS verdict FROM d
""")
def probe_judgement(spark, sf_dir):
    rows = instants(spark, sf_dir).select(F.to_date("ts").alias("d"), "event_type", F.col("value").alias("latency"))
    d = rows.groupBy("d").agg(F.try_divide(F.count_if(F.col("event_type") != "error"), F.count("*")).alias("rate")).join(selection.median(rows, ["d"], "latency"), "d", "left")
    return d.select(F.col("d").cast("string").alias("day"), "rate", "latency", F.when((F.col("rate") >= 0.9) & (F.col("latency") < 60), "good").when(F.col("rate") >= 0.7, "fair").otherwise("poor").alias("verdict"))


@query("SELECT n_name, s_name, place FROM (SELECT n_name, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE place <= 5")
def league_mini(spark, sf_dir):
    s = windows.top(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 5, "place")
    return s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name", "place")
