"""Windows, rankings, streaks, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions.dates import iso_week
from tidemill.operators import keywords, select, windows
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query
from tidemill.plans.relations import SIDES, sides
from tidemill.session import table


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))


@query("""
WITH d AS (SELECT doc_id, text, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
s AS (SELECT doc_id, lang, source, 1.0 * CASE substr(source, 4)::INT % 3 WHEN 0 THEN 1.25 WHEN 1 THEN 1.0 ELSE 0.8 END * CASE WHEN length(text) > 2000 THEN 1.3 ELSE 1 END * pow(0.5, (doc_id % 48) / 24.0) * CASE WHEN lang = 'en' THEN 1 ELSE 0.5 END AS score FROM d WHERE rn = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang, source = 'src0' ORDER BY score DESC, doc_id) AS irn FROM s),
c AS (SELECT *, source = 'src0' AND irn <= 5 AS c1 FROM q), k AS (SELECT *, sum(c1::INT) OVER (PARTITION BY lang) AS taken, row_number() OVER (PARTITION BY lang, c1 ORDER BY score DESC, doc_id) AS rr FROM c)
SELECT lang, doc_id, source, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::INT AS rank FROM k WHERE c1 OR rr <= 20 - taken
""")
def entry_ranked_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    first = select.first_of(docs.select("key", "doc_id", "lang", "source", (F.length("text") > 2000).alias("long")), ["key"], [F.col("doc_id")])
    tier = F.substring("source", 4, 9).cast("int") % 3 + 1
    no = F.lit(False)
    score = keywords.composite_score(F.lit(1.0), tier, no, F.col("long"), no, no, F.lit(1), (F.col("doc_id") % 48).cast("double"), F.col("lang") == "en")
    rows = first.select("doc_id", "lang", "source", score.alias("score"))
    return windows.with_quota(rows, ["lang"], F.col("source") == "src0", [F.desc("score"), F.col("doc_id")], 20, 5).select("lang", "doc_id", "source", "score", "rank")


QUOTA = """
WITH q AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus = 'P' AS inq, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey) AS irn FROM orders),
c AS (SELECT *, inq AND irn <= 7 AS c1 FROM q), k AS (SELECT *, sum(c1::INT) OVER (PARTITION BY o_orderpriority) AS taken, row_number() OVER (PARTITION BY o_orderpriority, c1 ORDER BY o_totalprice DESC, o_orderkey) AS rr FROM c)
SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM k WHERE c1 OR rr <= 20 - taken
"""


@query(QUOTA)
def quota_topn(spark, sf_dir):
    rows = windows.with_quota(orders(spark, sf_dir), ["o_orderpriority"], F.col("o_orderstatus") == "P", [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 7)
    return rows.select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n(spark, sf_dir):
    return orders(spark, sf_dir).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS form FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5 GROUP BY 1")
def last5_form(spark, sf_dir):
    last = windows.last_list(orders(spark, sf_dir), ["o_custkey"], ["at", "o_orderkey"], "o_orderstatus", 5)
    return last.select("o_custkey", F.array_join("o_orderstatus", "").alias("form"))


@query(f"WITH {SIDES}, g AS (SELECT team, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga FROM r GROUP BY team) SELECT team, rank() OVER (ORDER BY gf DESC)::INT AS attack, rank() OVER (ORDER BY ga)::INT AS defence, CASE WHEN rank() OVER (ORDER BY gf DESC) <= floor(count(*) OVER () / 3.0 + 0.5) THEN 'top' WHEN rank() OVER (ORDER BY gf DESC) <= count(*) OVER () - floor(count(*) OVER () / 3.0 + 0.5) THEN 'middle' ELSE 'bottom' END AS band FROM g")
def competition_rank(spark, sf_dir):
    g = sides(spark, sf_dir).groupBy("team").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    attack, n = F.rank().over(Window.orderBy(F.desc("gf"))), F.count("*").over(Window.partitionBy())
    third = F.floor(n / 3 + 0.5)
    return g.select("team", attack.alias("attack"), F.rank().over(Window.orderBy("ga")).alias("defence"), F.when(attack <= third, "top").when(attack <= n - third, "middle").otherwise("bottom").alias("band"))


@query(f"""
WITH {SIDES}, o AS (SELECT *, sum((result = 'L')::INT) OVER (PARTITION BY team ORDER BY kickoff DESC, l_orderkey DESC, l_linenumber DESC, venue DESC) AS stops FROM r)
SELECT team, count(*) FILTER (stops = 0) AS streak FROM o GROUP BY team
""")
def trailing_streak(spark, sf_dir):
    rows = sides(spark, sf_dir)
    out = windows.trailing(rows, "team", ["kickoff", "l_orderkey", "l_linenumber", "venue"], F.col("result") != "L", F.col("result") == "L", "kickoff")
    return out.select("team", "streak")


@query("""
WITH o AS (SELECT *, sum((event_type IN ('click', 'purchase'))::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS stops FROM events)
SELECT user_id, count(*) FILTER (stops = 0 AND event_type IN ('error', 'view')) AS streak, epoch_us(min(ts) FILTER (stops = 0 AND event_type IN ('error', 'view')))::BIGINT AS since FROM o GROUP BY 1
""")
def skip_stop_streak(spark, sf_dir):
    kind = F.col("event_type")
    out = windows.trailing(instants(spark, sf_dir), "user_id", ["ts", "event_id"], kind.isin("error", "view"), kind.isin("click", "purchase"), "ts")
    return out.select("user_id", "streak", F.unix_micros("since").alias("since"))


@query("""
WITH s AS (WITH o AS (SELECT *, sum((event_type IN ('click', 'purchase'))::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS stops FROM events) SELECT user_id, count(*) FILTER (stops = 0 AND event_type IN ('error', 'view')) AS n FROM o GROUP BY 1)
SELECT user_id, CASE WHEN n >= 7 THEN 'stale' WHEN n >= 3 THEN 'failing' END AS health FROM s
""")
def health_event(spark, sf_dir):
    kind = F.col("event_type")
    out = windows.trailing(instants(spark, sf_dir), "user_id", ["ts", "event_id"], kind.isin("error", "view"), kind.isin("click", "purchase"), "ts")
    return out.select("user_id", keywords.cascade([("stale", F.col("streak") >= 7), ("failing", F.col("streak") >= 3)]).alias("health"))


@query("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type <> 'error'), i AS (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS g FROM d), r AS (SELECT user_id, count(*) AS n FROM i GROUP BY user_id, g)
SELECT user_id, max(n) AS longest FROM r GROUP BY 1
""")
def longest_streak(spark, sf_dir):
    return windows.longest_run(instants(spark, sf_dir).withColumn("day", F.to_date("ts")), "user_id", "day", F.col("event_type") != "error")


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), k AS (SELECT *, ceil(n / 4.0)::BIGINT AS k FROM n), b AS (SELECT *, n // k AS b, n % k AS e FROM k)
SELECT o_orderkey, CASE WHEN i < e * (b + 1) THEN i // (b + 1) ELSE e + (i - e * (b + 1)) // b END + 1 AS chunk FROM b
""")
def even_chunks(spark, sf_dir):
    return windows.chunks(orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderkey")], 4).select("o_orderkey", "chunk")


@query("SELECT r_name, n_name, ntile(3) OVER (PARTITION BY r_name ORDER BY n_name)::INT AS chunk FROM nation JOIN region ON n_regionkey = r_regionkey")
def ntile_chunks(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", F.ntile(3).over(Window.partitionBy("r_name").orderBy("n_name")).alias("chunk"))


@query("SELECT o_custkey, o_orderpriority, uses FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY uses DESC, last_used DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS uses, max(o_orderdate) AS last_used FROM orders GROUP BY ALL)) WHERE rn = 1")
def mode_recent(spark, sf_dir):
    return windows.mode_recent(orders(spark, sf_dir), ["o_custkey"], "o_orderpriority", "at").select("o_custkey", "o_orderpriority", "uses")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders)
SELECT o_custkey, day::VARCHAR AS day, lag(day) OVER w ::VARCHAR AS before, lead(day) OVER w ::VARCHAR AS after, min(day) OVER (PARTITION BY o_custkey)::VARCHAR AS first, max(day) OVER (PARTITION BY o_custkey)::VARCHAR AS latest, row_number() OVER w ::INT AS position, count(*) OVER (PARTITION BY o_custkey) AS of FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)
""")
def neighbours(spark, sf_dir):
    out = windows.neighbours(orders(spark, sf_dir).withColumn("day", F.to_date("at")), "o_custkey", "day")
    return out.select("o_custkey", *[F.col(c).cast("string").alias(c) for c in ("day", "before", "after", "first", "latest")], "position", "of")


@query("""
WITH s AS (SELECT unnest(range(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-06', INTERVAL 1 DAY))::DATE AS day), d AS (SELECT day, row_number() OVER (ORDER BY day)::INT AS ordinal FROM (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase' AND value > 95))
SELECT day::VARCHAR AS day, ordinal, CASE WHEN ordinal IS NULL THEN 'missing' ELSE 'published' END AS state FROM s LEFT JOIN d USING (day)
""")
def calendar_densify(spark, sf_dir):
    rows = instants(spark, sf_dir).where("event_type = 'purchase' AND value > 95").withColumn("day", F.to_date("ts"))
    return windows.densify(rows, "day", F.lit("2023-12-25").cast("date"), F.lit("2024-02-05").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("""
WITH m AS (SELECT o_custkey, percentile_disc(0.5) WITHIN GROUP (ORDER BY epoch(o_orderdate)) AS mid FROM orders GROUP BY 1)
SELECT o_custkey, epoch(min(o_orderdate))::BIGINT AS opens, (epoch(max(o_orderdate)) + 10800)::BIGINT AS closes, count(*) AS n FROM orders JOIN m USING (o_custkey) WHERE abs(epoch(o_orderdate) - mid) <= 90 * 86400 GROUP BY 1
""")
def lower_median_window(spark, sf_dir):
    out = windows.lower_median_window(orders(spark, sf_dir), ["o_custkey"], "at", 90, 3)
    return out.select("o_custkey", F.unix_timestamp("opens").alias("opens"), F.unix_timestamp("closes").alias("closes"), "n")


@query("""
WITH r AS (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY n_nationkey) AS n, s_suppkey = max(s_suppkey) OVER (PARTITION BY n_nationkey) AS me FROM supplier JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT *, max(CASE WHEN me THEN i END) OVER (PARTITION BY n_nationkey) AS at FROM r)
SELECT n_nationkey, s_suppkey, i + 1 AS row_no FROM f WHERE i >= greatest(0, least("at" - 2, n - 5)) AND i < greatest(0, least("at" - 2, n - 5)) + 5
""".replace(" AS at ", ' AS "at" '))
def around_row(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    s = s.withColumn("last", F.max("s_suppkey").over(Window.partitionBy("n_nationkey")))
    return windows.around(s, ["n_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], F.col("s_suppkey") == F.col("last"), 2).select("n_nationkey", "s_suppkey", F.col("row_no").cast("long").alias("row_no"))


@query("""
WITH i AS (SELECT o_custkey, o_orderdate::DATE - 20 AS a, o_orderdate::DATE + 20 AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i), g AS (SELECT *, sum((p IS NULL OR a > p + 1)::INT) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT o_custkey, min(a)::VARCHAR AS a, max(b)::VARCHAR AS b, count(*) AS n FROM g GROUP BY o_custkey, g
""")
def interval_merge(spark, sf_dir):
    d = F.to_date("at")
    rows = orders(spark, sf_dir).select("o_custkey", F.date_sub(d, 20).alias("a"), F.date_add(d, 20).alias("b"))
    return windows.merge_intervals(rows, "o_custkey", "a", "b").select("o_custkey", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "n")


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return windows.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 7, 100).select("doc_id")


@query("SELECT doc_id, lang, turn::INT AS turn FROM (SELECT doc_id, lang, sha256('3:' || doc_id) AS k, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, lang, k, doc_id LIMIT 50")
def stratified_round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("k", F.sha2(F.concat_ws(":", F.lit(3), "doc_id"), 256))
    return windows.round_robin(rows, "lang", [F.col("k"), F.col("doc_id")], F.col("lang"), 50).select("doc_id", "lang", "turn")


@query("SELECT o_custkey, min(o_orderkey) FILTER (o_orderdate = f) AS next_order, epoch(f)::BIGINT AS at FROM (SELECT *, min(o_orderdate) FILTER (o_orderdate > TIMESTAMP '1994-06-01') OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE f IS NOT NULL GROUP BY o_custkey, f".replace(" AS at ", ' AS "at" '))
def next_after(spark, sf_dir):
    rows = orders(spark, sf_dir).where("at > '1994-06-01'")
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("at", "o_orderkey")).alias("next_order"), F.unix_timestamp(F.min("at")).alias("at"))


@query("""
WITH p AS (SELECT strftime(l_shipdate, '%G-%V') AS week, l_suppkey, 3 * count(*) FILTER (l_returnflag = 'R') + 2 * count(*) FILTER (l_returnflag = 'A') + count(*) AS points, sum(l_quantity)::BIGINT AS minutes, count(*) FILTER (l_returnflag = 'R') AS goals FROM lineitem GROUP BY ALL)
SELECT week, l_suppkey, row_number() OVER (PARTITION BY week ORDER BY points DESC, minutes DESC, goals DESC, l_suppkey)::INT AS place, rank() OVER (PARTITION BY week ORDER BY points DESC, minutes DESC, goals DESC) = 1 AS best FROM p
""")
def weekly_best(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("week", iso_week(F.to_date("l_shipdate")))
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    p = li.groupBy("week", "l_suppkey").agg((flag("R") * 3 + flag("A") * 2 + F.count("*")).alias("points"), F.sum("l_quantity").alias("minutes"), flag("R").alias("goals"))
    order = [F.desc("points"), F.desc("minutes"), F.desc("goals")]
    w = Window.partitionBy("week")
    return p.select("week", "l_suppkey", F.row_number().over(w.orderBy(*order, "l_suppkey")).alias("place"), (F.rank().over(w.orderBy(*order)) == 1).alias("best"))


@query("""
SELECT user_id, day::VARCHAR AS day, n, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
""")
def previous_value(spark, sf_dir):
    n = instants(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("day").cast("string").alias("day"), "n", F.lag("n").over(Window.partitionBy("user_id").orderBy("day")).alias("previous"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate >= TIMESTAMP '1995-01-01' AS ahead, row_number() OVER (PARTITION BY o_custkey, o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')), o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, ahead FROM r WHERE rn <= 2
""")
def recent_and_upcoming(spark, sf_dir):
    ahead = F.col("at") >= "1995-01-01"
    near = F.abs(F.unix_timestamp("at") - F.unix_timestamp(F.lit("1995-01-01").cast("timestamp")))
    return windows.top(orders(spark, sf_dir).withColumn("ahead", ahead), ["o_custkey", "ahead"], [near, F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "ahead")
