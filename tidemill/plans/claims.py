"""Statements in titles: stages around a name, claims, speech, lines from templates and their check against facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import cards, checks, keywords
from tidemill.plans.registry import query
from tidemill.session import table

#: Stages of a move, the strongest first.
STAGES = (
    ("official", rf"{keywords.ANCHOR} (?:signs|has signed) for"),
    ("talks", rf"{keywords.ANCHOR} in talks with"),
    ("rumour", rf"(?:interest in|linked with) {keywords.ANCHOR}"),
)
TITLES = """o AS (SELECT o_orderkey AS id, c_name AS player, n_name AS "to", o_orderkey % 7 AS k, o_orderstatus AS s, c_nationkey, o_orderkey
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT *, CASE s WHEN 'F' THEN player || ' signs for ' || "to" WHEN 'P' THEN 'Report: ' || player || ' in talks with ' || "to" ELSE "to" || CASE WHEN k < 4 THEN ' show interest in ' ELSE ' forget ' END || player END AS title FROM o),
g AS (SELECT *, CASE WHEN s = 'F' THEN 'official' WHEN s = 'P' THEN 'talks' WHEN k < 4 THEN 'rumour' END AS stage,
 CASE WHEN s = 'F' THEN player || ' signs for' WHEN s = 'P' THEN player || ' in talks with' WHEN k < 4 THEN 'interest in ' || player END AS evidence FROM t)"""


def titles(spark, sf_dir):
    """Orders told as titles: a customer as player, a nation as club."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("player"), F.col("n_name").alias("to"), (F.col("o_orderkey") % 7).alias("k"), F.col("o_orderstatus").alias("s"))
    kind = F.when(F.col("s") == "F", "signs").when(F.col("s") == "P", "talks").when(F.col("k") < 4, "interest").otherwise("forget")
    lines = {"signs": "{player} signs for {to}", "talks": "Report: {player} in talks with {to}", "interest": "{to} show interest in {player}", "forget": "{to} forget {player}"}
    return rows.withColumn("title", text.fill_template(kind, lines, {"player": F.col("player"), "to": F.col("to")}))


@query(f"WITH {TITLES} SELECT id, title FROM t")
def template_lines(spark, sf_dir):
    return titles(spark, sf_dir).select("id", "title")


@query(f"WITH {TITLES} SELECT id, stage, evidence FROM g WHERE stage IS NOT NULL")
def anchored_stages(spark, sf_dir):
    found = titles(spark, sf_dir).select("id", F.explode(keywords.anchored(F.col("title"), F.col("player"), STAGES)).alias("x"))
    return found.select("id", "x.stage", "x.evidence")


@query(f"""
WITH {TITLES}, r AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'no-player' WHEN id % 11 = 1 THEN 'many-players' WHEN stage IS NULL THEN 'no-stage' WHEN id % 5 = 0 AND s = 'P' THEN 'many-clubs' WHEN k = 3 THEN 'same-club' END AS reason FROM g)
SELECT id, CASE WHEN reason IS NULL THEN player END AS player, CASE WHEN reason IS NULL AND k = 2 THEN 'FREE' END AS "from", CASE WHEN reason IS NULL THEN "to" END AS "to",
 CASE WHEN reason IS NULL THEN stage END AS status, CASE WHEN reason IS NULL THEN evidence END AS evidence, reason FROM r
""")
def title_claims(spark, sf_dir):
    rows = titles(spark, sf_dir)
    players = F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).when(F.col("id") % 11 == 1, F.array("player", F.lit("zz"))).otherwise(F.array("player"))
    club = lambda c, role: F.struct(c.alias("club"), F.lit(role).alias("role"))
    none = F.lit(None).cast("string")
    origin = F.when(F.col("k") == 2, "FREE").when(F.col("k") == 3, F.col("to")).otherwise(none)
    second = F.when((F.col("id") % 5 == 0) & (F.col("s") == "P"), "OTHER").otherwise(none)
    clubs = F.array(club(F.col("to"), "to"), club(origin, "from"), club(second, "to"))
    return cards.title_claims(rows, rows.select("id", F.explode(players).alias("player")), rows.select("id", F.inline(clubs)).where("club IS NOT NULL"), STAGES)


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'colon' WHEN s_suppkey % 4 = 1 THEN 'before' WHEN s_suppkey % 4 = 2 THEN 'after' END AS form FROM supplier
""")
def speech_forms(spark, sf_dir):
    lines = {"0": '{name}: "we go on"', "1": '{name} said "we go on"', "2": '"We go on", says {name}', "3": 'The "{name}" cup'}
    rows = table(spark, sf_dir, "supplier").withColumn("title", text.fill_template((F.col("s_suppkey") % 4).cast("string"), lines, {"name": F.col("s_name")}))
    return rows.select("s_suppkey", keywords.speech(F.col("title"), F.col("s_name"), ("said", "says")).alias("form"))


@query("""
WITH f AS (SELECT o_custkey AS k, count(*) AS orders, max(o_orderstatus) AS status FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, coalesce(orders, 0) + (c_custkey % 5 = 0)::INT AS orders, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 3 = 1 THEN status ELSE 'P' END END AS status FROM customer LEFT JOIN f ON k = c_custkey)
SELECT c.k, CASE WHEN f.k IS NULL THEN 'unknown' ELSE concat_ws(',', CASE WHEN c.orders <> f.orders THEN 'orders' END, CASE WHEN c.status <> f.status THEN 'status' END) END AS mismatches FROM c LEFT JOIN f ON f.k = c.k
""")
def fact_check(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("status"))
    said = table(spark, sf_dir, "customer").join(facts, F.col("k") == F.col("c_custkey"), "left")
    status = F.when(F.col("c_custkey") % 3 == 1, F.col("status")).when(F.col("c_custkey") % 3 == 2, "P")
    claims = said.select(F.col("c_custkey").alias("k"), (F.coalesce("orders", F.lit(0)) + (F.col("c_custkey") % 5 == 0).cast("int")).alias("orders"), status.alias("status"))
    return checks.fact_mismatches(claims, facts, ["k"], ["orders", "status"]).select("k", F.array_join("mismatches", ",").alias("mismatches"))
