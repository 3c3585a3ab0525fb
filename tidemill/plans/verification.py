"""Statements about matches, one wrong thing in each, held against the matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import facts
from tidemill.plans.registry import query
from tidemill.session import table


def match_facts(spark, sf_dir):
    """An order as a match."""
    k = F.col("o_orderkey")
    home = F.col("o_custkey") % 20
    rows = table(spark, sf_dir, "orders").select(k.alias("ref"), home.alias("home"), ((home + 1 + k % 19) % 20).alias("away"), (k % 4).alias("hg"), (F.floor(k / 4) % 3).alias("ag"), (k % 38).alias("round"), (k % 10 == 0).alias("extra"))
    goals = lambda n, side, letter, late: F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= n), lambda i: F.struct((i * 10 + late).alias("minute"), F.lit(side).alias("side"), F.concat(F.lit(letter), (i % 2).cast("string")).alias("scorer")))
    pens = lambda n: F.when((F.col("hg") == F.col("ag")) & (F.col("ref") % 5 == 0), n)
    return rows.select("*", F.concat(F.lit("V"), F.col("home").cast("string")).alias("venue"), pens(4).alias("pens_h"), pens(3).alias("pens_a"), F.array_sort(F.concat(goals(F.col("hg"), "home", "H", 0), goals(F.col("ag"), "away", "A", 5))).alias("goals"))


def match_claims(rows):
    """A statement for each match, with what the remainder of its number by 24 makes wrong."""
    k = F.col("ref") % 24
    at = lambda n, wrong, right=None: F.when(k == n, wrong).otherwise(F.lit(None) if right is None else right)
    drawn = F.when(F.col("hg") > F.col("ag"), "win").when(F.col("hg") == F.col("ag"), "draw")
    text = F.when(k == 1, "one\ntwo").when(k == 2, F.repeat(F.lit("long "), 30)).when(k == 3, "Матч").otherwise("a match")
    refs = F.when(k == 4, F.array(-F.col("ref") - 1)).when(k == 23, F.array(F.col("ref") - 1, F.col("ref"))).otherwise(F.array("ref"))
    claims = rows.select(
        F.col("ref").alias("id"), text.alias("text"), refs.alias("refs"), F.when(k == 8, "win").when(k == 9, "draw").when(k == 15, "pens").otherwise(drawn).alias("kind"),
        at(6, F.lit(99), F.col("home")).alias("team"), at(7, F.lit(99), F.when(k != 6, F.col("away"))).alias("rival"),
        F.when(k == 10, F.col("hg") + 1).when(k == 11, F.col("ag")).otherwise(F.col("hg")).alias("a"), at(11, F.col("hg"), F.col("ag")).alias("b"),
        F.when(k.isin(12, 22), "X").otherwise(F.col("venue")).alias("venue"), F.when(k.isin(13, 22), F.col("round") + 1).otherwise(F.col("round")).alias("round"), at(14, ~F.col("extra"), F.col("extra")).alias("extra"),
        at(16, F.abs(F.col("hg") - F.col("ag")) + 1).alias("margin"), F.when(k == 17, "ZZ").when(k.isin(18, 19, 21), "H1").when(k == 20, "A1").alias("scorer"),
        at(18, F.floor((F.col("hg") + 1) / 2) + 1).alias("n"), at(19, F.lit(99)).alias("minute"), (k == 20).alias("opening"), (k == 21).alias("decisive"),
    )
    # a statement about a stranger says nothing of the score
    return claims.withColumns({c: F.when(F.col("team") != 99, F.col(c)) for c in ("kind", "a", "b")})


@query("""
WITH m AS (SELECT o_orderkey AS ref, o_orderkey % 24 AS k, o_orderkey % 4 AS hg, (o_orderkey // 4) % 3 AS ag FROM orders),
w AS (SELECT *, CASE WHEN hg > ag THEN 'H' || (ag + 1) % 2 WHEN ag > hg THEN 'A' || (hg + 1) % 2 END AS decider FROM m),
j AS (SELECT ref, k, list_filter([CASE WHEN k = 1 THEN 'newline' WHEN k = 2 THEN 'over-limit' WHEN k = 3 THEN 'foreign-script' END, CASE WHEN k = 4 THEN 'ref-unknown' WHEN k = 5 THEN 'ref-hidden' END,
  CASE k WHEN 6 THEN 'subject-unknown' WHEN 7 THEN 'opponent-mismatch' WHEN 8 THEN CASE WHEN hg < ag THEN 'winner-mismatch' WHEN hg = ag THEN 'draw-mismatch' END WHEN 9 THEN CASE WHEN hg <> ag THEN 'draw-mismatch' END
   WHEN 10 THEN 'score-mismatch' WHEN 11 THEN CASE WHEN hg <> ag THEN 'score-order' END WHEN 12 THEN 'venue' WHEN 22 THEN 'venue' WHEN 13 THEN 'round' WHEN 14 THEN 'extra-time' WHEN 15 THEN CASE WHEN hg <> ag OR ref % 5 <> 0 THEN 'shootout' END WHEN 16 THEN 'margin'
   WHEN 17 THEN 'scorer' WHEN 18 THEN CASE WHEN hg = 0 THEN 'scorer' END WHEN 19 THEN CASE WHEN hg = 0 THEN 'scorer' END WHEN 20 THEN CASE WHEN ag = 0 THEN 'scorer' END WHEN 21 THEN CASE WHEN hg = 0 THEN 'scorer' END END,
  CASE k WHEN 22 THEN 'round' WHEN 18 THEN 'goal-count' WHEN 19 THEN 'minute' WHEN 20 THEN CASE WHEN NOT (ag > 0 AND hg = 0) THEN 'opening-goal' END WHEN 21 THEN CASE WHEN decider IS DISTINCT FROM 'H1' THEN 'decisive-goal' END END], lambda x: x IS NOT NULL) AS codes FROM w)
SELECT ref AS id, CASE WHEN k <> 4 THEN ref END AS fact, array_to_string(codes, ',') AS codes FROM j
""")
def verified_claims(spark, sf_dir):
    known = match_facts(spark, sf_dir)
    own, rules = facts.match_rules()
    found = facts.verify(match_claims(known), "id", "refs", known, "ref", own, rules, known.where("ref % 24 = 5").select("ref"))
    return found.select("id", "fact", F.array_join("codes", ",").alias("codes"))
