"""Line-ups and minutes from match records of two shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import lineups
from tidemill.plans.registry import query
from tidemill.session import table


def records(spark, sf_dir):
    """Orders as match records: even ones with numbers, odd ones with texts; what happens in them hangs on their number."""
    k = F.col("o_orderkey")
    person = lambda i: F.struct((k * 10 + i).alias("id"), F.concat(F.lit("P"), F.lit(str(i))).alias("name"))
    when = lambda cond, minute, extra, kind, out, into: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit("home").alias("side"), out.cast("long").alias("out"), into.cast("long").alias("into"), minute.cast("int").alias("minute"), extra.cast("int").alias("extra")))
    none, stop = F.lit(None), k % 7 == 3
    swap = F.when(stop, 45).otherwise(46 + k % 40)
    events = F.filter(F.array(
        when(k % 13 == 0, F.lit(20), F.lit(0), "sub", none, k * 10 + 2),
        when(F.lit(True), swap, F.when(stop, 2).otherwise(0), "sub", k * 10 + 1, k * 10 + 3),
        when(k % 3 == 0, 50 + k % 30, F.lit(0), "red", k * 10 + 2, none),
        when(k % 11 == 0, F.lit(80), F.lit(0), "sub", k * 10 + 4, none),
        when(k % 5 == 0, F.lit(90), F.lit(1), "red", k * 10 + 1, none),
        when(k % 6 == 1, F.lit(90), F.lit(3), "sub", none, k * 10 + 4),
        when(k % 19 == 0, F.lit(70), F.lit(0), "sub", none, k * 10 + 9),
    ), lambda e: e.isNotNull())
    ended = k % 17 != 0
    numbers = F.to_json(F.struct(
        k.alias("id"), F.struct(F.array(person(1), person(2)).alias("starters"), F.array(person(3), person(4)).alias("bench")).alias("home"), F.struct(F.array(person(5)).alias("starters")).alias("away"),
        F.transform(events, lambda e: F.struct(F.when(e["kind"] == "sub", "subst").otherwise("red").alias("type"), e["side"].alias("side"), e["out"].alias("player"), e["into"].alias("assist"), e["minute"].alias("minute"), e["extra"].alias("extra"))).alias("events"),
        F.when(ended, F.struct(F.lit(90).alias("minute"), F.lit(4).alias("extra"))).alias("ended"),
    ))
    time = lambda e: F.concat(e["minute"].cast("string"), F.when(e["extra"] > 0, F.concat(F.lit("+"), e["extra"].cast("string"))).otherwise(""), F.lit("'"))
    side = lambda name, rows, bench: F.struct(F.lit(name).alias("side"), rows.alias("initial"), bench.alias("substitutes"))
    red = lambda e: e["kind"] == "red"
    texts = F.to_json(F.struct(
        k.alias("match"), F.array(side("home", F.array(F.array(person(1)), F.array(person(2))), F.array(person(3), person(4))), side("away", F.array(F.array(person(5))), F.array().cast(lineups.NUMBERS.split("bench:")[1].split(">>")[0] + ">>"))).alias("lineups"),
        F.transform(events, lambda e: F.struct(F.when(red(e), "Red Card").otherwise("Substitution").alias("type"), e["side"].alias("side"), F.when(red(e), e["out"]).otherwise(e["into"]).alias("player"), F.when(~red(e), e["out"]).alias("substituted"), time(e).alias("time"))).alias("events"),
        F.when(ended, "90+4").otherwise("HT").alias("clock"),
    ))
    rows = table(spark, sf_dir, "orders")
    return rows.where(k % 2 == 0).select(numbers.alias("json")), rows.where(k % 2 == 1).select(texts.alias("json"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 3 THEN 45 ELSE 46 + o_orderkey % 40 END AS swap, o_orderkey % 17 = 0 AS endless FROM orders),
p AS (
  SELECT k, 1 AS i, true AS start, 0 AS entered, swap AS lft, swap AS minutes, k % 5 = 0 AS dismissed, false AS open, NULL AS wrong FROM o
  UNION ALL SELECT k, 2, true, 0, CASE WHEN k % 3 = 0 THEN 50 + k % 30 END, CASE WHEN k % 3 = 0 THEN 50 + k % 30 ELSE 90 END, k % 3 = 0, k % 3 <> 0, CASE WHEN k % 13 = 0 THEN 'in-twice' END FROM o
  UNION ALL SELECT k, 3, false, swap, NULL, 90 - swap, false, true, NULL FROM o
  UNION ALL SELECT k, 4, false, CASE WHEN k % 6 = 1 THEN 90 END, NULL, CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END, false, k % 6 = 1, CASE WHEN k % 11 = 0 THEN 'out-without-in' END FROM o
  UNION ALL SELECT k, 5, true, 0, NULL, 90, false, true, NULL FROM o
  UNION ALL SELECT k, 9, false, 70, NULL, 20, false, true, 'not-listed' FROM o WHERE k % 19 = 0)
SELECT k AS match, CASE WHEN i = 5 THEN 'away' ELSE 'home' END AS side, k * 10 + i AS player, start, entered::INT AS entered, lft::INT AS left, CASE WHEN open AND k % 17 = 0 THEN NULL ELSE minutes END::INT AS minutes, dismissed,
  concat_ws(',', CASE WHEN wrong = 'in-twice' THEN wrong END, CASE WHEN open AND k % 17 = 0 THEN 'no-end' END, CASE WHEN wrong <> 'in-twice' THEN wrong END) AS problems FROM p
""".replace("AS left,", 'AS "left",'))
def player_minutes(spark, sf_dir):
    numbers, texts = records(spark, sf_dir)
    parts = zip(lineups.from_numbers(numbers, "json"), lineups.from_texts(texts, "json"))
    out = lineups.minutes(*[a.unionByName(b) for a, b in parts])
    return out.withColumn("problems", F.array_join("problems", ","))
