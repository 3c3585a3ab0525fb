"""Who was on the pitch and for how long: a sweep over ordered changes, from two shapes of match records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise
from tidemill.sources.adapters import clock

_PERSON = "struct<id:long,name:string>"
#: Records with numbers: line-ups by side, changes with minute and extra, the last whistle.
NUMBERS = f"id long, home struct<starters:array<{_PERSON}>,bench:array<{_PERSON}>>, away struct<starters:array<{_PERSON}>,bench:array<{_PERSON}>>, events array<struct<type:string,side:string,player:long,assist:long,minute:int,extra:int>>, ended struct<minute:int,extra:int>"
#: Records with texts: starters in rows of the formation, clocks like ``45+2'``.
TEXTS = f"match long, lineups array<struct<side:string,initial:array<array<{_PERSON}>>,substitutes:array<{_PERSON}>>>, events array<struct<type:string,side:string,player:long,substituted:long,time:string>>, clock string"
#: (match, side, player, name, start) and (match, ord, side, player, kind, minute, extra).
CHANGES = "array<struct<kind: string, player: bigint>>"
#: Rows of players that a task sweeps, about.
TASK_ROWS = 500_000


def _listed(side: Column, starters: Column, bench: Column) -> Column:
    person = lambda start: lambda p: F.struct(side.alias("side"), p["id"].alias("player"), p["name"].alias("name"), F.lit(start).alias("start"))
    none = F.array().cast(f"array<{_PERSON}>")
    return F.concat(F.transform(F.coalesce(starters, none), person(True)), F.transform(F.coalesce(bench, none), person(False)))


def _change(kind: Column, player: Column, other: Column) -> Column:
    """A substitution takes ``player`` out and ``other`` in; a dismissal sends ``player`` off."""
    one = lambda name, who: F.when(who.isNotNull(), F.struct(F.lit(name).alias("kind"), who.alias("player")))
    both = F.when(kind == "sub", F.array(one("out", player), one("in", other))).when(kind == "red", F.array(one("off", player)))
    return F.filter(F.coalesce(both, F.array().cast(CHANGES)), lambda x: x.isNotNull())


def from_numbers(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listed, changes, ends) of records of the shape ``NUMBERS``; ends: match, minute, null if the record has none.  Texts that do not parse give nothing."""
    # read once for the three tables that come of it
    r = materialise(rows.select(F.from_json(json, NUMBERS).alias("r")).where("r.id IS NOT NULL"), "numbers").select("r.*")
    people = F.concat(_listed(F.lit("home"), F.col("home.starters"), F.col("home.bench")), _listed(F.lit("away"), F.col("away.starters"), F.col("away.bench")))
    listed = r.select(F.col("id").alias("match"), F.inline(people))
    e = r.select(F.col("id").alias("match"), F.posexplode("events").alias("ord", "e"))
    kind = F.when(F.col("e.type") == "subst", "sub").when(F.col("e.type").isin("red", "second-yellow"), "red")
    changes = e.select("match", "ord", F.col("e.side").alias("side"), F.col("e.minute").alias("minute"), F.coalesce("e.extra", F.lit(0)).alias("extra"), F.inline(_change(kind, F.col("e.player"), F.col("e.assist"))))
    return listed, changes, r.select(F.col("id").alias("match"), F.col("ended.minute").alias("minute"))


def from_texts(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of records of the shape ``TEXTS``."""
    r = materialise(rows.select(F.from_json(json, TEXTS).alias("r")).where("r.match IS NOT NULL"), "texts").select("r.*")
    listed = r.select("match", F.explode("lineups").alias("l")).select("match", F.inline(_listed(F.col("l.side"), F.flatten("l.initial"), F.col("l.substitutes"))))
    e = r.select("match", F.posexplode("events").alias("ord", "e")).withColumn("at", clock(F.col("e.time")))
    kind = F.when(F.lower("e.type") == "substitution", "sub").when(F.lower("e.type").isin("red card", "second yellow card"), "red")
    changes = e.select("match", "ord", F.col("e.side").alias("side"), F.col("at.minute").alias("minute"), F.coalesce("at.extra", F.lit(0)).alias("extra"), F.inline(_change(kind, F.col("e.substituted"), F.col("e.player"))))
    # a dismissal names its player where a substitution names who comes on
    sent = e.where(kind == "red").select("match", "ord", F.col("e.side").alias("side"), F.col("at.minute").alias("minute"), F.coalesce("at.extra", F.lit(0)).alias("extra"), F.lit("off").alias("kind"), F.col("e.player").alias("player"))
    return listed, changes.where("kind <> 'off'").unionByName(sent), r.select("match", clock(F.col("clock"))["minute"].alias("minute"))


def minutes(listed: DataFrame, changes: DataFrame, ends: DataFrame) -> DataFrame:
    """(match, side, player, start, entered, left, minutes, dismissed, problems) of every player that is listed or changed.

    A player's changes are swept in order of clock and record: a starter is on from 0, ``in`` brings on, ``out`` and
    ``off`` take off, the end takes off who is left.  Stoppage time does not count: 45+2 is 45, and who was on at all has a minute at least.
    A dismissal after a substitution, or on the bench, ends nothing.  Null ``entered`` and no minutes: never on.

    Problems: ``in-twice`` (on already: the second counts for nothing), ``out-without-in``, ``not-listed``, ``no-clock`` (a change without a minute counts for nothing), ``no-end`` (on to an end
    that is unknown: minutes are null).  Players and matches without an id are left out; rows of one player that repeat count once.
    """
    # nearly every row is of a player of its own, so rows are dealt as they are; a task gets TASK_ROWS of them, however many there are
    spark = listed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed.select("match").unionByName(changes.select("match")).count() // TASK_ROWS))
    dealt = lambda df, *by: df.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).repartition(parts, *by)
    people = dealt(listed.select("match", "player", "side", "start"), "match", "player").groupBy("match", "player").agg(F.min("side").alias("side"), F.bool_or("start").alias("start"))
    known = dealt(changes, "match", "player").dropDuplicates(["match", "player", "kind", "minute", "extra"])
    unclear = known.where("minute IS NULL").select("match", "player").distinct().withColumn("_unclear", F.lit(True))
    everyone = people.join(known.groupBy("match", "player").agg(F.min("side").alias("_side")), ["match", "player"], "full").withColumn("_listed", F.col("start").isNotNull())
    everyone = everyone.join(unclear, ["match", "player"], "left").select("match", "player", F.coalesce("side", "_side").alias("side"), F.coalesce("start", F.lit(False)).alias("start"), "_listed", F.coalesce("_unclear", F.lit(False)).alias("_unclear"))
    begun = everyone.where("start").select("match", "player", F.lit(0).alias("minute"), F.lit(0).alias("extra"), F.lit(-1).alias("ord"), F.lit("in").alias("kind"))
    events = begun.unionByName(known.where("minute IS NOT NULL").select("match", "player", "minute", "extra", F.col("ord").cast("int").alias("ord"), "kind"))
    # one player's changes in one match are a handful
    order = Window.partitionBy("match", "player").orderBy("minute", "extra", "ord", F.desc("kind"))
    before = F.lag("kind").over(order)
    judged = events.withColumn("_on", before == "in").withColumn("problem", F.when((F.col("kind") == "in") & F.col("_on"), "in-twice").when((F.col("kind") == "out") & ~F.coalesce("_on", F.lit(False)), "out-without-in"))
    real = judged.where(F.col("problem").isNull()).withColumn("_next", F.lead("minute").over(order))
    on = F.col("kind") == "in"
    stays = on & F.col("_next").isNull()
    swept = real.groupBy("match", "player").agg(
        F.min(F.when(on, F.col("minute"))).alias("entered"), F.max(F.when(on & F.col("_next").isNotNull(), F.col("_next"))).alias("left"), F.sum(F.when(on, F.greatest(F.col("_next") - F.col("minute"), F.lit(0)))).alias("_sum"),
        F.max(F.when(stays, F.col("minute"))).alias("_from"), F.bool_or(stays).alias("_stays"), F.bool_or(F.col("kind") == "off").alias("dismissed"),
    )
    wrong = judged.where("problem IS NOT NULL").groupBy("match", "player").agg(F.collect_set("problem").alias("_wrong"))
    out = everyone.join(swept, ["match", "player"], "left").join(wrong, ["match", "player"], "left")
    # who stays, once at most, is on to the end
    out = dealt(out, "match").join(dealt(ends, "match").groupBy("match").agg(F.max("minute").alias("_end")), "match", "left").withColumn("_open", F.col("_stays") & F.col("_end").isNull())
    till = F.when(F.col("_stays"), F.greatest(F.col("_end") - F.col("_from"), F.lit(0))).otherwise(0)
    played = F.when(F.col("entered").isNull(), 0).when(~F.col("_open"), F.greatest(F.coalesce("_sum", F.lit(0)) + till, F.lit(1)))
    problems = F.concat(F.coalesce("_wrong", F.array().cast("array<string>")), F.filter(F.array(F.when(~F.col("_listed"), F.lit("not-listed")), F.when(F.col("_unclear"), F.lit("no-clock")), F.when(F.col("_open"), F.lit("no-end"))), lambda x: x.isNotNull()))
    return out.select("match", "side", "player", "start", "entered", F.when(~F.col("_stays"), F.col("left")).alias("left"), played.cast("int").alias("minutes"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"), F.array_sort(problems).alias("problems"))
