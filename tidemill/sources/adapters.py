"""Adapters: provider records in JSON to rows, with their statuses, rounds, scores, minutes and sides made uniform.

A text that is null or does not parse gives a row of nulls with ``problem``, or no rows where rows come from its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "id long, status string, matchday int, stage string, home struct<id:long>, away struct<id:long>, score struct<home:int,away:int>"
SCORERS = "season string, scorers array<struct<player:struct<id:long,name:string>,team:struct<id:long>,goals:int,assists:int>>"
EVENTS = "id long, events array<struct<type:string,side:string,player:long,minute:int,extra:int>>"


def match_rows(rows: DataFrame, json: str, statuses: dict[str, str]) -> DataFrame:
    """id, status, round, home, away, home_score, away_score, problem: one row per record.

    ``statuses`` translates those of the provider; scores count only once finished; a round is the matchday (``md-12``) or
    else the stage in small letters.  Problems: unreadable, unknown-status, no-score, same-side.
    """
    r = F.from_json(json, MATCH)
    out = rows.select(r.alias("r")).select("r.*")
    pairs = F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])
    out = out.withColumn("state", F.try_element_at(pairs, F.col("status")))
    done = F.col("state") == "finished"
    none = F.col("score.home").isNull() | F.col("score.away").isNull()
    problem = F.when(F.col("id").isNull(), "unreadable").when(F.col("state").isNull(), "unknown-status").when(done & none, "no-score").when(F.col("home.id") == F.col("away.id"), "same-side")
    round_ = F.coalesce(F.concat(F.lit("md-"), F.col("matchday").cast("string")), F.lower("stage"))
    score = lambda c: F.when(done & ~none, F.col(f"score.{c}"))
    return out.select("id", F.col("state").alias("status"), round_.alias("round"), F.col("home.id").alias("home"), F.col("away.id").alias("away"), score("home").alias("home_score"), score("away").alias("away_score"), problem.alias("problem"))


def scorer_rows(rows: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """``keep``, place, player, name, team, goals, assists: one row per scorer of a list, in its order; scorers without goals are left out."""
    out = rows.select(*keep, F.posexplode(F.from_json(json, SCORERS)["scorers"]).alias("place", "s")).where("s.goals > 0")
    return out.select(*keep, (F.col("place") + 1).alias("place"), F.col("s.player.id").alias("player"), F.col("s.player.name").alias("name"), F.col("s.team.id").alias("team"), "s.goals", F.coalesce("s.assists", F.lit(0)).alias("assists"))


def goal_rows(rows: DataFrame, json: str) -> DataFrame:
    """id, ord, side, player, minute, extra, kind (goal, penalty, own): goals of match records; an own goal counts for the other side, missed penalties and other events are left out."""
    out = rows.select(F.from_json(json, EVENTS).alias("r")).select("r.id", F.posexplode("r.events").alias("ord", "e")).where(F.col("e.type").isin("goal", "penalty", "own"))
    own = F.col("e.type") == "own"
    side = F.when(own & (F.col("e.side") == "home"), "away").when(own & (F.col("e.side") == "away"), "home").otherwise(F.col("e.side"))
    return out.select("id", "ord", side.alias("side"), "e.player", "e.minute", F.coalesce("e.extra", F.lit(0)).alias("extra"), F.col("e.type").alias("kind"))


def clock(c: Column) -> Column:
    """(minute, extra) of a text like ``45+2'``; null if it is none."""
    part = lambda i: F.regexp_extract(c, r"^\s*([0-9]{1,3})(?:\s*\+\s*([0-9]{1,2}))?\s*'?\s*$", i)
    return F.when(part(1) != "", F.struct(part(1).try_cast("int").alias("minute"), F.when(part(2) == "", 0).otherwise(part(2).try_cast("int")).alias("extra")))


def score_pair(c: Column) -> Column:
    """(home, away) of a text like ``2 - 1``; null if it is none."""
    part = lambda i: F.regexp_extract(c, r"^\s*([0-9]{1,2})\s*[-:]\s*([0-9]{1,2})\s*$", i)
    return F.when(part(1) != "", F.struct(part(1).try_cast("int").alias("home"), part(2).try_cast("int").alias("away")))


STANDINGS = "standings array<struct<type:string,table:array<struct<position:int,team:struct<id:long,name:string>,playedGames:int,won:int,draw:int,lost:int,goalsFor:int,goalsAgainst:int,points:int>>>>"


def standing_rows(rows: DataFrame, json: str, competition: str, teams: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standings, unmatched) of records with the total table of a competition.

    standings: competition, pos, team (its slug), played, w, d, l, gf, ga, pts, zone, problem (``points`` where these are not three a win and one a draw, ``games`` where the games do not
    add up), of teams that ``teams`` (id, slug) knows; unmatched: competition, id, name, rows of those that it does not.  ``zones``: competition, from, to, zone; the first that holds a
    place counts.  Only tables of type TOTAL are read; places without a number are left out.
    """
    r = rows.select(F.col(competition).alias("competition"), F.explode(F.from_json(json, STANDINGS)["standings"]).alias("s")).where("s.type = 'TOTAL'")
    r = r.select("competition", F.explode("s.table").alias("t")).where("t.position IS NOT NULL")
    r = r.select("competition", F.col("t.position").alias("pos"), F.col("t.team.id").alias("id"), F.col("t.team.name").alias("name"), F.col("t.playedGames").alias("played"), F.col("t.won").alias("w"), F.col("t.draw").alias("d"), F.col("t.lost").alias("l"), F.col("t.goalsFor").alias("gf"), F.col("t.goalsAgainst").alias("ga"), F.col("t.points").alias("pts"))
    slugs = teams.where("id IS NOT NULL").groupBy("id").agg(F.min("slug").alias("team"))
    held = r.join(slugs, "id", "left")
    places = zones.select("competition", F.explode(F.expr("sequence(`from`, `to`)")).alias("pos"), F.struct("from", "to", "zone").alias("z")).groupBy("competition", "pos").agg(F.min("z").alias("z"))
    problem = F.when(F.col("played") != F.col("w") + F.col("d") + F.col("l"), "games").when(F.col("pts") != F.col("w") * 3 + F.col("d"), "points")
    good = held.where("team IS NOT NULL").join(places, ["competition", "pos"], "left").withColumn("problem", problem)
    unmatched = held.where("team IS NULL").groupBy("competition", "id").agg(F.min("name").alias("name"), F.count("*").alias("rows"))
    return good.select("competition", "pos", "team", "played", "w", "d", "l", "gf", "ga", "pts", F.col("z.zone").alias("zone"), "problem"), unmatched
