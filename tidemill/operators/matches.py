"""Events between two sides: their state and result, links between two providers' lists of them, rest days, budgets and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import folds
from tidemill.operators.joins import lone_links, met
from tidemill.scratch import materialise


def match_state(status: Column, start: Column, now: Column, grace_hours: float = 3) -> Column:
    """finished, postponed, tbc (no start known), pending (started ``grace_hours`` ago or more without a result) or scheduled."""
    late = F.unix_timestamp(start) + F.lit(int(grace_hours * 3600)) <= F.unix_timestamp(now)
    return F.when(status == "finished", "finished").when(status == "postponed", "postponed").when(start.isNull(), "tbc").when(late, "pending").otherwise("scheduled")


def result_for(team: Column, home: Column, away: Column, home_score: Column, away_score: Column, finished: Column) -> Column:
    """W, D or L from the side of ``team``; null if the match is not finished, has no score, or is not the team's."""
    mine = F.when(team == home, home_score - away_score).when(team == away, away_score - home_score)
    return F.when(finished, F.when(mine > 0, "W").when(mine < 0, "L").when(mine == 0, "D"))


def appeared(started: Column, *counts: Column) -> Column:
    """Whether a player took part: started, or any of ``counts`` (minutes, goals, …) is above 0; nulls are 0."""
    out = F.coalesce(started, F.lit(False))
    for c in counts:
        out = out | (F.coalesce(c, F.lit(0)) > 0)
    return out


def sides_complete(entries: Column, side: str, home: Column, away: Column) -> Column:
    """Whether an array of entries holds as many of each side as the score says; null without a score."""
    n = lambda which: F.size(F.filter(entries, lambda e: e[side] == which))
    return F.when(home.isNotNull() & away.isNotNull(), (n("home") == home) & (n("away") == away))


def override(value: Column, uses: Column, manual: Column, least: int) -> Column:
    """The manual value where there is one and ``value`` has been used fewer than ``least`` times."""
    return F.when(F.coalesce(uses, F.lit(0)) < least, F.coalesce(manual, value)).otherwise(value)


def target_class(league: Column, home: Column, away: Column, leagues: Sequence, teams: Sequence, friendly: Column) -> Column:
    """league, team, friendly or other: why a fixture is wanted, or not."""
    tracked = home.isin(*teams) | away.isin(*teams)
    return F.when(league.isin(*leagues), "league").when(F.coalesce(tracked, F.lit(False)) & ~friendly, "team").when(friendly, "friendly").otherwise("other")


def rest_days(days: DataFrame, day: str, seasons: DataFrame, fixtures: DataFrame, margin: int) -> DataFrame:
    """``days`` with ``rest``: ``fixture`` within ``margin`` days of one of ``fixtures`` (day), ``season`` outside all ``seasons`` (first, last), else null.

    Both are spread to the days they cover, so that each is an equi-join.
    """
    near = fixtures.select(F.explode(F.sequence(F.date_sub("day", margin), F.date_add("day", margin))).alias("_d")).distinct().withColumn("_near", F.lit(True))
    covered = seasons.where("first <= last").select(F.explode(F.sequence("first", "last")).alias("_e")).distinct().withColumn("_in", F.lit(True))
    out = days.join(near, F.col(day) == F.col("_d"), "left").join(covered, F.col(day) == F.col("_e"), "left")
    return out.select(*days.columns, F.when(F.col("_near"), "fixture").when(F.col("_in").isNull(), "season").alias("rest"))


def budget_usage(costs: DataFrame, month: Column, cost: str, env: str, limit: Column, alert: float = 0.5) -> DataFrame:
    """Per month: spent, dev (spent outside production), share and dev_share of ``limit``, alert; without a limit (0 or less) shares are null and any spending alerts."""
    out = costs.groupBy(month.alias("month")).agg(F.sum(cost).alias("spent"), F.coalesce(F.sum(F.when(F.col(env) != "prod", F.col(cost))), F.sum(F.col(cost) * 0)).alias("dev"))
    share = lambda c: F.when(limit > 0, F.col(c).cast("double") / limit)
    return out.select("month", "spent", "dev", share("spent").alias("share"), share("dev").alias("dev_share"), F.coalesce(share("spent") > alert, F.col("spent") > 0).alias("alert"))


def current_round(rounds: DataFrame, key: str, start: str, end: str, now: Column) -> DataFrame:
    """Per key the round that counts: the first that is on, else the first to come, else the last."""
    live, ahead = (F.col(start) <= now) & (F.col(end) >= now), F.col(start) > now
    first = lambda when: F.min(F.when(when, F.struct(start, "round")))["round"]
    return rounds.groupBy(key).agg(F.coalesce(first(live), first(ahead), F.max(F.struct(start, "round"))["round"]).alias("round"), F.when(F.max(live), "live").when(F.max(ahead), "ahead").otherwise("over").alias("state"))


def evidence_links(left: DataFrame, right: DataFrame, confirmed: DataFrame, seconds: int) -> DataFrame:
    """a, b, reason for every row of ``left`` (a, slot, at, home, away, score, finish), linked to ``right`` (b, slot, at, home, away, score, finish) where b is not null.

    Candidates share the slot and start within ``seconds`` of each other; they are never listed, what a row meets in
    its reach is folded (:func:`joins.met`).  A pair whose teams are both in ``confirmed`` (team, other) is linked first, if it is the only such pair of both rows.  Of
    the rest a pair is linked if its rows are each other's only candidates with the same score, no candidate of either
    lacks a score, and both finished the same way.  Reasons of the others, the first that holds: no-candidate, taken,
    unknown-score, other-score, many, finish.
    """
    known = confirmed.select("team", "other").distinct()
    named = lambda df, c: df.join(known.select(F.col("team").alias(c), F.col("other").alias(f"_{c}")), c)
    x = named(named(left.select("a", "slot", "at", "home", "away"), "home"), "away").select("a", "slot", "at", F.col("_home").alias("home"), F.col("_away").alias("away"))
    first = materialise(lone_links(x, right.select("b", "slot", "at", "home", "away"), ["slot", "home", "away"], "at", seconds), "sure")
    there = {"any": (F.max, F.lit(True)), "blind": (F.max, F.col("score").isNull())}
    rest, others = left.join(first.select("a"), "a", "left_anti"), right.join(first.select("b"), "b", "left_anti")

    def judged(rows: DataFrame, against: DataFrame) -> DataFrame:
        """``rows`` that have candidates, with ``blind``: their own score or a candidate's is not known."""
        found = met(rows, against, ["slot"], "at", seconds, there).where("any")
        return found.withColumn("blind", F.col("blind") | F.col("score").isNull())

    rest, others = materialise(judged(rest, others), "rest"), materialise(judged(others, rest), "others")
    clear = materialise(lone_links(rest, others, ["slot", "score"], "at", seconds), "same")
    clear = clear.join(rest.where("NOT blind").select("a", F.col("finish").alias("fa")), "a").join(others.where("NOT blind").select("b", F.col("finish").alias("fb")), "b")
    links = first.unionByName(clear.where("fa <=> fb").select("a", "b"))
    same = met(rest, others, ["slot", "score"], "at", seconds, {"same": (F.max, F.lit(True))}).select("a", "blind", F.coalesce("same", F.lit(False)).alias("same"))
    facts = met(left, right, ["slot"], "at", seconds, {"n": (F.max, F.lit(True))}).select("a", "n")
    out = facts.join(links, "a", "left").join(same, "a", "left").join(clear.select("a", F.lit(True).alias("clear")), "a", "left")
    reason = F.when(F.col("b").isNotNull(), None).when(F.col("n").isNull(), "no-candidate").when(F.col("same").isNull(), "taken").when(F.col("blind"), "unknown-score").when(~F.col("same"), "other-score").when(F.col("clear").isNull(), "many").otherwise("finish")
    return out.select("a", "b", reason.alias("reason"))


def pending_links(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """a, b, reason: rows of ``left`` (a, at, team, name) whose opponent is open, filled from ``right`` (b, at, team, name): the same team within ``seconds``, one candidate on both sides, and names that agree where both are there."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / F.lit(seconds))
    x = left.select("a", F.col("at").alias("at_a"), F.col("team").alias("_t"), F.col("name").alias("na"), F.explode(F.array(*[bucket("at") + d for d in (-1, 0, 1)])).alias("_x"))
    y = right.select("b", F.col("at").alias("at_b"), "team", F.col("name").alias("nb"), bucket("at").alias("_y"))
    pairs = x.join(y, (F.col("_t") == F.col("team")) & (F.col("_x") == F.col("_y"))).where(F.abs(F.unix_timestamp("at_a") - F.unix_timestamp("at_b")) <= seconds)
    per_b = pairs.groupBy("b").agg(F.count("*").alias("nb_")).where("nb_ = 1").select("b", F.lit(True).alias("once"))
    agree = F.col("na").isNull() | F.col("nb").isNull() | (F.lower("na") == F.lower("nb"))
    facts = pairs.join(per_b, "b", "left").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min(F.coalesce("once", F.lit(False))).alias("once"), F.min(agree).alias("agree"))
    reason = F.when(F.col("n").isNull(), "no-candidate").when((F.col("n") > 1) | ~F.col("once"), "many").when(~F.col("agree"), "name")
    return left.select("a").join(facts, "a", "left").select("a", F.when(reason.isNull(), F.col("b")).alias("b"), reason.alias("reason"))


def record_problems(records: DataFrame, events: DataFrame, key: str, order: Sequence[str], rank: str) -> DataFrame:
    """key, problem: ``records`` (key, status, first, last) that differ from what their ``events`` say: missing, orphan, status, first or last."""
    now = folds.status_of(events, key, order, rank).select(F.col(key).alias("_k"), F.col("status").alias("_status"))
    ends = events.groupBy(F.col(key).alias("_e")).agg(F.min(order[0]).alias("_first"), F.max(order[0]).alias("_last"))
    both = records.join(now.join(ends, F.col("_k") == F.col("_e")), F.col(key) == F.col("_k"), "full")
    problem = F.when(F.col(key).isNull(), "missing").when(F.col("_k").isNull(), "orphan").when(~F.col("status").eqNullSafe(F.col("_status")), "status").when(~F.col("first").eqNullSafe(F.col("_first")), "first").when(~F.col("last").eqNullSafe(F.col("_last")), "last")
    return both.select(F.coalesce(key, "_k").alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def next_meta(current: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A ledger's state (key, season, runs, last) after a run's ``facts`` (key, season, at): one more run of the same season, a fresh state for a new one; older seasons change nothing."""
    f = facts.select(F.col(key).alias("_k"), F.col("season").alias("_s"), "at")
    both = current.join(f, F.col(key) == F.col("_k"), "full")
    fresh = F.col(key).isNull() | (F.col("_s") > F.col("season"))
    again = F.col("_s") == F.col("season")
    pick = lambda new, more, old: F.when(fresh, new).when(again, more).otherwise(old)
    return both.select(F.coalesce(key, "_k").alias(key), pick(F.col("_s"), F.col("season"), F.col("season")).alias("season"), pick(F.lit(1), F.col("runs") + 1, F.col("runs")).alias("runs"), pick(F.col("at"), F.greatest("last", "at"), F.col("last")).alias("last"))


def pruned(rows: DataFrame, new: DataFrame, key: str, at: str, oldest: Column) -> DataFrame:
    """``rows`` and ``new`` together, the latest of each key, without what lies before ``oldest``."""
    every = rows.unionByName(new).where(F.col(at) >= oldest)
    rest = [c for c in rows.columns if c != key]
    top = every.groupBy(key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("m"))
    return top.select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in rows.columns])


def merge_months(daily: DataFrame, monthly: DataFrame, key: str, day: str, today: Column, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): rows of due months (see :func:`sinks.compaction_plan`) of ``daily`` and ``monthly`` as ``month`` and their own columns, each key once.

    A key that a month holds with two contents is a conflict: its month is in ``conflicts`` and none of its rows are merged.
    """
    month = F.date_format(day, "yyyy-MM")
    both = daily.unionByName(monthly).withColumn("month", month).distinct()
    due = both.groupBy("month").agg((F.date_add(F.last_day(F.min(day)), keep_days) < today).alias("due")).where("due").select("month")
    rows = both.join(due, "month", "left_semi")
    conflicts = rows.groupBy("month", key).agg(F.count("*").alias("n")).where("n > 1").groupBy("month").agg(F.count("*").alias("keys"))
    return rows.join(conflicts, "month", "left_anti"), conflicts


def reading_merge(old: DataFrame, new: DataFrame, key: str, at: str, most: int, taken_down: DataFrame) -> DataFrame:
    """The ``most`` first rows of a list: new ones before old ones, newest first, each key once, without those ``taken_down`` (key)."""
    every = new.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1))).join(taken_down.select(key), key, "left_anti")
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_old", F.desc(at)))).where("_n = 1")
    return first.orderBy("_old", F.desc(at), key).limit(most).drop("_n").withColumn("fresh", F.col("_old") == 0).drop("_old")


def follow_board(follows: DataFrame, fixtures: DataFrame, players: DataFrame) -> DataFrame:
    """key, team, kind, names: ``fixtures`` (key, team) of followed teams (``follows``: name, kind, target) with all names that follow them, and rows of followed ``players`` (player, key, team) where the team's own row is not there already."""
    teams = follows.where("kind = 'team'").select("name", F.col("target").alias("team"))
    own = fixtures.join(teams, "team").groupBy("key", "team").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    people = follows.where("kind = 'player'").select("name", F.col("target").alias("player"))
    more = players.join(people, "player").join(own.select("key", "team"), ["key", "team"], "left_anti").groupBy("key", "team").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return own.withColumn("kind", F.lit("team")).unionByName(more.withColumn("kind", F.lit("player"))).select("key", "team", "kind", "names")


def alias_list(parts: Column) -> Column:
    """Names of an array with blanks squeezed, without empty ones and without repeats in other case, the first form kept; a name of three Hangul syllables also gives its last two."""
    given = lambda x: F.when(x.rlike("^[가-힣]{3}$"), F.array(x, F.substring(x, 2, 2))).otherwise(F.array(x))
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.isNotNull() & (x != ""))
    names = F.flatten(F.transform(clean, given))
    return F.filter(names, lambda x, i: F.array_position(F.transform(names, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def query_text(raw: Column, most: int = 60) -> Column:
    """A search text with blanks squeezed and trimmed, cut to ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit(most))
