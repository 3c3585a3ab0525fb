"""Aggregations with the workload's null, money and tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part`` by ``whole``; null on zero; rounded half up if asked."""
    r = F.try_divide(part, whole)
    return r if digits is None else F.floor(r * 10**digits + 0.5) / 10**digits


def js_round(c: Column) -> Column:
    """Half up also below zero."""
    return F.floor(c + 0.5).cast("long")


def poisoned_sum(value: Column, counts: Column) -> Column:
    """Sum over the rows that count; null if any of them is null; 0 if none counts."""
    return F.when(F.count_if(counts & value.isNull()) == 0, F.coalesce(F.sum(F.when(counts, value)), F.lit(0)))


def money(value: Column) -> Column:
    """Exact sum in millionths."""
    return F.sum(value.cast("decimal(18,6)"))


def token_cost(uses: DataFrame, prices: DataFrame, key: str, tokens: dict[str, str], batch: str, discount: float = 0.5, long: tuple[Column, dict[str, str]] | None = None) -> DataFrame:
    """``uses`` with cost: each token count by its price per million, a discount for batch calls, exact to twelve places.

    ``long`` = (condition, prices): calls for which the condition holds pay those prices instead, each call judged by itself.
    """
    out = uses.join(prices, key)
    price = lambda n: F.col(tokens[n]) if long is None else F.when(long[0], F.col(long[1][n])).otherwise(F.col(tokens[n]))
    cost = sum((F.col(n).cast("decimal(18,0)") * price(n).cast("decimal(12,6)") for n in tokens), F.lit(0).cast("decimal(1,0)"))
    cost = cost * F.when(F.col(batch), F.lit(str(discount))).otherwise(F.lit("1")).cast("decimal(3,2)") / 1_000_000
    return out.withColumn("cost", cost.cast("decimal(24,12)")).drop(*tokens.values())


def result_rows(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, keep: Sequence[str]) -> DataFrame:
    """Two rows per match, one for each side: team, venue, gf, ga, result (W / D / L)."""
    side = lambda team, venue, gf, ga: F.struct(F.col(team).alias("team"), F.lit(venue).alias("venue"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = matches.select(*keep, F.explode(F.array(side(home, "home", home_goals, away_goals), side(away, "away", away_goals, home_goals))).alias("s")).select(*keep, "s.*")
    return both.withColumn("result", F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") < F.col("ga"), "L").when(F.col("gf") == F.col("ga"), "D"))


def standings(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Table rows from match sides: played, w, d, l, gf, ga, pts."""
    count = lambda r: F.count_if(F.col("result") == r)
    return results.where("result IS NOT NULL").groupBy(*keys, "team").agg(F.count("*").alias("played"), count("W").alias("w"), count("D").alias("d"), count("L").alias("l"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), (count("W") * 3 + count("D")).alias("pts"))


def two_legs(matches: DataFrame, keys: Sequence[str], home: str, away: str, home_goals: str, away_goals: str) -> DataFrame:
    """Ties of two sides in either order: legs, goals of each side (a < b), and the winner on aggregate or ``level``."""
    a, b = F.least(home, away), F.greatest(home, away)
    ga = F.when(F.col(home) == a, F.col(home_goals)).otherwise(F.col(away_goals))
    gb = F.when(F.col(home) == a, F.col(away_goals)).otherwise(F.col(home_goals))
    ties = matches.where(F.col(home) != F.col(away)).groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.count("*").alias("legs"), F.sum(ga).alias("goals_a"), F.sum(gb).alias("goals_b"))
    return ties.withColumn("winner", F.when(F.col("goals_a") > F.col("goals_b"), F.col("a")).when(F.col("goals_a") < F.col("goals_b"), F.col("b")))


def additive_score(rules: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(sum of the weights of the rules that hit, their names in order)."""
    total = sum((F.when(hit, F.lit(w)).otherwise(F.lit(0)) for hit, w in rules.values()), F.lit(0))
    names = F.filter(F.array(*[F.when(hit, F.lit(n)) for n, (hit, _) in rules.items()]), lambda x: x.isNotNull())
    return total, names


def tally(verdict: Column) -> list[Column]:
    return [F.count_if(verdict).alias("right"), F.count_if(~verdict).alias("wrong"), F.count_if(verdict.isNull()).alias("unjudged"), F.try_divide(F.count_if(verdict), F.count(verdict)).alias("accuracy")]


def tie_decisions(matches: DataFrame, keys: Sequence[str], home: str, away: str, home_goals: str, away_goals: str, at: str, home_pens: str, away_pens: str) -> DataFrame:
    """Ties of two sides in either order with winner and ``by``: aggregate, pens (of the last leg with a shoot-out) or unresolved; a leg without a score leaves a tie unresolved."""
    a, b = F.least(home, away), F.greatest(home, away)
    of = lambda side, x, y: F.when(F.col(home) == side, F.col(x)).otherwise(F.col(y))
    shot = F.when(F.col(home_pens).isNotNull() & F.col(away_pens).isNotNull(), F.struct(F.col(at), (of(a, home_pens, away_pens) - of(b, home_pens, away_pens)).alias("lead")))
    whole = F.count_if(F.col(home_goals).isNull() | F.col(away_goals).isNull()) == 0
    ties = matches.where(F.col(home) != F.col(away)).groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.count("*").alias("legs"), F.sum(of(a, home_goals, away_goals)).alias("goals_a"), F.sum(of(b, home_goals, away_goals)).alias("goals_b"), whole.alias("_w"), F.max(shot)["lead"].alias("_p"))
    lead = F.when(F.col("_w"), F.when(F.col("goals_a") != F.col("goals_b"), F.col("goals_a") - F.col("goals_b")).otherwise(F.col("_p")))
    by = F.when(F.coalesce(lead, F.lit(0)) == 0, "unresolved").when(F.col("goals_a") != F.col("goals_b"), "aggregate").otherwise("pens")
    return ties.select(*keys, "a", "b", "legs", "goals_a", "goals_b", F.when(lead > 0, F.col("a")).when(lead < 0, F.col("b")).alias("winner"), by.alias("by"))
