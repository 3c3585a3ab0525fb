"""Statements held against facts: a registry of typed comparators in order of precedence, and the fact that explains most of a statement.

A claim names the facts it rests on; it is joined to each of them, every rule of the registry judges the pair, and the
pair with the fewest faults (then the most rules held) is the one that counts.  The rules are columns, so a claim costs
one pass over its pairs, and their codes come in the order of the registry.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A code, where it applies and where it is broken; a null in either is no."""

    code: str
    applies: Column
    broken: Column


def holds(code: str, applies: Column, condition: Column) -> Rule:
    """A condition that must be true where it applies; unknown is not true."""
    return Rule(code, applies, ~F.coalesce(condition, F.lit(False)))


def same(code: str, said: Column, known: Column) -> Rule:
    """A value that must be the fact's; nothing said is nothing wrong."""
    return holds(code, said.isNotNull(), said.eqNullSafe(known))


def within(code: str, said: Column, known: Column, slack: float) -> Rule:
    """A number that must lie within ``slack`` of the fact's."""
    return holds(code, said.isNotNull(), F.abs(said - known) <= slack)


def among(code: str, said: Column, known: Column) -> Rule:
    """A value that must be one of the fact's array."""
    return holds(code, said.isNotNull(), F.array_contains(known, said))


def counted(code: str, said: Column, items: Column, like) -> Rule:
    """A number that must be that of the items of an array for which ``like`` holds."""
    return holds(code, said.isNotNull(), said == F.size(F.filter(items, like)))


def pair(code: str, said: tuple[Column, Column], known: tuple[Column, Column]) -> Rule:
    """Two values that must be the fact's two, in either order."""
    both = said[0].isNotNull() & said[1].isNotNull()
    return holds(code, both, F.array_sort(F.array(*said)) == F.array_sort(F.array(*known)))


def ordered(code: str, said: tuple[Column, Column], known: tuple[Column, Column]) -> Rule:
    """Two values that, if they are the fact's two, must come in its order."""
    turned = (said[0] == known[1]) & (said[1] == known[0]) & (known[0] != known[1])
    return Rule(code, said[0].isNotNull() & said[1].isNotNull(), turned)


UNKNOWN, HIDDEN = "ref-unknown", "ref-hidden"


def verify(claims: DataFrame, id_: str, refs: str, facts: DataFrame, fact: str, own: Sequence[Rule], rules: Sequence[Rule], hidden: DataFrame | None = None) -> DataFrame:
    """(id, fact, codes): what is wrong with each of ``claims``, by the fact among its ``refs`` (an array) that explains most of it.

    ``own`` judges a claim by itself (columns of ``claims``, as ``c.``), ``rules`` a claim beside a fact (``c.`` and ``f.``).  A claim of which no ref is a fact is ``ref-unknown``; a
    ref that is ``hidden`` (ref) is ``ref-hidden`` besides what else is wrong.  Codes come in order: those of ``own``, of the ref, of ``rules``.  Of facts that explain a claim equally the least counts.
    ``facts`` has one row per ``fact``, ids are unique; null or empty refs are unknown, repeated refs count once.
    """
    kind = facts.schema[fact].dataType
    judged = lambda some: F.filter(F.array(*[F.when(r.applies & r.broken, F.lit(r.code)) for r in some]).cast("array<string>"), lambda x: x.isNotNull())
    held = sum((F.coalesce((r.applies & ~r.broken).cast("int"), F.lit(0)) for r in rules), F.lit(0))
    left = claims.select(F.col(id_).alias("id"), F.struct(*claims.columns).alias("c"), F.explode_outer(F.array_distinct(refs)).alias("_r")).select("id", "c", F.col("_r").cast(kind).alias("ref"))
    both = left.join(facts.select(F.col(fact).alias("ref"), F.struct(*facts.columns).alias("f")), "ref", "left")
    unseen = F.lit(False)
    if hidden is not None:
        both = both.join(hidden.select("ref").distinct().withColumn("_hidden", F.lit(True)), "ref", "left")
        unseen = F.coalesce("_hidden", F.lit(False))
    ref = F.when(F.col("f").isNull(), F.array(F.lit(UNKNOWN))).otherwise(F.concat(F.when(unseen, F.array(F.lit(HIDDEN))).otherwise(F.array().cast("array<string>")), judged(rules)))
    pairs = both.select("id", F.when(F.col("f").isNotNull(), F.col("ref")).alias("fact"), judged(own).alias("_own"), ref.alias("_ref"), held.alias("_held"))
    order = F.struct(F.col("fact").isNull(), F.size("_ref"), -F.col("_held"), "fact")
    best = pairs.groupBy("id").agg(F.min_by(F.struct("fact", F.concat("_own", "_ref").alias("codes")), order).alias("b"))
    return best.select("id", "b.fact", "b.codes")


def match_rules(limit: int = 120, scripts: str = r"[\p{IsCyrillic}\p{IsGreek}]") -> tuple[list[Rule], list[Rule]]:
    """(own, rules) for statements about matches.

    Claims: text, kind (win, draw, pens), team, rival, a, b (the team's goals first), venue, round, extra, margin, scorer, n, minute, opening, decisive; facts: home, away, hg, ag, venue, round, extra, pens_h,
    pens_a and goals (minute, side, scorer), in order.
    """
    c, f = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"f.{x}"))
    at_home = c("team") == f("home")
    goals, other = F.when(at_home, f("hg")).otherwise(f("ag")), F.when(at_home, f("ag")).otherwise(f("hg"))
    pens, against = F.when(at_home, f("pens_h")).otherwise(f("pens_a")), F.when(at_home, f("pens_a")).otherwise(f("pens_h"))
    by = lambda g: g["scorer"] == c("scorer")
    scorers = F.transform(f("goals"), lambda g: g["scorer"])
    winner = F.when(f("hg") > f("ag"), "home").when(f("ag") > f("hg"), "away")
    decisive = F.get(F.filter(f("goals"), lambda g: g["side"] == winner), F.least(f("hg"), f("ag")))["scorer"]
    kind = lambda x: F.coalesce(c("kind") == x, F.lit(False))
    own = [
        Rule("newline", c("text").isNotNull(), c("text").contains("\n")),
        Rule("over-limit", c("text").isNotNull(), F.length(c("text")) > limit),
        Rule("foreign-script", c("text").isNotNull(), c("text").rlike(scripts)),
    ]
    rules = [
        among("subject-unknown", c("team"), F.array(f("home"), f("away"))),
        same("opponent-mismatch", c("rival"), F.when(at_home, f("away")).otherwise(f("home"))),
        Rule("winner-mismatch", kind("win"), goals < other),
        Rule("draw-mismatch", kind("win") | kind("draw"), F.when(kind("win"), goals == other).otherwise(goals != other)),
        holds("shootout", kind("pens"), (goals == other) & (pens > against)),
        pair("score-mismatch", (c("a"), c("b")), (goals, other)),
        ordered("score-order", (c("a"), c("b")), (goals, other)),
        same("venue", c("venue"), f("venue")),
        same("round", c("round"), f("round")),
        same("extra-time", c("extra"), f("extra")),
        same("margin", c("margin"), F.abs(f("hg") - f("ag"))),
        among("scorer", c("scorer"), scorers),
        counted("goal-count", c("n"), f("goals"), by),
        among("minute", c("minute"), F.transform(F.filter(f("goals"), by), lambda g: g["minute"])),
        holds("opening-goal", F.coalesce(c("opening"), F.lit(False)), F.get(scorers, 0) == c("scorer")),
        holds("decisive-goal", F.coalesce(c("decisive"), F.lit(False)), decisive == c("scorer")),
    ]
    return own, rules
