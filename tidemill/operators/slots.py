"""Claims in titles by a slot grammar that is data: names and words become typed marks, a table of transitions reads them.

A title turns into its marks (:func:`entities.hits` finds names and the words of a lexicon alike), cut into clauses; what else stands between two marks is one
mark ``w``.  Each clause is folded through the transitions of its language, inside one expression: no row of Python, and
a new language is new rows of three small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import entities
from tidemill.operators.keywords import cascade

#: The state in which a clause begins, and to which a mark without a transition leads back.
START = "start"
#: The mark that ends a clause, and the mark of words that are in no table.
CUT, WORD = "cut", "w"
MATCH = "struct<status: string, player: string, `from`: string, `to`: string>"


def marks(rows: DataFrame, names: DataFrame, lexicon: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(id, lang, clause, mark, slug, start): the marks of each title of ``rows`` (id, title, lang).

    ``names``: term, slug, kind, whose mark is their kind; ``lexicon``: lang, term, mark.  A name that several slugs of its kind share is no mark.
    """
    out = None
    for lang in languages:
        own = rows.where(F.col("lang") == lang)
        terms = names.select("term", "slug", "kind").unionByName(lexicon.where(F.col("lang") == lang).select("term", F.lit("").alias("slug"), F.col("mark").alias("kind"))).withColumn("shared", F.lit(False))
        hit = entities.hits(own, "id", "title", terms).groupBy("id", "start", "stop").agg(F.min("kind").alias("mark"), F.min("slug").alias("slug"), F.count("*").alias("n")).where("n = 1").drop("n")
        hit = hit.join(own.select("id", "title", "lang"), "id")
        out = hit if out is None else out.unionByName(hit)
    order = Window.partitionBy("id").orderBy("start")
    gap = F.expr("substring(title, _b + 1, start - _b)")
    out = out.withColumn("_b", F.lag("stop", 1, 0).over(order)).withColumn("_w", gap.rlike(r"[\p{L}\p{N}]"))
    both = F.when(F.col("_w"), F.array(F.struct((F.col("start") - 1).alias("start"), F.lit(WORD).alias("mark"), F.lit("").alias("slug")), F.struct("start", "mark", "slug"))).otherwise(F.array(F.struct("start", "mark", "slug")))
    clause = F.sum((F.col("mark") == CUT).cast("int")).over(order)
    return out.withColumn("clause", clause.cast("int")).select("id", "lang", "clause", F.inline(both)).select("id", "lang", "clause", "mark", "slug", "start")


def matches(clauses: DataFrame, grammar: DataFrame) -> DataFrame:
    """``clauses`` (lang, seq: array of mark and slug) with found: what the transitions make of each.

    ``grammar``: lang, state, mark, next, slot (player, from or to: takes the mark's slug; or null) and status (set by the transition, or null).  A mark
    without a transition hands over what has a status and is tried again from the start.
    """
    entry = F.struct(F.concat_ws("|", "state", "mark").alias("k"), F.struct("next", "slot", "status").alias("v"))
    tables = grammar.groupBy("lang").agg(F.map_from_entries(F.collect_list(entry)).alias("rules"))
    nothing = F.lit(None).cast("string")
    empty = F.struct(nothing.alias("status"), nothing.alias("player"), nothing.alias("from"), nothing.alias("to"))

    def taken(cur: Column, rule: Column, slug: Column) -> Column:
        slot = lambda name: F.when(rule["slot"] == name, slug).otherwise(cur[name]).alias(name)
        return F.struct(F.coalesce(rule["status"], cur["status"]).alias("status"), slot("player"), slot("from"), slot("to"))

    def handed(acc: Column) -> Column:
        return F.when(acc["cur"]["status"].isNotNull(), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def step(acc: Column, m: Column) -> Column:
        rule = F.element_at("rules", F.concat_ws("|", acc["state"], m["mark"]))
        again = F.element_at("rules", F.concat_ws("|", F.lit(START), m["mark"]))
        on = F.struct(rule["next"].alias("state"), taken(acc["cur"], rule, m["slug"]).alias("cur"), acc["out"].alias("out"))
        back = F.struct(F.coalesce(again["next"], F.lit(START)).alias("state"), F.when(again.isNotNull(), taken(empty, again, m["slug"])).otherwise(empty).alias("cur"), handed(acc).alias("out"))
        return F.when(rule.isNotNull(), on).otherwise(back)

    begin = F.struct(F.lit(START).alias("state"), empty.alias("cur"), F.expr(f"CAST(array() AS array<{MATCH}>)").alias("out"))
    return clauses.join(tables, "lang").withColumn("found", F.aggregate("seq", begin, step, handed)).drop("rules")


# The stages of a move.
#: The furthest last.
PROGRESS = ("rumor", "negotiating", "agreed", "official")
COLLAPSED = "collapsed"


def claims(rows: DataFrame, names: DataFrame, lexicon: DataFrame, grammar: DataFrame, guards: DataFrame, current: DataFrame, languages: Sequence[str], commas: int = 3) -> DataFrame:
    """id, player, from, to, status, reason: what each of ``rows`` (id, title, lang) claims, or the first reason why nothing.

    ``guards``: mark, effect.  ``topic``: a mark that makes a title one of moves at all; ``renewal``, ``agent``, ``hypothetical``,
    ``roundup``: the title is out, with that reason; ``doubt``: matches of its clause are rumours; ``stay``: matches of its clause do not count.  ``current``: player, team.

    Reasons in order: ``roundup`` (or ``commas`` commas), ``no-topic``, ``renewal``, ``agent``, ``hypothetical``, ``no-player``, ``players`` (not
    one alone in the matches or, without these, in the title), ``no-status`` (no match), ``no-move`` (beyond a rumour without a club to come from or go to), ``current-team``.
    Of several matches the furthest counts; ``collapsed`` beside another is a rumour; clubs count if they are one.  Null and empty titles have no topic; titles of other
    languages are left out; ids are unique.
    """
    m = marks(rows, names, lexicon, languages).join(F.broadcast(guards.groupBy("mark").agg(F.collect_set("effect").alias("effects"))), "mark", "left")
    seq = F.transform(F.array_sort(F.collect_list(F.struct("start", "mark", "slug"))), lambda x: F.struct(x["mark"].alias("mark"), x["slug"].alias("slug")))
    effects = F.array_distinct(F.flatten(F.collect_list(F.coalesce("effects", F.array().cast("array<string>")))))
    clauses = m.groupBy("id", "lang", "clause").agg(seq.alias("seq"), effects.alias("effects"))
    read = matches(clauses, grammar)
    doubted = F.transform("found", lambda x: F.struct(F.when(F.array_contains("effects", "doubt"), F.lit(PROGRESS[0])).otherwise(x["status"]).alias("status"), x["player"].alias("player"), x["from"].alias("from"), x["to"].alias("to")))
    counted = F.when(F.array_contains("effects", "stay"), F.filter("found", lambda x: F.lit(False))).otherwise(doubted)
    players = F.transform(F.filter("seq", lambda x: x["mark"] == "player"), lambda x: x["slug"])
    titles = read.groupBy("id").agg(F.flatten(F.collect_list(counted)).alias("found"), F.array_distinct(F.flatten(F.collect_list("effects"))).alias("effects"), F.array_distinct(F.flatten(F.collect_list(players))).alias("players"))
    rank = F.create_map(*[x for i, s in enumerate((COLLAPSED, *PROGRESS)) for x in (F.lit(s), F.lit(i))])
    out = rows.select("id", "title", "lang").where(F.col("lang").isin(*languages)).join(titles, "id", "left")
    none = F.expr(f"CAST(array() AS array<{MATCH}>)")
    out = out.withColumns({"found": F.coalesce("found", none), "effects": F.coalesce("effects", F.array().cast("array<string>")), "players": F.coalesce("players", F.array().cast("array<string>"))})
    fallen = F.exists("found", lambda x: x["status"] == COLLAPSED)
    going = F.exists("found", lambda x: x["status"] != COLLAPSED)
    furthest = F.element_at(F.transform(F.array_sort(F.transform("found", lambda x: F.struct(F.element_at(rank, x["status"]).alias("r"), x["status"].alias("s")))), lambda x: x["s"]), -1)
    out = out.withColumn("status", F.when(F.size("found") > 0, F.when(fallen & going, PROGRESS[0]).otherwise(furthest)))
    one = lambda slot: F.array_distinct(F.filter(F.transform("found", lambda x: x[slot]), lambda x: x.isNotNull()))
    sole = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    out = out.withColumns({"_who": F.when(F.size("found") > 0, one("player")).otherwise(F.col("players")), "from": sole(one("from")), "to": sole(one("to"))})
    now = current.groupBy("player").agg(F.collect_set("team").alias("_teams"))
    out = out.withColumn("player", sole(F.col("_who"))).join(now, "player", "left")
    effect = lambda name: F.array_contains("effects", name)
    listed = F.length("title") - F.length(F.replace("title", F.lit(","), F.lit(""))) >= commas
    rules = [
        ("roundup", effect("roundup") | F.coalesce(listed, F.lit(False))), ("no-topic", ~effect("topic")), *[(x, effect(x)) for x in ("renewal", "agent", "hypothetical")],
        ("no-player", F.size("players") == 0), ("players", F.size("_who") != 1), ("no-status", F.col("status").isNull()),
        ("no-move", (F.col("status") != PROGRESS[0]) & F.col("from").isNull() & F.col("to").isNull()), ("current-team", F.coalesce(F.array_contains("_teams", F.col("to")), F.lit(False))),
    ]
    out = out.withColumn("reason", cascade(rules))
    good = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select("id", *map(good, ("player", "from", "to", "status")), "reason")
