"""Records of moves from their evidence, and what the titles of a cluster say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import folds
from tidemill.operators.keywords import cascade

# The names of the ranks of :mod:`folds`.
STATUS = ("rumor", "negotiating", "agreed", "official", "collapsed")


def move_records(evidence: DataFrame, taken_down: DataFrame, now: Column, quiet_days: int = 30, most: int = 100) -> DataFrame:
    """player, to, status, from, best_tier, updated, quiet, cards, history: a record for each player and target of ``evidence`` (card, player, to, from, rank, tier, at).

    A card counts once, by its earliest row, and not at all if it is among ``taken_down`` (card).  Evidence is taken in order of time and card: the status is that of the fold, ``from`` the last that was
    named, ``best_tier`` the least, and a rumour of ``quiet_days`` is quiet.  ``history`` holds the first evidence and each that changed the state, as (at, card, status), the last
    ``most`` of them; ``cards`` counts all evidence.  No target is a target of its own; rows without a player, card or time are left out.
    """
    rows = evidence.where("player IS NOT NULL AND card IS NOT NULL AND at IS NOT NULL").join(taken_down.select("card").distinct(), "card", "left_anti")
    fields = ["player", "to", "from", "rank", "tier"]
    once = rows.groupBy("card").agg(F.min_by(F.struct("at", *fields), F.struct("at", *fields)).alias("e")).select("card", "e.*")
    # one key for player and target, null and text apart
    once = once.withColumn("key", F.to_json(F.struct("player", "to")))
    at = F.struct("at", "card")
    state = folds.status_of(once, "key", ["at", "card"], "rank").select("key", F.col("status").alias("_status"), "n")
    told = once.groupBy("key").agg(F.min("player").alias("player"), F.min("to").alias("to"), F.max_by("from", F.when(F.col("from").isNotNull(), at)).alias("from"), F.min("tier").alias("best_tier"), F.max("at").alias("updated"), F.min(at).alias("_first"))
    steps = folds.status_changes(once, "key", ["at", "card"], "rank").join(told.select("key", "_first"), "key").where(F.col("changed") | (at == F.col("_first")))
    name = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("status") + 1).cast("int"))
    history = steps.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "card", name.alias("status")))).alias("h")).select("key", F.slice("h", F.greatest(F.size("h") - most + 1, F.lit(1)), most).alias("history"))
    out = told.join(state, "key").join(history, "key")
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("_status") + 1).cast("int"))
    quiet = (status == STATUS[0]) & (F.unix_timestamp("updated") <= F.unix_timestamp(now) - quiet_days * 86400)
    return out.select("player", "to", status.alias("status"), "from", "best_tier", "updated", quiet.alias("quiet"), F.col("n").alias("cards"), "history")


def cluster_analysis(members: DataFrame, tags: DataFrame, signals: DataFrame, claims: DataFrame, categories: Sequence[tuple[str, Column]], sure: Sequence[str], most: int = 20) -> DataFrame:
    """cluster, titles, teams, players, signals, category, spoiler, player, to, status: what the titles of each cluster say together.

    ``members``: cluster, id, at; ``tags``: id, slug, kind (team, player), start; ``signals``: id, names; ``claims``: id, player, to, status.  Teams and players are each listed once,
    in order of their first title and place, ``most`` of them; signals are the union.  ``categories`` are conditions over ``signals``, ``teams`` and ``players``, the first that holds counts; a cluster with one of ``sure``
    is a spoiler.  A claim counts if the cluster's claims name one player: the furthest status, and the target if it is one.  Null tables' cells say nothing; rows of ids that are in no cluster are left out.
    """
    place = members.select("cluster", "id", "at").distinct()

    def listed(kind: str) -> DataFrame:
        first = place.join(tags.where(F.col("kind") == kind), "id").groupBy("cluster", "slug").agg(F.min(F.struct("at", "id", "start")).alias("o"))
        best = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("o", "slug"))).alias("l"))
        return best.select(F.col("cluster").alias("_c"), F.transform(F.slice("l", 1, most), lambda x: x["slug"]).alias(f"{kind}s"))

    said = place.join(signals, "id").select("cluster", F.explode("names").alias("s")).distinct().groupBy(F.col("cluster").alias("_c")).agg(F.array_sort(F.collect_list("s")).alias("signals"))
    rank = F.create_map(*[x for i, s in enumerate((STATUS[-1], *STATUS[:-1])) for x in (F.lit(s), F.lit(i))])
    one = place.join(claims.where("player IS NOT NULL"), "id").groupBy(F.col("cluster").alias("_c")).agg(
        F.min("player").alias("player"), F.count_distinct("player").alias("_n"), F.min("to").alias("to"), F.count_distinct("to").alias("_t"), F.max_by("status", F.element_at(rank, F.col("status"))).alias("status"),
    )
    alone = F.col("_n") == 1
    one = one.select("_c", F.when(alone, F.col("player")).alias("player"), F.when(alone & (F.col("_t") == 1), F.col("to")).alias("to"), F.when(alone, F.col("status")).alias("status"))
    out = place.groupBy("cluster").agg(F.count("*").alias("titles"))
    for table in (listed("team"), listed("player"), said, one):
        out = out.join(table, F.col("cluster").eqNullSafe(F.col("_c")), "left").drop("_c")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("teams", "players", "signals")})
    return out.select("cluster", "titles", "teams", "players", "signals", cascade(categories).alias("category"), F.arrays_overlap("signals", F.array(*map(F.lit, sure)).cast("array<string>")).alias("spoiler"), "player", "to", "status")
