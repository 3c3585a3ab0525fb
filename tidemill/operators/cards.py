"""Cards and their sources: order, lead, merge, facts, claims and plans of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import keywords
from tidemill.operators.components import components
from tidemill.scratch import discard, materialise


def source_order(sources: Column, lead: Column) -> Column:
    """An array of sources (n, tier, at, u) with the lead first, then tier, latest, url."""
    keyed = F.transform(sources, lambda s: F.struct((s["n"] != lead).alias("k"), s["tier"].alias("tier"), (-F.unix_micros(s["at"])).alias("t"), s["u"].alias("u"), s["n"].alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def lead(rows: DataFrame, keys: Sequence[str], limited: Column, tier: str, weight: str, at: Column, ord_: str, value: str) -> DataFrame:
    """The member that leads its group: unlimited retention, tier, weight, time (null last), input order."""
    order = F.struct(limited.cast("int"), F.col(tier), -F.col(weight), at.isNull().cast("int"), F.coalesce(-F.unix_micros(at), F.lit(0)), F.col(ord_))
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("lead"))


def merge_by_keys(cards: DataFrame, id_: str, key: str) -> DataFrame:
    """(id, owner): cards that share any key, directly or through others, belong to the one with the least id."""
    least = cards.groupBy(key).agg(F.min(id_).alias("a"))
    edges = cards.join(least, key).where(F.col("a") != F.col(id_)).select("a", F.col(id_).alias("b")).distinct()
    owners = components(edges).withColumnRenamed("label", "owner")
    return cards.select(F.col(id_).alias("id")).distinct().join(owners, "id", "left").withColumn("owner", F.coalesce("owner", "id"))


def merge_in_order(cards: DataFrame, keys: DataFrame) -> DataFrame:
    """(ord, id, owner, action): what becomes of ``cards`` (ord, id, existing) that are taken one after another, by their ``keys`` (ord, pos, key).

    Existing cards stay; the first that has a key owns it.  A new card with a key that is owned goes to the owner of the first such of its keys
    (``attached``), and its other keys become the owner's; one with no such key is ``refused`` if a card that was kept has its id, else
    ``added`` and an owner itself.  A refused card owns nothing.  ``owner`` is the ord of the owning card, null if refused.

    Each step depends on earlier cards alone, so the same end is reached without taking turns: the owner of a key is that of the first card with the key that was not refused,
    which makes every attached card point at an earlier one; the refused are found again from the last round's refused until they no longer change, among cards with a key of others alone, and then the
    pointers are followed to their ends.  ``ord`` is unique, existing cards come first; null keys join nothing, null ids collide with nothing; a key that a card repeats counts where it stands first, and of keys at one place the least.
    """
    cards = materialise(cards.select(F.col("ord").cast("long").alias("ord"), "id", F.coalesce("existing", F.lit(False)).alias("existing")), "cards")
    keys = keys.where("key IS NOT NULL").groupBy(F.col("ord").cast("long").alias("ord"), "key").agg(F.min("pos").alias("pos"))
    # a key of one card joins nothing; cards without others are never attached, so the rounds need no more of them than the first of each id
    every = materialise(keys, "card-keys")
    shared = materialise(every.join(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi"), "shared-keys")
    discard(every)
    tied = cards.join(shared.select("ord").distinct().withColumn("_tied", F.lit(True)), "ord", "left")
    tied = materialise(tied.withColumn("_tied", F.coalesce("_tied", F.lit(False))), "tied-cards")
    mine = tied.where("_tied").drop("_tied")
    free = tied.where("NOT _tied AND id IS NOT NULL").join(mine.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("ord").alias("free"))
    mine = materialise(mine.join(free, "id", "left"), "cards")
    discard(tied)
    new = mine.where("NOT existing").select("ord")
    refused = mine.where("false").select("ord")
    pointers = None
    before = 0
    while True:
        first = shared.join(refused, "ord", "left_anti").groupBy("key").agg(F.min("ord").alias("first"))
        to = shared.join(new, "ord", "left_semi").join(first, "key").where("first < ord").groupBy("ord").agg(F.min_by("first", F.struct("pos", "key")).alias("to"))
        last, pointers = pointers, materialise(to, "pointers")
        roots = mine.join(pointers, "ord", "left_anti").where("id IS NOT NULL")
        kept = roots.groupBy("id").agg(F.least(F.min("ord"), F.min("free")).alias("least"))
        again = materialise(roots.join(kept, "id").where("NOT existing AND ord > least").select("ord"), "refused")
        n = again.count()
        done = n == before and again.join(refused, "ord", "left_anti").isEmpty()
        discard(refused, *([last] if last else []))
        if done:
            break
        refused, before = again, n
    ends = components(pointers.select(F.col("to").alias("a"), F.col("ord").alias("b")))
    tied = pointers.select("ord").join(ends.select(F.col("id").alias("ord"), "label"), "ord")
    out = cards.join(tied, "ord", "left")
    least = out.where("label IS NULL AND id IS NOT NULL").groupBy("id").agg(F.min("ord").alias("_least"))
    out = out.join(least, "id", "left")
    action = F.when(F.col("existing"), "existing").when(F.col("label").isNotNull(), "attached").when(F.col("ord") > F.col("_least"), "refused").otherwise("added")
    return out.select("ord", "id", F.when(action != "refused", F.coalesce("label", "ord")).alias("owner"), action.alias("action"))


def top_with_cut(rows: DataFrame, keys: Sequence[str], goals: str, order: Sequence[Column], n: int, list_limit: int) -> DataFrame:
    """First ``n`` rows per key; where the list is as long as its limit, rows at its least number of goals are left out, as equal ones may be missing."""
    from tidemill.operators.windows import top

    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(goals).alias("_least"))
    whole = rows.join(size, list(keys)).where((F.col("_n") < list_limit) | (F.col(goals) > F.col("_least")))
    return top(whole.drop("_n", "_least"), keys, order, n)


def decisive(goals: DataFrame, key: str, side: str, ord_: str, scorer: str) -> DataFrame:
    """Per match: the winner, the scorer of its decisive goal (the loser's goals plus one), and scorers of three or more, in order of name."""
    from pyspark.sql import Window

    sides = goals.groupBy(key).agg(F.count_if(F.col(side) == "home").alias("h"), F.count_if(F.col(side) == "away").alias("a"))
    winner = F.when(F.col("h") > F.col("a"), "home").when(F.col("h") < F.col("a"), "away")
    rows = goals.join(sides.withColumn("winner", winner), key).withColumn("_n", F.row_number().over(Window.partitionBy(key, side).orderBy(ord_)))
    hit = (F.col(side) == F.col("winner")) & (F.col("_n") == F.least("h", "a") + 1)
    facts = rows.groupBy(key).agg(F.max("winner").alias("winner"), F.max(F.when(hit, F.col(scorer))).alias("decisive"))
    three = goals.groupBy(key, scorer).count().where("count >= 3").groupBy(key).agg(F.array_sort(F.collect_list(scorer)).alias("three"))
    return facts.join(three, key, "left").withColumn("three", F.coalesce("three", F.array().cast("array<string>")))


def claims(rows: DataFrame, key: str, official: int = 3, collapsed: int = 4) -> DataFrame:
    """Claims (key, player, to, rank, tier, publisher, at) combined: one player or none; the highest stage that is backed; collapse if it came last; the target if it is the only one."""
    backed = (F.col("best") <= 2) | (F.col("publishers") >= 2)
    per_rank = rows.where(F.col("rank") != collapsed).groupBy(key, "rank").agg(F.min("tier").alias("best"), F.count_distinct("publisher").alias("publishers"))
    stage = per_rank.where((F.col("rank") == 0) | backed).groupBy(key).agg(F.max("rank").alias("stage"))
    facts = rows.groupBy(key).agg(F.count_distinct("player").alias("players"), F.min("player").alias("player"), F.when(F.count_distinct("to") == 1, F.max("to")).alias("to"), F.max_by("rank", F.struct("at", "rank")).alias("last"))
    out = facts.where("players = 1").join(stage, key, "left")
    status = F.when((F.col("last") == collapsed) & (F.coalesce("stage", F.lit(0)) != official), F.lit(collapsed)).otherwise(F.col("stage"))
    return out.select(key, "player", "to", status.alias("status"))


def low_watermark(runs: DataFrame, keys: DataFrame, key: str, at: str, ok: Column, now: Column, overlap: int, reach: int) -> DataFrame:
    """Per key where collection starts again: the last good run less an overlap, not before ``reach`` seconds ago; and what it rests on."""
    last = runs.where(ok).groupBy(key).agg(F.max(at).alias("_last"))
    floor, start = F.unix_timestamp(now) - reach, F.unix_timestamp("_last") - overlap
    basis = F.when(F.col("_last").isNull(), "first-run").when(start < floor, "capped").otherwise("last-success")
    return keys.join(last, key, "left").select(key, F.timestamp_seconds(F.greatest(floor, F.coalesce(start, floor))).alias("start"), basis.alias("basis"))


def fetch_plan(rows: DataFrame, done: DataFrame, id_: str, order: Sequence[Column], allowance: int) -> DataFrame:
    """What to fetch of the rows not done yet, most urgent first, as far as the allowance goes."""
    return rows.join(done.select(id_), id_, "left_anti").orderBy(*order, id_).limit(max(0, allowance))


def name_counts(old: DataFrame, seen: DataFrame, known: DataFrame, at: Column) -> DataFrame:
    """Unknown names (name, count, first, last) after a run: one more for each name seen, new ones added, known ones gone."""
    now = seen.select("name").distinct().withColumn("hit", F.lit(1))
    both = old.join(now, "name", "full").join(known.select("name"), "name", "left_anti")
    hit = F.col("hit").isNotNull()
    return both.select("name", (F.coalesce("count", F.lit(0)) + hit.cast("int")).alias("count"), F.coalesce("first", at).alias("first"), F.when(hit, at).otherwise(F.col("last")).alias("last"))


def gap_ledger(old: DataFrame, new: DataFrame, healed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage gaps (keys, id; a row per missing id) after a run: old and new ones together, without the healed ids; gaps with none left are gone."""
    every = old.select(*keys, "id").unionByName(new.select(*keys, "id")).distinct()
    return every.join(healed.select("id"), "id", "left_anti").select(*keys, "id")


def prefer_new(parts: Sequence[str], old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A file's parts from the new snapshot, each kept from the old one where the new has none; and which were kept."""
    both = new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "full")
    kept = F.filter(F.array(*[F.when(F.col(f"n.{p}").isNull() & F.col(f"o.{p}").isNotNull(), F.lit(p)) for p in parts]), lambda x: x.isNotNull())
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{p}", f"o.{p}").alias(p) for p in parts], kept.alias("kept"))


def title_claims(rows: DataFrame, names: DataFrame, clubs: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """id, player, from, to, status, evidence, reason: what each title of ``rows`` (id, title) claims, or why it claims nothing.

    ``names`` (id, player) are the players found in a title, ``clubs`` (id, club, role) its clubs with role ``from``
    or ``to``; ``patterns`` are those of :func:`keywords.anchored`, the strongest first.  Reasons: no-player,
    many-players, no-stage, many-clubs, same-club.
    """
    who = names.groupBy("id").agg(F.count_distinct("player").alias("players"), F.min("player").alias("player"))
    role = lambda r: [F.count_distinct(F.when(F.col("role") == r, F.col("club"))).alias(f"n_{r}"), F.min(F.when(F.col("role") == r, F.col("club"))).alias(r)]
    where = clubs.groupBy("id").agg(*role("from"), *role("to"))
    out = rows.select("id", "title").join(who, "id", "left").join(where, "id", "left")
    out = out.withColumn("hit", F.get(keywords.anchored(F.col("title"), F.col("player"), patterns), 0))
    rules = [("no-player", F.col("player").isNull()), ("many-players", F.col("players") > 1), ("no-stage", F.col("hit").isNull()), ("many-clubs", (F.col("n_from") > 1) | (F.col("n_to") > 1)), ("same-club", F.col("from") == F.col("to"))]
    out = out.withColumn("reason", keywords.cascade(rules))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return out.select("id", good(F.col("player")).alias("player"), good(F.col("from")).alias("from"), good(F.col("to")).alias("to"), good(F.col("hit.stage")).alias("status"), good(F.col("hit.evidence")).alias("evidence"), "reason")


def rerun(existing: DataFrame, incoming: DataFrame, id_: str, sources: str) -> DataFrame:
    """Cards after a further run of the same day: a known card keeps all it has and only gains sources, behind its own; others are added.

    Both tables have the same columns and one row per id.  A second call with the same ``incoming`` changes nothing.
    Null sources count as none; rows with a null id are kept from both sides.
    """
    new = incoming.select(F.col(id_).alias("_id"), F.struct(*[F.col(c) for c in existing.columns]).alias("_new"))
    old = existing.select(F.col(id_).alias("_old"), F.struct(*existing.columns).alias("_card"))
    none = F.array().cast(existing.schema[sources].dataType)
    both = F.array_distinct(F.concat(F.coalesce(f"_card.{sources}", none), F.coalesce(f"_new.{sources}", none)))
    known = F.col("_card").isNotNull()
    keep = [F.when(known, F.col(f"_card.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) if c != sources else both.alias(c) for c in existing.columns]
    return old.join(new, F.col("_old") == F.col("_id"), "full").select(*keep)


def lead_index(rows: DataFrame, keys: Sequence[str], importance: str, ord_: str) -> DataFrame:
    """Per group the place of its first card of the greatest importance (null counts least)."""
    return rows.groupBy(*keys).agg(F.min_by(ord_, F.struct(F.col(importance).isNull().alias("none"), (-F.col(importance)).alias("i"), F.col(ord_))).alias("lead"))


def auxiliary_list(cards: DataFrame, evidence: DataFrame, keys: Sequence[str], id_: str, at: str, floor: Column, n: int) -> DataFrame:
    """Per key the latest ``n`` cards from ``floor`` on that are not its evidence (keys, id), with their rank."""
    from tidemill.operators.windows import top

    return top(cards.where(F.col(at) >= floor).join(evidence.select(*keys, id_), [*keys, id_], "left_anti"), keys, [F.col(at).desc(), F.col(id_)], n)


def entity_merges(rows: DataFrame, key: str, id_: str, at: str, scores: str, card: str, seconds: int = 12 * 3600) -> DataFrame:
    """(id, entity, card): cards of a window of ``seconds`` (from its first) of one key that are one story, named by their least id.

    A window counts if it holds two cards or more, one of the ``scores`` is common to all and at most one card is there
    already (``card``).  Rows with a null key are in none.
    """
    from tidemill.operators.folds import anchored_windows

    rows = rows.where(F.col(key).isNotNull())
    placed = anchored_windows(rows, key, [id_], at, seconds).join(rows.select(id_, scores, card), id_)
    group = [key, "anchor"]
    size = placed.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(card).alias("cards"), F.min(card).alias("_card"), F.min(id_).alias("entity")).where("n >= 2 AND cards <= 1")
    common = placed.select(*group, F.explode(F.array_distinct(scores)).alias("s")).groupBy(*group, "s").agg(F.count("*").alias("c")).groupBy(*group).agg(F.max("c").alias("c"))
    return placed.select(id_, *group).join(size.join(common, group).where("c = n"), group).select(id_, "entity", F.col("_card").alias("card"))
