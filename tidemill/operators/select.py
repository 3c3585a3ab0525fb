"""Filters, verdicts and de-duplication over tables with an explicit order column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_verdict(at: Column, start: Column, now: Column, drop_after: int = 3 * 3600, clamp_after: int = 300) -> Column:
    """``future`` / ``clamp`` / ``out`` / ``in``, tested in this order; seconds ahead of now."""
    ahead = F.unix_micros(at) - F.unix_micros(now)
    return F.when(ahead > drop_after * 1_000_000, "future").when(ahead > clamp_after * 1_000_000, "clamp").when(at < start, "out").otherwise("in")


def apply_window(rows: DataFrame, starts: DataFrame, key: str, at: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows in the window of their key, late ones clamped to now and flagged; and per key the counts of each verdict.

    ``starts`` (key, start) is a dimension; Spark broadcasts it by its size.
    """
    judged = rows.join(starts, key).withColumn("verdict", window_verdict(F.col(at), F.col("start"), now))
    kept = judged.where(F.col("verdict").isin("in", "clamp")).withColumn("clamped", F.col("verdict") == "clamp").withColumn(at, F.when(F.col("clamped"), now).otherwise(F.col(at)))
    counts = judged.groupBy(key).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("in", "clamp", "out", "future")], F.max(F.greatest(F.lit(0), F.unix_timestamp(at) - F.unix_timestamp(now))).alias("max_ahead"))
    return kept.drop("start", "verdict"), counts


def facet_match(values: Column, chosen: Sequence[str]) -> Column:
    """Or within an axis; an empty choice passes."""
    return F.lit(True) if not chosen else F.arrays_overlap(values, F.array(*[F.lit(c) for c in chosen]))


def facet_counts(rows: DataFrame, axis: str) -> DataFrame:
    """(value, n): rows per value of an array column, each row once per distinct value."""
    return rows.select(F.explode(F.array_distinct(axis)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def domain_verdict(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``rule``: the longest listed domain that is the host or a parent of it; ``not-listed`` / ``invalid`` otherwise.

    The host is spread to its own parents, so the lookup is an equi-join on the domain and not a scan of the list.
    """
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).where(F.col(host).isNotNull()).distinct()
    hit = hosts.withColumn("domain", F.explode(parents)).join(domains, "domain").groupBy(host).agg(F.max_by(F.struct("domain", "rule"), F.length("domain")).alias("m"))
    out = rows.join(hit, host, "left")
    return out.withColumn("domain", F.col("m.domain")).withColumn("rule", F.when(F.col(host).isNull(), "invalid").otherwise(F.coalesce("m.rule", F.lit("not-listed")))).drop("m")


def unseen(rows: DataFrame, key: str, seen: DataFrame, today: DataFrame) -> DataFrame:
    """Rows whose key is not in ``seen``, or is among today's own keys."""
    old = seen.select(key).join(today.select(key), key, "left_anti")
    return rows.join(old, key, "left_anti")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order; unlike ``dropDuplicates`` it is the same on every run.

    With one order column it is an aggregation with partial results before the shuffle, so a hot key is no hot task.
    """
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(rows.columns)


def dedup(rows: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """First row per key with ``sources``, the distinct sources in first-seen order, and ``n``, the rows it stands for."""
    seen = rows.groupBy(key, source).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    sources = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", source))), lambda x: x[source]).alias("sources"), F.sum("n").alias("n"))
    return first_of(rows, [key], [F.col(order)]).join(sources, key)


def upsert(old: DataFrame, new: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Merge by key: all columns of the newer row, and ``change``: added, replaced, same (content equal, old row kept) or kept."""
    text = lambda side: F.sha2(F.to_json(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in content]), {"ignoreNullFields": "false"}), 256)
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    has_old, has_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    change = F.when(~has_old, "added").when(~has_new, "kept").when(text("o") == text("n"), "same").otherwise("replaced")
    take = change.isin("added", "replaced")
    return both.select(*[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns], change.alias("change"))


def content_hash(columns: Sequence[str]) -> Column:
    """A hash of a row's content in the order of column names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def same_content(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Whether two tables hold the same rows (with repeats) in ``columns``: counts and sums of row hashes, no rows leave the executors."""

    def digest(df: DataFrame):
        h = content_hash(columns)
        parts = [F.sum(F.conv(F.substring(h, p, 8), 16, 10).cast("decimal(30,0)")) for p in (1, 9, 17, 25)]
        return tuple(df.agg(F.count("*"), *parts).first())

    return digest(a) == digest(b)


def first_seen(seen: DataFrame, new: DataFrame, key: str, at: str, now: Column, days: int = 90) -> DataFrame:
    """Earliest time per key over both tables, without keys older than ``days``."""
    return seen.select(key, at).unionByName(new.select(key, at)).groupBy(key).agg(F.min(at).alias(at)).where(F.unix_timestamp(at) >= F.unix_timestamp(now) - days * 86400)


def purge_sources(cards: DataFrame, sources: DataFrame, taken_down: DataFrame, now: Column, lead_hours: int = 30) -> DataFrame:
    """Cards (id, created, src array<struct<name, at>>) with what retention leaves of them.

    A source expires ``days`` after the later-arriving of its time and the card's, less a lead; a card goes if it
    is taken down or its first source expires; other expired sources go alone.
    """
    rows = cards.join(taken_down.select("id"), "id", "left_anti").select("id", "created", F.posexplode("src").alias("pos", "s"))
    rows = rows.select("id", "created", "pos", F.col("s.name").alias("name"), F.col("s.at").alias("at")).join(sources.select("name", "days"), "name", "left")
    expires = F.unix_timestamp(F.least("at", "created")) + F.col("days") * 86400 - lead_hours * 3600
    rows = rows.withColumn("gone", F.coalesce(expires <= F.unix_timestamp(now), F.lit(False)))
    left = F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "name", "at")))), lambda x: x["name"])
    return rows.groupBy("id").agg(F.bool_or(F.col("gone") & (F.col("pos") == 0)).alias("lead_gone"), left.alias("names"), F.count_if("gone").alias("dropped")).where(~F.col("lead_gone")).drop("lead_gone")


def prune_plan(files: DataFrame, roster: DataFrame, key: str, most: float) -> DataFrame:
    """``files`` (distinct keys) with gone (not in ``roster``), and refused: a share of more than ``most`` would go, so none may; an empty roster refuses too."""
    marked = files.select(key).distinct().join(roster.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").select(key, F.col("_in").isNull().alias("gone"))
    share = marked.agg(F.avg(F.col("gone").cast("int"))).first()[0]
    return marked.withColumn("refused", F.lit(share is not None and share > most))
