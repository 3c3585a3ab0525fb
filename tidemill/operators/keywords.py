"""Keyword groups, tagging, categories and scores of items. Dictionaries are tables or parameters; none is built in."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of words in any script; what ``\b`` takes for one differs between Java versions.
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class Group:
    """Whole-word terms, and phrases that are blanked out before the terms are looked for."""

    name: str
    terms: Sequence[str]
    excludes: Sequence[str] = field(default=())


def hits(text: Column, group: Group) -> Column:
    """Whether a text has a term of the group outside the group's excluded phrases."""
    words = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
    if group.excludes:
        text = F.regexp_replace(text, rf"(?i){START}(?:{words(group.excludes)}){END}", " ")
    return F.coalesce(text.rlike(rf"(?i){START}(?:{words(group.terms)}){END}"), F.lit(False))


def matched(text: Column, groups: Sequence[Group]) -> Column:
    """Names of the groups that hit, in order."""
    return F.filter(F.array(*[F.when(hits(text, g), F.lit(g.name)) for g in groups]), lambda x: x.isNotNull())


def unshared_terms(terms: DataFrame) -> DataFrame:
    """(slug, term) without terms that two or more slugs claim."""
    one = terms.groupBy("term").agg(F.count_distinct("slug").alias("n")).where("n = 1").select("term")
    return terms.join(one, "term", "left_semi")


def _longest(terms: DataFrame) -> int:
    """Tokens of the longest entry of a dictionary."""
    return terms.agg(F.max(F.size(F.split("term", " "))).alias("n")).first()["n"] or 1


def tags(rows: DataFrame, id_: str, tokens: str, terms: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, slug, pos): dictionary entries found as runs of tokens, the longest for each start; an equi-join on the run's text.

    Runs of up to ``longest`` tokens are looked at, by default as many as the longest entry has; :mod:`entities` has the form for long dictionaries and any script.
    """
    longest = longest or _longest(terms)
    at = F.explode(F.expr(f"filter(flatten(transform(sequence(1, greatest(size({tokens}), 1)), i -> transform(sequence(1, {longest}), n -> struct(i AS pos, n AS words, concat_ws(' ', slice({tokens}, i, n)) AS term)))), x -> x.pos + x.words - 1 <= size({tokens}))"))
    runs = rows.select(F.col(id_).alias("id"), at.alias("r")).select("id", "r.*")
    found = runs.join(terms, "term")
    return found.groupBy("id", "pos").agg(F.max_by("slug", F.struct("words", "slug")).alias("slug")).select("id", "slug", "pos")


def tags_in_context(rows: DataFrame, id_: str, tokens: str, terms: DataFrame, evidence: DataFrame, vetoes: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, slug, pos of its first hit): dictionary tags of rows of cased tokens that their context bears out.

    ``terms``: term (lower case), slug, shared.  A hit is a run of tokens that all start with a capital, a digit or a
    letter without case.  A hit inside a longer one does not count.  A ``shared`` term, which also means other things,
    counts only beside a hit of one of its ``evidence`` (slug, evidence); a slug falls to a hit of one of its
    ``vetoes`` (slug, veto).  Runs are as in :func:`tags`.
    """
    longest = longest or _longest(terms)
    at = F.explode(F.expr(f"filter(flatten(transform(sequence(1, greatest(size({tokens}), 1)), i -> transform(sequence(1, {longest}), n -> struct(i AS pos, n AS words, slice({tokens}, i, n) AS run)))), x -> x.pos + x.words - 1 <= size({tokens}) AND forall(x.run, t -> t <> '' AND substring(t, 1, 1) = upper(substring(t, 1, 1))))"))
    runs = rows.select(F.col(id_).alias("id"), at.alias("r")).select("id", "r.pos", "r.words", F.lower(F.array_join("r.run", " ")).alias("term"))
    found = runs.join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("pos", "words", "slug", "shared")).alias("hits"))
    inside = "exists(hits, g -> g.pos <= h.pos AND g.pos + g.words >= h.pos + h.words AND g.words > h.words)"
    hit = found.select("id", F.explode(F.expr(f"filter(hits, h -> NOT {inside})")).alias("h")).select("id", "h.*")
    there = hit.select("id", "slug").distinct()
    borne = evidence.join(there.withColumnRenamed("slug", "evidence"), "evidence").select("id", "slug").distinct()
    vetoed = vetoes.join(there.withColumnRenamed("slug", "veto"), "veto").select("id", "slug").distinct()
    sure = hit.where("NOT shared").unionByName(hit.where("shared").join(borne, ["id", "slug"], "left_semi"))
    return sure.join(vetoed, ["id", "slug"], "left_anti").groupBy("id", "slug").agg(F.min("pos").alias("pos"))


def signals(text: Column, groups: Sequence[Group]) -> Column:
    """One boolean per group, as a struct."""
    return F.struct(*[hits(text, g).alias(g.name) for g in groups])


def spoiler(found: Column, scored: Column, subject: Column, likely: Sequence[str], sure: Sequence[str]) -> Column:
    """Whether a text gives a result away: a score, a ``sure`` signal, or a ``likely`` one with a ``subject`` it speaks of."""
    some = lambda names: F.coalesce(F.greatest(*[found[n].cast("int") for n in [*names, *names]]) > 0, F.lit(False)) if names else F.lit(False)
    return scored | some(sure) | (some(likely) & subject)


def cluster_facts(rows: DataFrame, cluster: str) -> DataFrame:
    """What the members (id, source, tags, spoiler, at) of each cluster say together: n, sources, tags (their union, sorted), spoiler (any), lead (the first member) and first."""
    one = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.coalesce(F.bool_or("spoiler"), F.lit(False)).alias("spoiler"), F.min(F.struct("at", "id")).alias("_m"))
    tags = rows.select(cluster, F.explode("tags").alias("_t")).distinct().groupBy(F.col(cluster).alias("_c")).agg(F.array_sort(F.collect_list("_t")).alias("tags"))
    out = one.join(tags, F.col(cluster).eqNullSafe(F.col("_c")), "left")
    return out.select(cluster, "n", "sources", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "spoiler", F.col("_m.id").alias("lead"), F.col("_m.at").alias("first"))


def auxiliary(category: Column, claim: Column, mentions: Column, player: Column) -> Column:
    """Whether a card only backs up a player's transfer: of that category, without a claim of its own, and with the player among its mentions."""
    return F.coalesce((category == "transfer") & claim.isNull() & F.array_contains(mentions, player), F.lit(False))


def cascade(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """The first category whose condition holds."""
    out = F.lit(default).cast("string")
    for name, when in reversed(rules):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out


#: Stands for the anchoring name in patterns.
ANCHOR = "\u0001"


def anchored(text: Column, name: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Array of (stage, evidence) of the patterns that match around a row's own name, in order.

    ``patterns`` are (stage, regular expression) in which ``ANCHOR`` stands for the name, so that one fixed set of
    expressions serves every name.  The evidence is what the first match covers, with the name put back.  Names
    count as whole words only.  A null or empty text or name matches nothing.
    """
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    marked = F.when(F.length(name) > 0, F.regexp_replace(F.translate(text, ANCHOR, " "), quoted, F.lit(ANCHOR)))
    found = F.array(*[F.struct(F.lit(stage).alias("stage"), F.regexp_extract(marked, rf"(?i){pattern}", 0).alias("evidence")) for stage, pattern in patterns])
    found = F.filter(found, lambda x: x.evidence.contains(ANCHOR))
    return F.transform(found, lambda x: F.struct(x.stage.alias("stage"), F.replace(x.evidence, F.lit(ANCHOR), name).alias("evidence")))


def speech(text: Column, name: Column, verbs: Sequence[str], least: int = 2) -> Column:
    """How a quotation of ``least`` words or more is given to a name: ``colon`` (name: "…"), ``before`` (name said "…"), ``after`` ("…" said name), or null."""
    said, words = "|".join(re.escape(v) for v in verbs), rf"\S+(?:\s+\S+){{{least - 1},}}"
    quote = "|".join(rf"{a}{words}?{b}" for a, b in (('"', '"'), ("“", "”"), ("«", "»")))
    forms = (("colon", rf"{ANCHOR}\s*:\s*(?:{quote})"), ("before", rf"{ANCHOR},?\s+(?:{said}),?:?\s+(?:{quote})"), ("after", rf"(?:{quote}),?\s+(?:{said})\s+{ANCHOR}"))
    return F.get(anchored(text, name, forms), 0)["stage"]


# Factors of the composite score.
TIER = {1: 1.25, 2: 1.0, 3: 0.8}
TRACKED, BIG, CUP, TRANSFER = 3.0, 1.3, 1.25, 1.2
STEP, STEP_MOST, HALF_LIFE, NO_SCOPE = 0.5, 3.0, 24.0, 0.5


def composite_score(weight: Column, tier: Column, tracked: Column, big: Column, cup: Column, transfer: Column, publishers: Column, age_hours: Column, scope: Column, boost: float = 1.0) -> Column:
    """Product of source weight, tier, keyword, cluster size, recency and scope factors."""
    by_tier = F.when(tier == 1, TIER[1]).when(tier == 2, TIER[2]).otherwise(TIER[3])
    words = F.when(tracked, TRACKED).otherwise(1.0) * F.when(big, BIG).otherwise(1.0) * F.when(cup, CUP).otherwise(1.0) * F.when(transfer, TRANSFER * boost).otherwise(1.0)
    size = F.least(F.lit(STEP_MOST), F.lit(1.0) + F.lit(STEP) * F.greatest(F.lit(0), publishers - 1))
    return weight * by_tier * words * size * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_hours) / HALF_LIFE) * F.when(scope, 1.0).otherwise(NO_SCOPE)


def importance(score: Column, rank: Column, head_taken: Column) -> Column:
    """4, 3, 2, 1 by score; the first-ranked at 3 or more is 5 unless the head is taken."""
    return F.when((rank == 1) & (score >= 3) & ~head_taken, 5).when(score >= 3, 4).when(score >= 2, 3).when(score >= 1.3, 2).otherwise(1)


def clamped_age(age: Column, clamped: Column, held: float = 12.0) -> Column:
    """Least trusted age of a group; at most ``held`` hours if any member's time was clamped (aggregate)."""
    return F.least(F.min(F.when(~clamped, age)), F.when(F.bool_or(clamped), F.lit(held)))


def prefix_match(query_tokens: Column, words: Column, part: float = 0.6) -> Column:
    """Every query token starts a word, or a word of at least ``part`` of its length starts it."""
    return F.forall(query_tokens, lambda t: F.exists(words, lambda w: w.startswith(t) | (t.startswith(w) & (F.length(w) >= F.length(t) * part))))


def out_of_scope(rules: Sequence[tuple[str, Column, Column]]) -> Column:
    """The first of ``rules`` (reason, sign, evidence) whose sign a text has without the evidence that overrides it; null for texts that stay."""
    out = F.lit(None).cast("string")
    for reason, sign, evidence in reversed(rules):
        out = F.when(F.coalesce(sign, F.lit(False)) & ~F.coalesce(evidence, F.lit(False)), F.lit(reason)).otherwise(out)
    return out
