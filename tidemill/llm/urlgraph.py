"""URL filters: host and path rules, and for the rest trust and distrust spread over the link graph.

A rule is a host (with all its subdomains) and the start of a path; the longest rule that fits an url decides.
For urls without a rule their host decides.  A host is a trusted (blocked) seed to the share of its pages that
allow (block) rules caught.  Trust flows along links, distrust against them, each as personalised PageRank that
restarts from its seeds; scores are not normalised, so a lone seed keeps exactly its share however large the
graph is.  Rounds go on until the scores are settled.  A host is blocked if its distrust reaches ``threshold`` and passes its trust.

Links are the absolute ``href`` and ``src`` targets of the pages, counted once per page and pair of hosts; a host's own links
are left out.  Hosts are spread over tasks by name; counts are added up before they are shuffled.

Nulls, ties and repeats: a null url, or one without ``://``, has an empty host and path, fits no rule, is no
seed and is allowed.  Null html has no links.  Rules of equal length: the longer host, then the rule string.
Repeated pages are judged one by one and count as often as they occur.  No rules or no links: hosts keep their
seeds.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Most rules that are tried one after another; more are joined.
FEW_RULES = 64
#: Target hosts of absolute links.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
#: Ranks are settled when all later rounds together can move no host by SETTLED.  STEPS is the number of rounds that the SQL unrolls.
DAMPING, STEPS, SETTLED = 0.85, 20, 1e-9


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url, as far as they can be read; empty without ``://``."""
    rest = F.substr(url, F.locate("://", url) + 3)
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _in_order(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of ``rules`` (verdict, rule string) that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in reversed(_in_order(rules)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest) & (host != "")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``urls`` (host, path, …) with rule and said, as :func:`rule_for`; a long list is joined to the host and its parent domains."""
    if len(rules) <= FEW_RULES:
        rule, said = rule_for(F.col("host"), F.col("path"), rules)
        return urls.withColumn("rule", rule).withColumn("said", said)
    listed = [(k, text.partition("/")[0], "".join(text.partition("/")[1:]), text, said) for k, (said, text) in enumerate(_in_order(rules))]
    table = materialise(urls.sparkSession.createDataFrame(listed, "place long, suffix string, start string, rule string, said string"), "rules")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = urls.where("host <> ''").select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    first = parts.join(table, "suffix").where(F.startswith("path", "start")).groupBy("host", "path").agg(F.min(F.struct("place", "rule", "said")).alias("m"))
    return urls.join(first.select("host", "path", "m.rule", "m.said"), ["host", "path"], "left").select(*urls.columns, "rule", "said")


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind over ``edges`` (kind, src, dst, part), restarting from ``seeds`` (kind, host, seed)."""
    rank = seeds.withColumnRenamed("seed", "score")
    if edges.isEmpty():
        return rank
    # a round moves at most DAMPING times the sum of what the round before it moved, so all that is to come is a geometric series
    most = max(seeds.agg(F.sum("seed")).first()[0] or 0.0, 1.0)
    bound = math.ceil(math.log(SETTLED * (1 - DAMPING) / most) / math.log(DAMPING)) + 10
    for _ in range(bound):
        flow = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("part") * DAMPING).alias("score"))
        new = flow.unionByName(seeds.withColumnRenamed("seed", "score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = materialise(new, "ranks")
        moved = new.alias("n").join(rank.alias("o"), ["kind", "host"], "left").agg(F.coalesce(F.sum(F.abs(F.col("n.score") - F.coalesce("o.score", F.lit(0.0)))), F.lit(0.0))).first()[0]
        rank = new
        if moved * DAMPING / (1 - DAMPING) < SETTLED:
            return rank
    raise RuntimeError(f"the ranks of hosts are not settled after {bound} rounds: the last moved {moved}")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and trust and distrust of the host, per row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), _lower)).alias("links"))
    rows = materialise(with_rules(read, rules), "judged")
    per_host = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("n")).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("n")).alias("seed"))))
    seeds = materialise(per_host.select("host", kinds.alias("k")).where("k.seed > 0").select("k.kind", "host", "k.seed"), "seeds")
    links = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst")
    links = materialise(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("part")), "edges")
    scores = _spread(edges, seeds).groupBy(F.col("host").alias("_h")).agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    scores = materialise(scores, "host-scores")
    done = rows.join(scores, F.col("host") == F.col("_h"), "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    spread = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return done.select("page_id", "host", "path", "rule", F.coalesce("said", spread).alias("verdict"), "trust", "distrust")
