"""Names in titles of several scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import entities
from tidemill.plans.registry import query
from tidemill.session import table

#: The dictionary of the queries: term, slug, kind, shared.
TERMS = (
    ("North Harbour City Athletic Club", "harbour", "team", False), ("Harbour", "harbour", "team", True), ("Harbour Women", "harbour-w", "women", False),
    ("Milan", "milan", "team", True), ("Inter Milan", "inter", "team", False), ("Roma", "roma", "team", True), ("Torino", "torino", "team", True),
    ("Southern League", "south", "league", False), ("맨시티", "mancity", "team", False), ("손흥민", "son", "player", False), ("김민재", "kim", "player", False), ("東京", "tokyo", "team", False),
)
LEAGUES = (("harbour", "south"), ("mancity", "south"), ("milan", "north"), ("inter", "north"), ("roma", "north"), ("torino", "north"), ("tokyo", "east"))
SUFFIXES, PLACES, OCCUPATIONS = ("u21", "ii"), ("in", "at"), ("배우", "actor")
TITLES = (
    "North Harbour City Athletic Club win cup", "Harbour beat Inter Milan", "Harbour wait for 맨시티에게", "Fire at Harbour docks, 맨시티 say", "calm harbour before 맨시티",
    "Southern League: Harbour go top", "Milan 2-1 Roma", "Inter Milan fans and Milan", "Inter Milan u21 lose", "Milan and Torino talk", "Harbour Women beat 맨시티",
    "배우 김민재 화제", "손흥민이 맨시티전 골", "今日は東京の試合", "Roma-Torino 1-0 final", "Milán wait", "no name here", "Aharbours 안손흥민 romana",
)


def values(rows) -> str:
    said = lambda x: "'" + x + "'" if isinstance(x, str) else str(x).upper()
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows)


def titles(spark, sf_dir) -> DataFrame:
    """A title for each customer; every fifth comes from a source of one league."""
    at = (F.col("c_custkey") % len(TITLES)).cast("int")
    title: Column = F.element_at(F.array(*map(F.lit, TITLES)), at + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(title, F.when(F.col("c_custkey") % 3 == 0, " now").otherwise("")).alias("text"), F.when(F.col("c_custkey") % 5 == 0, "north").alias("league"))


@query(rf"""
WITH t AS (SELECT c_custkey AS id, ([{', '.join(f"'{x}'" for x in TITLES)}])[c_custkey % {len(TITLES)} + 1] || CASE WHEN c_custkey % 3 = 0 THEN ' now' ELSE '' END AS text, CASE WHEN c_custkey % 5 = 0 THEN 'north' END AS source FROM customer),
d(term, slug, kind, shared) AS (VALUES {values(TERMS)}), l(slug, league) AS (VALUES {values(LEAGUES)}),
r AS (SELECT id, text, strip_accents(lower(text)) AS low, strip_accents(lower(term)) AS name, slug, kind, shared, unnest(range(1, length(text) + 1)) AS p FROM t, d),
c AS (SELECT *, p + length(name) - 1 AS q, low[p - 1:p - 1] AS lb, low[p + length(name):p + length(name)] AS ra FROM r WHERE low[p:p + length(name) - 1] = name),
k AS (SELECT *, regexp_matches(name, '^[가-힣]') AS hangul, regexp_matches(name, '^[一-鿿]') AS han FROM c),
m AS (SELECT id, text, slug, kind, shared, p, q, low FROM k WHERE han OR (hangul AND NOT regexp_matches(coalesce(lb, ''), '[가-힣]')) OR (NOT hangul AND NOT regexp_matches(coalesce(lb, '') || coalesce(ra, ''), '[a-z0-9]'))),
h AS (SELECT m.*, text[p:q] AS said, regexp_extract(low[1:p - 1], '([\p{{L}}\p{{N}}]+)[ -]*$', 1) AS bw, regexp_extract(low[q + 1:], '^[ -]*([\p{{L}}\p{{N}}]+)', 1) AS aw, league
      FROM m LEFT JOIN l USING (slug) WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND o.p <= m.p AND o.q >= m.p AND (o.p < m.p OR o.q > m.q))),
e AS (SELECT h.*, CASE WHEN kind = 'team' AND id IN (SELECT id FROM h WHERE kind = 'women') THEN 'women' WHEN kind = 'team' AND aw IN ('u21', 'ii') THEN 'suffix' WHEN kind = 'player' AND (bw IN ('배우', 'actor') OR aw IN ('배우', 'actor')) THEN 'occupation'
        WHEN shared AND said[1:1] <> upper(said[1:1]) THEN 'lower' WHEN shared AND bw IN ('in', 'at') THEN 'place' END AS early FROM h),
n AS (SELECT *, lead(slug) OVER w AS nslug, lead(shared) OVER w AS nshared, lead(league) OVER w AS nleague, lead(p) OVER w AS np, lead(q) OVER w AS nq FROM e WHERE kind = 'team' AND early IS NULL AND league IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY p)),
s AS (SELECT id, p, np FROM n WHERE shared AND nshared AND nleague = league AND nslug <> slug AND (regexp_matches(text[q + 1:np - 1], '^\s*\d{{1,2}}\s?[-–:]\s?\d{{1,2}}\s*$') OR (regexp_matches(text[q + 1:np - 1], '^\s?[-–]\s?$') AND regexp_matches(text[nq + 1:nq + 12], '^\s?\d{{1,2}}\s?[-–:]\s?\d{{1,2}}'))))
SELECT e.id, slug, kind, p - 1 AS start, q AS stop, said, league, coalesce(early, CASE WHEN shared AND kind IN ('team', 'player') AND NOT (
    EXISTS (SELECT 1 FROM e o WHERE o.id = e.id AND o.kind = 'team' AND NOT o.shared AND o.early IS NULL AND o.league = e.league AND o.slug <> e.slug) OR EXISTS (SELECT 1 FROM e o WHERE o.id = e.id AND o.kind = 'league' AND o.slug = e.league)
    OR EXISTS (SELECT 1 FROM t WHERE t.id = e.id AND t.source = e.league) OR EXISTS (SELECT 1 FROM s WHERE s.id = e.id AND e.p IN (s.p, s.np))) THEN 'unproved' END) AS reason FROM e
""")
def entity_tags(spark, sf_dir):
    rows = titles(spark, sf_dir)
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    found = entities.hits(rows, "id", "text", spark.createDataFrame(list(TERMS), "term string, slug string, kind string, shared boolean"))
    leagues = spark.createDataFrame(list(LEAGUES), "slug string, league string")
    out = entities.judged(found, leagues, rows.select("id", "text"), rows.select("id", "league").where("league IS NOT NULL"), one(SUFFIXES), one(PLACES), one(OCCUPATIONS))
    return out.drop("shared")


@query(r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(list_prepend(NULL, w[:-2])) AS l, unnest(w[2:] || [NULL]) AS r FROM w)
SELECT CASE WHEN x = 'and' THEN '3' WHEN x = 'der' THEN '4' ELSE '5' END AS slug, count(*) AS n, count(DISTINCT doc_id) AS docs FROM u WHERE x IN ('and', 'der', 'la') GROUP BY 1
""")
def entity_counts(spark, sf_dir):
    """How often names of a dictionary stand in whole documents."""
    terms = spark.createDataFrame([("and", "3"), ("Der", "4"), ("la", "5")], "term string, slug string").withColumns({"kind": F.lit("word"), "shared": F.lit(False)})
    found = entities.hits(table(spark, sf_dir, "documents"), "doc_id", "text", terms)
    return found.groupBy("slug").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"))
