"""Claims of moves in titles of three languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import slots
from tidemill.plans.entities import values
from tidemill.plans.registry import query
from tidemill.session import table

NAMES = (("Ann Lee", "ann", "player"), ("Bo Diaz", "bo", "player"), ("안리", "ann", "player"), ("Harbour", "harbour", "team"), ("Inter Milan", "inter", "team"), ("Torino", "torino", "team"), ("Roma", "roma", "team"), ("로마", "roma", "team"))
TEAMS = (("Harbour", "harbour"), ("Inter Milan", "inter"), ("Torino", "torino"))
#: lang, term, mark.
LEXICON = (
    *[("en", t, m) for t, m in (("signs for", "sign"), ("joins", "sign"), ("in talks with", "talk"), ("agrees terms with", "agree"), ("linked with", "link"), ("move to", "goto"), ("collapses", "fall"), ("leaves", "leave"), ("from", "from"), ("and", "and"), (":", "cut"), ("|", "cut"),
        ("?", "doubt"), ("could", "doubt"), ("stays", "stay"), ("new deal", "renew"), ("agent", "agent"), ("career mode", "game"), ("gossip", "gossip"), ("transfer", "topic"))],
    *[("es", t, m) for t, m in (("ficha por", "sign"), ("negocia con", "talk"), ("suena para", "link"), ("desde", "from"), (":", "cut"), ("¿", "doubt"), ("renueva", "renew"), ("traspaso", "topic"))],
    *[("ko", t, m) for t, m in (("이적", "sign"), ("협상", "talk"), ("이적설", "link"), ("재계약", "renew"))],
)
#: lang, state, mark, next, slot, status.
GRAMMAR = (
    *[(lang, *r) for lang in ("en", "es") for r in (
        ("start", "player", "who", "player", None), ("who", "sign", "signs", None, None), ("signs", "team", "done", "to", "official"), ("done", "from", "comes", None, None), ("comes", "team", "done", "from", None),
        ("who", "talk", "talks", None, None), ("talks", "team", "done", "to", "negotiating"), ("who", "agree", "agrees", None, None), ("agrees", "team", "done", "to", "agreed"), ("who", "link", "links", None, None), ("links", "team", "done", "to", "rumor"),
        ("who", "w", "who", None, None), ("who", "doubt", "who", None, None), ("who", "goto", "goes", None, None), ("goes", "team", "way", "to", None), ("way", "w", "way", None, None), ("way", "fall", "fell", None, "collapsed"), ("who", "leave", "left", None, "official"), ("left", "team", "done", "from", None))],
    *[("ko", *r) for r in (("start", "team", "where", "to", None), ("where", "w", "where", None, None), ("where", "player", "who", "player", None), ("start", "player", "who", "player", None), ("who", "w", "who", None, None), ("who", "team", "who", "to", None), ("who", "sign", "done", None, "official"), ("who", "talk", "done", None, "negotiating"), ("who", "link", "done", None, "rumor"))],
)
GUARDS = (*[(m, "topic") for m in ("sign", "talk", "agree", "link", "goto", "leave", "topic", "renew", "agent")], ("renew", "renewal"), ("agent", "agent"), ("game", "hypothetical"), ("gossip", "roundup"), ("doubt", "doubt"), ("stay", "stay"))
CURRENT = (("ann", "roma"), ("bo", "torino"))
#: Title with the team for {T}, its language, and what it claims: player, from, to ({t}: that team's slug), status, reason.
CASES = (
    ("Ann Lee signs for {T} from Roma", "en", "ann", "roma", "{t}", "official", None), ("Official: Ann Lee joins {T}", "en", "ann", None, "{t}", "official", None), ("Ann Lee could be in talks with {T}", "en", "ann", None, "{t}", "rumor", None),
    ("Ann Lee in talks with {T}", "en", "ann", None, "{t}", "negotiating", None), ("Ann Lee agrees terms with {T} | fans happy?", "en", "ann", None, "{t}", "agreed", None), ("Ann Lee move to {T} suddenly collapses", "en", "ann", None, "{t}", "collapsed", None),
    ("Ann Lee move to {T} collapses: Ann Lee signs for {T}", "en", "ann", None, "{t}", "rumor", None), ("Ann Lee linked with {T}, Bo Diaz, Roma, more", "en", None, None, None, None, "roundup"), ("Ann Lee scores for {T}", "en", None, None, None, None, "no-topic"),
    ("Ann Lee signs for {T} in new deal", "en", None, None, None, None, "renewal"), ("Agent of Ann Lee in talks with {T}", "en", None, None, None, None, "agent"), ("Career mode: Ann Lee joins {T}", "en", None, None, None, None, "hypothetical"),
    ("Star joins {T}", "en", None, None, None, None, "no-player"), ("Ann Lee joins {T}: Bo Diaz joins Roma", "en", None, None, None, None, "players"), ("Transfer of Ann Lee in doubt", "en", None, None, None, None, "no-status"),
    ("Ann Lee stays: transfer talk", "en", None, None, None, None, "no-status"), ("Ann Lee leaves", "en", None, None, None, None, "no-move"), ("Ann Lee joins Roma", "en", None, None, None, None, "current-team"), ("Gossip: Ann Lee joins {T}", "en", None, None, None, None, "roundup"),
    ("Ann Lee ficha por {T} desde Roma", "es", "ann", "roma", "{t}", "official", None), ("¿Ann Lee negocia con {T}?", "es", "ann", None, "{t}", "rumor", None), ("Bo Diaz suena para {T}", "es", "bo", None, "{t}", "rumor", "current-team?"), ("Traspaso: Ann Lee renueva", "es", None, None, None, None, "renewal"),
    ("안리, 로마 협상", "ko", None, None, None, None, "current-team"), ("{T} 안리 이적", "ko", "ann", None, "{t}", "official", None), ("{T} 안리 이적설", "ko", "ann", None, "{t}", "rumor", None), ("안리 재계약", "ko", None, None, None, None, "renewal"), ("Ann Lee signs for {T}", "fr", None, None, None, None, None),
)


def move_titles(spark, sf_dir):
    """A title for each customer, with the team of its nation."""
    rows = table(spark, sf_dir, "customer")
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    case = F.col("c_custkey") % len(CASES)
    team = pick([t for t, _ in TEAMS], F.col("c_nationkey") % 3)
    return rows.select(F.col("c_custkey").alias("id"), F.replace(pick([c[0] for c in CASES], case), F.lit("{T}"), team).alias("title"), pick([c[1] for c in CASES], case).alias("lang"))


def _sql() -> str:
    null = lambda x: "NULL" if x is None else f"'{x}'"
    cases = ", ".join(f"({i}, {', '.join(map(null, c[1:]))})" for i, c in enumerate(CASES))
    return f"""
WITH k(case_, lang, player, "from", "to", status, reason) AS (VALUES {cases}), t(team_no, slug) AS (VALUES {', '.join(f"({i}, '{s}')" for i, (_, s) in enumerate(TEAMS))}), n(player_, team) AS (VALUES {values(CURRENT)}),
j AS (SELECT c_custkey AS id, player, "from", replace("to", '{{t}}', slug) AS "to", status, reason FROM customer JOIN k ON case_ = c_custkey % {len(CASES)} JOIN t ON team_no = c_nationkey % 3 WHERE lang <> 'fr'),
r AS (SELECT * REPLACE (CASE WHEN reason = 'current-team?' THEN CASE WHEN "to" = team THEN 'current-team' END ELSE reason END AS reason) FROM j LEFT JOIN n ON player_ = player)
SELECT id, CASE WHEN reason IS NULL THEN player END AS player, CASE WHEN reason IS NULL THEN "from" END AS "from", CASE WHEN reason IS NULL THEN "to" END AS "to", CASE WHEN reason IS NULL THEN status END AS status, reason FROM r
"""


@query(_sql())
def move_claims(spark, sf_dir):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return slots.claims(
        move_titles(spark, sf_dir), made(NAMES, "term string, slug string, kind string"), made(LEXICON, "lang string, term string, mark string"),
        made(GRAMMAR, "lang string, state string, mark string, next string, slot string, status string"), made(GUARDS, "mark string, effect string"), made(CURRENT, "player string, team string"), ("en", "es", "ko"),
    )
