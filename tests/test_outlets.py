"""Edge rows of the adapters, registries, links and plans: nulls, broken texts, ties, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.operators import aggregate, cards, joins, select
from tidemill.sources import adapters, readers


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_broken_records(spark):
    df = spark.createDataFrame([(None,), ("{",), ("{}",), ('{"id": 1, "status": "F", "matchday": 3, "home": {"id": 2}, "away": {"id": 2}, "score": {"home": 1, "away": 0}}',)], "j string")
    assert rows(adapters.match_rows(df, "j", {"F": "finished"})) == [(1, "finished", "md-3", 2, 2, 1, 0, "same-side")] + [(None, None, None, None, None, None, None, "unreadable")] * 3
    assert adapters.goal_rows(df, "j").count() == 0 and adapters.scorer_rows(df, "j", []).count() == 0


def test_clock_and_score(spark):
    df = spark.createDataFrame([("45+2'", "2 - 1"), (" 90 ", "0:0"), ("HT", "x"), (None, None), ("1234", "123-1")], "c string, s string")
    got = df.select(adapters.clock(F.col("c")).alias("c"), adapters.score_pair(F.col("s")).alias("s")).collect()
    assert [(r.c and tuple(r.c), r.s and tuple(r.s)) for r in got] == [((45, 2), (2, 1)), ((90, 0), (0, 0)), (None, None), (None, None), (None, None)]


def test_registered_and_paths(spark):
    df = spark.createDataFrame([("a.json",), ("a.jsn",), (None,), ("zzzzzzzz",)], "p string")
    assert rows(readers.registered(df, "p", ["*.json", "a.json"])) == rows(spark.createDataFrame([("a.json", "*.json", None), ("a.jsn", None, "a.json"), (None, None, None), ("zzzzzzzz", None, None)], "p string, q string, n string"))
    refs = spark.createDataFrame([("x.png",), ("../x.png?a",), ("/y",), ("#top",), ("mailto:a",), ("//h/x",), (None,)], "r string")
    assert [r[0] for r in refs.select(urls.site_path(F.col("r"), F.lit("/a/b/c.html"))).collect()] == ["/a/b/x.png", "/a/x.png", "/y", None, None, None, None]


def test_shared_links(spark):
    at = dt.datetime(2026, 1, 1)
    schema = "id int, category string, at timestamp, teams array<string>, players array<string>"
    left = spark.createDataFrame([(1, "a", at, ["x", "y", "y"], None), (2, "a", at, ["x"], ["p"]), (3, "a", at, None, ["q"]), (4, None, at, ["x", "y"], ["p"])], schema)
    right = spark.createDataFrame([(1, "a", at, ["y", "x"], []), (2, "a", at, ["x", "z"], ["q"]), (3, "a", at, [], ["q"]), (4, "b", at, ["x", "y"], ["p"])], schema)
    assert rows(joins.shared_links(left, right, 60)) == [(1, 1)]
    assert joins.shared_links(left.limit(0), right, 60).count() == 0


def test_ties_and_leads(spark):
    m = spark.createDataFrame([(1, "a", "b", 1, 0, None, None), (2, "b", "a", 1, 0, 3, 4), (3, "c", "d", 1, None, None, None), (4, "e", "f", 2, 2, None, None), (5, "g", "g", 1, 0, None, None)], "at int, h string, w string, hg int, ag int, hp int, ap int")
    got = {r.a: (r.winner, r.by) for r in aggregate.tie_decisions(m, [], "h", "w", "hg", "ag", "at", "hp", "ap").collect()}
    assert got == {"a": ("a", "pens"), "c": (None, "unresolved"), "e": (None, "unresolved")}
    c = spark.createDataFrame([("k", 1, None), ("k", 2, 5), ("k", 3, 5), ("n", 7, None)], "g string, ord int, imp int")
    assert rows(cards.lead_index(c, ["g"], "imp", "ord")) == [("k", 2), ("n", 7)]


def test_entity_merges_and_prunes(spark):
    hour = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    e = spark.createDataFrame([("k", 1, hour(0), ["1-0", "1-0"], None), ("k", 2, hour(12), ["1-0", "2-0"], 9), ("k", 3, hour(13), ["1-0"], None), ("l", 4, hour(0), ["1-0"], 5), ("l", 5, hour(1), ["1-0"], 6), ("m", 6, hour(0), None, None), ("m", 7, hour(0), ["1-0"], None), (None, 8, hour(0), ["1-0"], None), (None, 9, hour(0), ["1-0"], None)], "key string, id int, at timestamp, s array<string>, card int")
    assert rows(cards.entity_merges(e, "key", "id", "at", "s", "card")) == [(1, 1, 9), (2, 1, 9)]
    files, roster = (spark.createDataFrame([(x,) for x in names], "f string") for names in (["a", "b", "c", "c"], ["a", "b"]))
    assert rows(select.prune_plan(files, roster, "f", 0.4)) == [("a", False, False), ("b", False, False), ("c", True, False)]
    assert {r.refused for r in select.prune_plan(files, roster.limit(0), "f", 0.4).collect()} == {True}
    assert select.prune_plan(files.limit(0), roster, "f", 0.4).count() == 0
