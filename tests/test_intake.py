from pyspark.sql import functions as F

from tidemill.operators import intake
from tidemill.sources import adapters


def test_items_names_and_runs_of_nulls(spark):
    rows = spark.createDataFrame([(None,) * 6, ("T", "http://a.org/x", "2024-01-02T03:04:05Z", None, "s", None), ("T", "http://a/x", "2024-01-02T03:04:05Z", "", "s", "UTC"), ("x" * 201, None, None, None, "s", None)], "title string, link string, published string, summary string, source string, zone string")
    assert [r.reason for r in intake.normalised(rows).collect()] == ["no-source", None, "bad-link", "title-too-long"]
    assert intake.normalised(rows.limit(0)).count() == 0
    names = spark.createDataFrame([(1, "Zoë  Lee", "Z", 2), (2, "zoe-lee", "Y", 1), (3, "Z. Lee", "X", 0), (4, None, "W", 0), (5, "Bo Park", None, 0), (6, " . ", "V", 0)], "id int, written string, shown string, ord int")
    assert [tuple(r) for r in intake.display_index(names).collect()] == [("zoe lee", "Y", 2)]
    runs = spark.createDataFrame([("prod", "collect", "partial", [(None,), (True,)]), ("prod", "collect", "success", []), ("prod", None, "success", [(True,)]), ("prod", "collect", "success", None)], "e string, j string, s string, o array<struct<ok:boolean>>")
    assert [r.p for r in runs.select(intake.published(F.col("e"), F.col("j"), F.col("s"), F.col("o")).alias("p")).collect()] == [True, False, False, False]


def test_evaluation_and_standings_of_odd_rows(spark):
    want = spark.createDataFrame([("d", 1, "a"), ("d", 1, "b"), ("d", 2, None), ("d", None, "n"), ("e", 1, "a")], "day string, k int, value string")
    got = spark.createDataFrame([("d", 1, "a"), ("d", 2, "x"), ("d", None, "n"), ("f", 1, "z")], "day string, k int, value string")
    out = {r.day: (r.right, r.wrong, r.missing, r.extra, r.precision, r.recall) for r in intake.evaluation(want, got, ["k"]).collect()}
    assert out == {"d": (2, 1, 0, 0, 2 / 3, 2 / 3), "e": (0, 0, 1, 0, None, 0.0), "f": (0, 0, 0, 1, 0.0, None)}
    table = '{"standings": [{"type": "HOME", "table": [{"position": 1}]}, {"type": "TOTAL", "table": [{"position": 1, "team": {"id": 7, "name": "A"}, "playedGames": 1, "won": 1, "draw": 0, "lost": 0, "points": 3}, {"position": null}, {"position": 2, "team": null}]}]}'
    rows = spark.createDataFrame([("c", table), ("c", "nonsense"), ("c", None)], "comp string, json string")
    teams = spark.createDataFrame([(7, "a"), (None, "none")], "id long, slug string")
    good, unmatched = adapters.standing_rows(rows, "json", "comp", teams, spark.createDataFrame([], "competition string, `from` int, `to` int, zone string"))
    assert [(r.team, r.pts, r.zone, r.problem) for r in good.collect()] == [("a", 3, None, None)] and [(r.id, r.rows) for r in unmatched.collect()] == [(None, 1)]
