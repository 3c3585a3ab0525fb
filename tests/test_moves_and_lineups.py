import datetime

from pyspark.sql import functions as F

from tidemill.operators import lineups, observations, slots
from tidemill.plans import moves


def made(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def claims(spark, titles):
    rows = made(spark, [(i, t, lang, "x") for i, (t, lang) in enumerate(titles)], "id long, title string, lang string, mark string")
    return {
        r.id: (r.player, r["from"], r.to, r.status, r.reason)
        for r in slots.claims(
            rows, made(spark, moves.NAMES, "term string, slug string, kind string"), made(spark, moves.LEXICON, "lang string, term string, mark string"),
            made(spark, moves.GRAMMAR, "lang string, state string, mark string, next string, slot string, status string"), made(spark, moves.GUARDS, "mark string, effect string"), made(spark, moves.CURRENT, "player string, team string"), ("en", "es", "ko"),
        ).collect()
    }


def test_claims_and_every_reason(spark):
    cases = [(c[0].replace("{T}", "Torino"), c[1]) for c in moves.CASES]
    got = claims(spark, [*cases, (None, "en"), ("", "ko"), ("Harbour", "es"), ("Ann Lee joins Harbour: Ann Lee joins Torino", "en")])
    reasons = {v[-1] for v in got.values()} - {None}
    assert reasons == {"roundup", "no-topic", "renewal", "agent", "hypothetical", "no-player", "players", "no-status", "no-move", "current-team"}
    n = len(cases)
    assert [got[n + k][-1] for k in range(3)] == ["no-topic"] * 3
    assert got[n + 3] == ("ann", None, None, "official", "no-move") or got[n + 3][-1] == "no-move"  # two clubs to go to are none
    assert n - 1 not in got  # another language


def test_minutes_of_odd_records(spark):
    listed = made(spark, [(1, "home", p, f"P{p}", p < 3) for p in (1, 2, 3, 3)] + [(1, "home", None, "?", True), (2, "away", 5, "Q", True)], "match long, side string, player long, name string, start boolean")
    changes = made(spark, [
        (1, 4, "home", 45, 2, "out", 1), (1, 4, "home", 45, 2, "in", 3), (1, 5, "home", 88, 0, "off", 1), (1, 6, "home", 90, 3, "off", 3), (1, 7, "home", None, 0, "out", 2), (1, 8, "home", 60, 0, "in", 8), (1, 8, "home", 60, 0, "in", 8), (2, 0, "away", 10, 0, "off", 5),
    ], "match long, ord int, side string, minute int, extra int, kind string, player long")
    ends = made(spark, [(1, 90), (2, None)], "match long, minute int")
    got = {(r.match, r.player): (r.entered, r["left"], r.minutes, r.dismissed, r.problems) for r in lineups.minutes(listed, changes, ends).collect()}
    assert got == {
        (1, 1): (0, 45, 45, True, []), (1, 2): (0, None, 90, False, ["no-clock"]), (1, 3): (45, 90, 45, True, []), (1, 8): (60, None, 30, False, ["not-listed"]), (2, 5): (0, 10, 10, True, []),
    }
    assert lineups.minutes(listed.limit(0), changes.limit(0), ends.limit(0)).count() == 0
    bad = made(spark, [("nonsense",), (None,), ('{"id": 7}',)], "json string")
    assert [t.count() for t in lineups.from_numbers(bad, "json")] == [0, 0, 1]


def test_lines_find_their_run(spark):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    runs = made(spark, [("a", 1, at(0), at(5)), ("a", 2, at(10), None), ("b", 3, at(2), None)], "key string, run long, started timestamp, ended timestamp")
    lines = made(spark, [("a", at(m), f"n={m}") for m in (0, 5, 6, 10, 99)] + [("b", at(1), "n=1"), ("b", at(2), "n=2"), (None, at(3), "n=3"), ("a", None, "n=4")], "key string, at timestamp, text string")
    out = observations.stitched(lines, runs, "key", "at", "started", "ended", "run")
    assert sorted((r.text, r.run) for r in out.collect() if r.run) == [("n=0", 1), ("n=10", 2), ("n=2", 3), ("n=5", 1), ("n=99", 2)]
    told = observations.facts(out, "run", "at", "text", [observations.Fact("n", r"n=(\d+)", "sum"), observations.Fact("first", r"n=(\d+)", "first"), observations.Fact("many", r"n=\d\d", "count")])
    assert {r.run: (r.n, r["first"], r.many, r.lines) for r in told.collect()} == {1: (5.0, "0", 0, 2), 2: (109.0, "10", 2, 2), 3: (2.0, "2", 0, 1)}
    parts = out.where(F.col("key") == "a").select(F.spark_partition_id()).distinct().count()
    assert parts >= 1
