import random

from pyspark.sql import functions as F

from tidemill.operators import entities

TERMS = [("Ann Lee", "ann", "player", False), ("lee", "lee", "team", True), ("a b c d e f", "long", "team", False), ("a b", "ab", "team", False), ("손흥민", "son", "player", False), ("손흥", "so", "team", False), ("東京", "tokyo", "team", False), ("京都", "kyoto", "team", False), ("Ö", "o", "team", False), ("o", "o2", "team", True), (None, "x", "team", False), ("", "y", "team", False)]


def brute(text):
    """Every name at every place; from the left, the longest."""
    out, end = [], 0
    folded = entities.fold(text)
    for start in range(len(text)):
        best = 0
        for term, *_ in TERMS:
            name = entities.fold(term or "")
            if name and folded.startswith(name, start) and entities.stands_alone(folded, start, start + len(name)):
                best = max(best, len(name))
        if best and start >= end:
            end = start + best
            out += [(slug, start, end) for term, slug, *_ in TERMS if entities.fold(term or "") == folded[start:end]]
    return sorted(out)


def test_hits_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "b", "c", "d", "e", "f", " ", " ", "a b c d e f", "Ann", "LEE", "lee", "손", "흥민", "손흥민", "東", "京", "京都", "o", "Ó", ".", "-"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(300)] + [(900, None), (901, ""), (902, "a b c d e f g")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "key long, text string, slug string, start int").repartition(3)
    terms = spark.createDataFrame(TERMS, "term string, slug string, kind string, shared boolean")
    want = sorted((i, *h) for i, t in rows if t for h in brute(t))
    assert sorted((r.id, r.slug, r.start, r.stop) for r in entities.hits(df, "key", "text", terms).collect()) == want
    monkeypatch.setattr(entities, "LARGEST", 9)  # the dictionary in several parts
    assert sorted((r.id, r.slug, r.start, r.stop) for r in entities.hits(df, "key", "text", terms).collect()) == want
    assert entities.hits(df, "key", "text", terms.limit(0)).count() == 0 and entities.hits(df.limit(0), "key", "text", terms).count() == 0


def test_reasons(spark):
    from tidemill import plans  # noqa: F401
    from tidemill.plans import entities as plan

    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    rows = spark.createDataFrame(list(enumerate(plan.TITLES)), "id int, text string").withColumn("league", F.lit("none"))
    found = entities.hits(rows, "id", "text", spark.createDataFrame(list(plan.TERMS), "term string, slug string, kind string, shared boolean"))
    out = entities.judged(found, spark.createDataFrame(list(plan.LEAGUES), "slug string, league string"), rows, rows.select("id", "league"), one(plan.SUFFIXES), one(plan.PLACES), one(plan.OCCUPATIONS)).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, {})[r.slug] = r.reason
    assert got[0] == {"harbour": None}
    assert got[1] == {"harbour": "unproved", "inter": None}
    assert got[2] == {"harbour": None, "mancity": None}
    assert got[3] == {"harbour": "place", "mancity": None} and got[4] == {"harbour": "lower", "mancity": None}
    assert got[5] == {"south": None, "harbour": None} and got[6] == {"milan": None, "roma": None}
    assert got[7] == {"inter": None, "milan": None} and got[8] == {"inter": "suffix"} and got[9] == {"milan": "unproved", "torino": "unproved"}
    assert got[10] == {"harbour-w": None, "mancity": "women"} and got[11] == {"kim": "occupation"} and got[12] == {"son": None, "mancity": None}
    assert got[13] == {"tokyo": None} and got[14] == {"roma": None, "torino": None} and got[15] == {"milan": "unproved"}
    assert 16 not in got and 17 not in got


def test_a_name_behind_a_discarded_one(spark):
    """The second name overlaps the first and goes; the third, inside it, stays."""
    terms = spark.createDataFrame([("x y", "1"), ("y z w v", "2"), ("w", "3")], "term string, slug string").withColumns({"kind": F.lit("k"), "shared": F.lit(False)})
    df = spark.createDataFrame([(1, "x y z w v")], "id int, text string")
    assert sorted(r.slug for r in entities.hits(df, "id", "text", terms).collect()) == ["1", "3"]


def test_tags_of_any_length(spark):
    from tidemill.operators import keywords

    terms = spark.createDataFrame([("a b c d e f g", 1), ("c", 2)], "term string, slug int")
    df = spark.createDataFrame([(1, list("zabcdefg"))], "id int, w array<string>")
    assert sorted((r.slug, r.pos) for r in keywords.tags(df, "id", "w", terms).collect()) == [(1, 2), (2, 4)]
    assert keywords.tags(df, "id", "w", terms.limit(0)).count() == 0
