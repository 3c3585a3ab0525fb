import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import audit, records
from tidemill.operators.audit import Refers, Row, Size, Unique


def at(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


def test_move_records_of_odd_evidence(spark):
    rows = [("c1", "p", "t", None, 0, 3, at(0)), ("c2", "p", "t", "f", 2, 1, at(2)), ("c2", "p", "t", "g", 3, 1, at(9)), ("c3", "p", "t", None, 4, 2, at(3)), ("c4", "p", None, None, 0, None, at(0)), ("c5", "q", "", "f", 0, 2, at(40)), ("c6", None, "t", "f", 3, 1, at(1)), ("c7", "q", "", "x", 3, 1, None), ("gone", "q", "z", "x", 3, 1, at(1))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "card string, player string, to string, `from` string, rank int, tier int, at timestamp, key string")
    got = {(r.player, r.to): (r.status, r["from"], r.best_tier, r.quiet, r.cards, [(h.card, h.status) for h in r.history]) for r in records.move_records(df, spark.createDataFrame([("gone",), ("gone",)], "card string"), F.lit(at(41))).collect()}
    assert got == {
        ("p", "t"): ("collapsed", "f", 1, False, 3, [("c1", "rumor"), ("c2", "agreed"), ("c3", "collapsed")]), ("p", None): ("rumor", None, None, True, 1, [("c4", "rumor")]), ("q", ""): ("rumor", "f", 2, False, 1, [("c5", "rumor")]),
    }
    assert records.move_records(df.limit(0), df.select("card").limit(0), F.lit(at(0))).count() == 0


def test_cluster_without_tags_or_with_two_claims(spark):
    m = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(1)), ("b", 3, at(0)), (None, 4, at(0))], "cluster string, id int, at timestamp")
    tags = spark.createDataFrame([(2, "x", "team", 0), (1, "y", "team", 5), (1, "x", "team", 9), (9, "z", "team", 0)], "id int, slug string, kind string, start int")
    said = spark.createDataFrame([(1, ["r", None]), (3, None)], "id int, names array<string>")
    claims = spark.createDataFrame([(1, "p", "t", "rumor"), (2, "q", None, "official"), (3, "p", None, "collapsed"), (3, "p", "t", "agreed")], "id int, player string, to string, status string")
    out = {r.cluster: r for r in records.cluster_analysis(m, tags, said, claims, [("two", F.size("teams") > 1)], ("r",)).collect()}
    assert out["a"].teams == ["y", "x"] and out["a"].spoiler and out["a"].category == "two" and out["a"].player is None and out["a"].titles == 2
    assert out["b"].teams == [] and not out["b"].spoiler and out["b"].category is None and (out["b"].player, out["b"].to, out["b"].status) == ("p", "t", "agreed") and out[None].titles == 1


def test_registry(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, None, "x"), (2, 7, None)], "k int, ref int, v string")
    b = spark.createDataFrame([(5,)], "id int")
    rules = [Row("r", "a", F.col("ref") > 6), Row("w", "a", F.col("v") == "x", audit.WARN), Unique("u", "a", ("k",)), Unique("uv", "a", ("k", "v")), Refers("f", "a", "ref", "b", "id"), Size("s", "b", 2), Size("e", "b", 1), Size("x", "a", 3, F.col("v") == "x")]
    got = sorted(tuple(r) for r in audit.audit({"a": a, "b": b}, {"a": "k"}, rules).collect())
    assert got == [("f", "error", "7", 1), ("r", "error", "2", 1), ("s", "error", "b", 1), ("u", "error", "2", 2), ("w", "warn", "1", 1), ("w", "warn", "2", 1), ("x", "error", "a", 2)]
    with pytest.raises(ValueError):
        audit.audit({"a": a}, {}, [rules[0], rules[0]])
    assert audit.audit({"a": a.limit(0), "b": b}, {"a": "k"}, rules[:5]).count() == 0
