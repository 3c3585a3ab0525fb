"""What rows meet within a reach of time, without their pairs."""

import datetime
import random

from pyspark.sql import functions as F

from tidemill.operators import joins, matches

START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_met_and_lone_links_equal_all_pairs(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(0, 300, 5)])) for i in range(80)]
    right = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(0, 300, 5)])) for i in range(30)]
    near = lambda p, q: None not in (p[1], q[1], p[2], q[2]) and p[1] == q[1] and abs(p[2] - q[2]) <= 10
    frame = lambda rows, id_: spark.createDataFrame([(i, k, None if t is None else at(t)) for i, k, t in rows], f"{id_} int, k string, at timestamp")
    a, b = frame(left, "a"), frame(right, "b")
    got = {r.a: (r.low, r.high) for r in joins.met(a, b, ["k"], "at", 10, {"low": (F.min, F.col("b")), "high": (F.max, F.col("b"))}).collect()}
    mates = {p[0]: [q[0] for q in right if near(p, q)] for p in left}
    assert got == {i: (min(m), max(m)) if m else (None, None) for i, m in mates.items()}
    back = {q[0]: [p[0] for p in left if near(p, q)] for q in right}
    lone = {(i, m[0]) for i, m in mates.items() if len(m) == 1 and len(back[m[0]]) == 1}
    assert lone and {tuple(r) for r in joins.lone_links(a, b, ["k"], "at", 10).collect()} == lone


def test_shared_links_make_no_pairs(spark):
    """Many rows of one player: the join by tag and bucket alone was all with all."""
    rows = lambda n: spark.range(n).select("id", F.lit(1).alias("category"), F.lit(START).alias("at"), F.lit(None).cast("array<string>").alias("teams"), F.array(F.lit("p")).alias("players"))
    out = joins.shared_links(rows(300), rows(300), 60)
    assert out.count() == 0
    assert "_bucket" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_links_equal_the_listed_pairs(spark):
    rng = random.Random(8)
    row = lambda i, away: (i, rng.randrange(3), rng.randrange(0, 400, 4), rng.randrange(2) + away, rng.randrange(3) + away, rng.choice([None, 0, 1, 2, 3]) if rng.random() < 0.2 else rng.randrange(4), rng.choice([None, 1, 2]))
    left, right = [row(i, 0) for i in range(60)], [row(i, 100) for i in range(50)]
    confirmed = [(0, 100), (1, 101)]
    frame = lambda rows, id_: spark.createDataFrame([(r[0], r[1], at(r[2]), *r[3:]) for r in rows], f"{id_} int, slot int, at timestamp, home int, away int, score int, finish int")
    pairs = [(x, y) for x in left for y in right if x[1] == y[1] and abs(x[2] - y[2]) <= 10]
    lone = lambda ps: [(x, y) for x, y in ps if sum(p[0] is x for p in ps) == 1 and sum(p[1] is y for p in ps) == 1]
    first = lone([(x, y) for x, y in pairs if (x[3], y[3]) in confirmed and (x[4], y[4]) in confirmed])
    rest = [(x, y) for x, y in pairs if not any(x is p or y is q for p, q in first)]
    dark = [(x, y) for x, y in rest if x[5] is None or y[5] is None]
    same = [(x, y) for x, y in rest if x[5] is not None and x[5] == y[5]]
    clear = [(x, y) for x, y in lone(same) if not any(x is p or y is q for p, q in dark)]
    links = {x[0]: y[0] for x, y in first + [(x, y) for x, y in clear if x[6] == y[6]]}

    def reason(x):
        has = lambda ps: any(p[0] is x for p in ps)
        if x[0] in links:
            return None
        tests = ((not has(pairs), "no-candidate"), (not has(rest), "taken"), (has(dark), "unknown-score"), (not has(same), "other-score"), (not has(clear), "many"))
        return next((name for holds, name in tests if holds), "finish")

    out = matches.evidence_links(frame(left, "a"), frame(right, "b"), spark.createDataFrame(confirmed, "team int, other int"), 10)
    assert {r.a: (r.b, r.reason) for r in out.collect()} == {x[0]: (links.get(x[0]), reason(x)) for x in left}
    assert "_u" not in out._jdf.queryExecution().optimizedPlan().toString()
