"""Operators that spread a hot key or an order over tasks, against the plain rule."""

import datetime
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators import cards, facts, joins, selection


def merged(table, keys):
    owner, by_id, out = {}, set(), []
    for ord_, id_, existing in table:
        mine = keys.get(ord_, [])
        target = next((owner[k] for k in mine if k in owner), None)
        if existing:
            action, target = "existing", ord_
        elif target is not None:
            action = "attached"
        elif id_ is not None and id_ in by_id:
            out.append((ord_, None, "refused"))
            continue
        else:
            action, target = "added", ord_
        if action != "attached":
            by_id.add(id_)
        for k in mine:
            owner.setdefault(k, target)
        out.append((ord_, target, action))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_in_order_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    table = [(i, rng.choice([None, *range(12)]), i < 8) for i in range(90)]
    table = [(i, i if e else d, e) for i, d, e in table]
    keys = {i: rng.sample(range(70), rng.randrange(4)) for i, *_ in table}
    df = spark.createDataFrame(table, "ord int, id int, existing boolean").repartition(3)
    k = spark.createDataFrame([(i, p, x) for i, xs in keys.items() for p, x in enumerate([*xs, *xs[:1]])] + [(3, 9, None)], "ord int, pos int, key int")
    got = sorted((r.ord, r.owner, r.action) for r in cards.merge_in_order(df, k).collect())
    assert got == merged(table, keys)
    assert len({a for *_, a in got}) >= 3
    assert cards.merge_in_order(df.limit(0), k.limit(0)).count() == 0


def test_rounds_hold_only_cards_with_keys_of_others(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(cards, "materialise", lambda df, name, make=cards.materialise: written.setdefault(name, []).append(out := make(df, name)) or (out, setattr(out, "n", out.count()))[0])
    df = spark.range(500).selectExpr("id AS ord", "id % 100 AS id", "id < 3 AS existing")
    k = spark.createDataFrame([(5, 0, 1), (7, 0, 1), (9, 0, 2)], "ord long, pos int, key int")
    got = sorted((r.ord, r.owner, r.action) for r in cards.merge_in_order(df, k).collect())
    assert got == merged([(i, i % 100, i < 3) for i in range(500)], {5: [1], 7: [1], 9: [2]})
    assert [t.n for t in written["cards"]] == [500, 2] and {t.n for t in written["refused"]} == {0}


def one_person(a, b):
    if sorted(a) == sorted(b):
        return "full"
    if len(a) == len(b) and any(x == y and len(x) > 1 for x in a for y in b):
        for p in itertools.permutations(b):
            if all(x == y or len(x) == 1 and y.startswith(x) or len(y) == 1 and x.startswith(y) for x, y in zip(a, p)):
                return "initial"
    return None


def test_fuzzy_names_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["ann", "ana", "lee", "li", "bo", "park", "a", "l", "b", "p", "Zoë"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 5))) for _ in range(60)] + ["Lee, A.", None, "", "A L", "L-A"]
    mine, theirs = names[::2], names[1::2]
    df = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "name string, often int")
    parts = lambda x: tuple(sorted(w for w in x.lower().replace("ë", "e").replace(",", " ").replace(".", " ").replace("-", " ").split()))
    want = {(parts(x), parts(y), one_person(parts(x), parts(y))) for x in mine if x for y in theirs if y and parts(y) and parts(x) and one_person(parts(x), parts(y))}
    got = [(tuple(r.l), tuple(r.r), r.basis) for r in joins.fuzzy_names(df(mine), df(theirs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({b for *_, b in got}) == 2


def test_medians(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 4)
    rng = random.Random(6)
    values = [(k, v) for k in (1, 2, 3, None) for v in [rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), 1e300, -1e308, 5e-324]) for _ in range(rng.randrange(1, 60))]]
    values += [(4, 2.0), (5, None), (6, float("nan")), (7, 1.0), (7, 2.0)]
    df = spark.createDataFrame(values, "k int, v double").repartition(3)
    real = {}
    for k, v in values:
        if v is not None and v == v:
            real.setdefault(k, []).append(v)
    assert {r.k: r.v for r in selection.lower_median(df, ["k"], "v").collect()} == {k: statistics.median_low(v) for k, v in real.items()}
    got = {r.k: r.v for r in selection.median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median_low(v) / 2 + statistics.median_high(v) / 2 for k, v in real.items()}
    assert selection.median(df, [], "v").count() == 1 and selection.median(df.limit(0), ["k"], "v").count() == 0


def test_as_of_over_many_ranges(spark):
    rng = random.Random(7)
    t0 = datetime.datetime(2026, 1, 1)
    at = lambda: t0 + datetime.timedelta(seconds=rng.randrange(10**6))
    left = [(rng.choice([1, 1, 1, 2, None]), i, at()) for i in range(300)] + [(1, 900, None), (9, 901, t0)]
    right = [(rng.choice([1, 1, 2, None]), at(), i) for i in range(60)] + [(1, None, 99)]
    right += [(1, right[0][1], 77), (right[0][0], right[0][1], 88)]
    a, b = spark.createDataFrame(left, "k int, i int, at timestamp"), spark.createDataFrame(right, "k int, seen timestamp, v int")
    want = {}
    for k, i, t in left:
        before = [(s, v) for q, s, v in right if q == k and k is not None and t and s and s <= t]
        want[i] = max(before)[1] if before else None
    assert {r.i: r.v for r in joins.as_of(a, b, "k", "at", "seen", ["v"]).collect()} == want
    assert joins.as_of(a.limit(0), b, "k", "at", "seen", ["v"]).count() == 0 and joins.as_of(a, b.limit(0), "k", "at", "seen", ["v"]).where("v IS NOT NULL").count() == 0


def test_facts_take_the_best_of_several(spark):
    own, rules = facts.match_rules()
    known = spark.createDataFrame([(1, 5, 6, 2, 1, "V", 3, False, None, None, [(10, "home", "x"), (20, "away", "y"), (30, "home", "x")]), (2, 5, 6, 0, 0, "W", 4, False, None, None, [])], "ref long, home int, away int, hg int, ag int, venue string, round int, extra boolean, pens_h int, pens_a int, goals array<struct<minute:int,side:string,scorer:string>>")
    kind = "id int, text string, refs array<long>, kind string, team int, rival int, a int, b int, venue string, round int, extra boolean, margin int, scorer string, n int, minute int, opening boolean, decisive boolean"
    none = [None] * 13
    said = [
        (1, "t", [2, 1, 1], "win", 5, 6, 2, 1, "V", 3, False, 1, "x", 2, 30, True, True), (2, None, None, *none, None), (3, "a\nb", [], *none, None), (4, "t", [7, 2], "draw", 6, 5, 0, 0, *[None] * 9),
        (5, "t", [1], "win", 6, 5, 1, 2, None, None, None, None, "y", None, 10, None, None),
    ]
    out = facts.verify(spark.createDataFrame(said, kind), "id", "refs", known, "ref", own, rules)
    assert {r.id: (r.fact, r.codes) for r in out.collect()} == {1: (1, []), 2: (None, ["ref-unknown"]), 3: (None, ["newline", "ref-unknown"]), 4: (2, []), 5: (1, ["winner-mismatch", "minute"])}
    assert len({r.code for r in own + rules}) >= 15


def test_positions_and_intervals_of_a_hot_key(spark):
    from tidemill.operators import windows

    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(400)]
    got = {(r.k, r.i): (r._i, r._n) for r in windows.positions(spark.createDataFrame(rows, "k int, i int"), ["k"], [F.desc("i")]).collect()}
    for key in (1, 2, None):
        mine = sorted((i for k, i in rows if k == key), reverse=True)
        assert all(got[key, i] == (p, len(mine)) for p, i in enumerate(mine))
    d0 = datetime.date(2024, 1, 20)
    spans = [(rng.choice([1, 1, 2, None]), d0 + datetime.timedelta(days=s), d0 + datetime.timedelta(days=s + rng.randrange(40))) for s in rng.choices(range(700), k=90)]
    want = []
    for key in (1, 2, None):
        last = None
        for s, e in sorted((s, e) for k, s, e in spans if k == key):
            if last and s <= last[2] + datetime.timedelta(days=1):
                last[2], last[3] = max(last[2], e), last[3] + 1
            else:
                last = [key, s, e, 1]
                want.append(last)
    out = windows.merge_intervals(spark.createDataFrame(spans, "k int, s date, e date"), "k", "s", "e").collect()
    assert sorted(((r.k, r.s, r.e, r.n) for r in out), key=repr) == sorted((tuple(w) for w in want), key=repr)
