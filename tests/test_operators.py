import datetime
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import aggregate, cards, checks, cluster, folds, joins, keywords, select, windows


def ts(minutes):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


def test_window_verdict_edges(spark):
    now = ts(0)
    rows = [(0, ts(5)), (1, ts(5.01)), (2, ts(180)), (3, ts(180.01)), (4, ts(-60)), (5, ts(-60.01)), (6, ts(0))]
    df = spark.createDataFrame(rows, "i int, at timestamp")
    v = select.window_verdict(F.col("at"), F.lit(ts(-60)), F.lit(now))
    assert [r.v for r in df.select("i", v.alias("v")).orderBy("i").collect()] == ["in", "clamp", "clamp", "future", "in", "out", "in"]


def test_dedup_first_seen_order(spark):
    rows = [(3, "k", "b"), (1, "k", "a"), (2, "k", "a"), (4, "j", "c"), (5, None, "d")]
    out = select.dedup(spark.createDataFrame(rows, "ord int, key string, source string").where("key IS NOT NULL"), "key", "ord", "source").orderBy("key").collect()
    assert [(r.key, r.ord, list(r.sources), r.n) for r in out] == [("j", 4, ["c"], 1), ("k", 1, ["a", "b"], 3)]


def test_domain_verdict(spark):
    d = spark.createDataFrame([("a.com", "allow"), ("x.a.com", "deny")], "domain string, rule string")
    h = spark.createDataFrame([("a.com",), ("x.a.com",), ("y.x.a.com",), ("xa.com",), (None,)], "host string")
    got = {r.host: r.rule for r in select.domain_verdict(h, "host", d).collect()}
    assert got == {"a.com": "allow", "x.a.com": "deny", "y.x.a.com": "deny", "xa.com": "not-listed", None: "invalid"}


def test_quota_against_plain_rule(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.random() < 0.3, rng.randint(0, 5)) for g in range(12) for i in range(rng.randint(0, 25))]
    out = windows.with_quota(spark.createDataFrame(rows, "g int, i int, q boolean, s int"), ["g"], F.col("q"), [F.desc("s"), F.col("i")], 8, 3).collect()
    for g in range(12):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
        first = [r for r in mine if r[2]][:3]
        want = first + [r for r in mine if r not in first][: 8 - len(first)]
        assert sorted(r.i for r in out if r.g == g) == sorted(r[1] for r in want)


def test_streaks_and_chunks(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.choice("csx")) for k in range(20) for t in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "k int, t int, e string")
    got = {r.k: (r.streak, r.since) for r in windows.trailing(df, "k", ["t"], F.col("e") == "c", F.col("e") == "s", "t").collect()}
    for k in range(20):
        n, since = 0, None
        for _, t, e in sorted((r for r in rows if r[0] == k), reverse=True):
            if e == "s":
                break
            if e == "c":
                n, since = n + 1, t
        assert got[k] == (n, since)
    sizes = windows.chunks(df, ["k"], [F.col("t")], 5).groupBy("k", "chunk").count().collect()
    for k in range(20):
        mine = [r["count"] for r in sorted(sizes, key=lambda r: r.chunk) if r.k == k]
        assert max(mine) <= 5 and max(mine) - min(mine) <= 1 and mine == sorted(mine, reverse=True)


def plain_fold(ranks):
    s, p = ranks[0], -1 if ranks[0] == 4 else ranks[0]
    for n in ranks[1:]:
        if n == 4:
            s = s if s in (3, 4) else 4
        elif s == 4:
            s, p = (n, n) if n > p else (s, p)
        elif n > s:
            s, p = n, max(p, n)
    return s


def test_status_fold(spark):
    rng = random.Random(3)
    lists = [[rng.randint(0, 4) for _ in range(rng.randint(1, 9))] for _ in range(200)]
    rows = [(k, i, r) for k, x in enumerate(lists) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, i int, rank int")
    assert {r.k: r.status for r in folds.status_of(df, "k", ["i"], "rank").collect()} == {k: plain_fold(x) for k, x in enumerate(lists)}
    changes = {(r.k, r.i): (r.status, r.changed) for r in folds.status_changes(df, "k", ["i"], "rank").collect()}
    for k, x in enumerate(lists):
        for i in range(len(x)):
            now, before = plain_fold(x[: i + 1]), plain_fold(x[:i]) if i else None
            assert changes[k, i] == (now, now != before)


def test_anchored_windows_are_inclusive(spark):
    df = spark.createDataFrame([(1, i, ts(m)) for i, m in enumerate([0, 719, 720, 721, 1441, 1442])], "k int, i int, at timestamp")
    got = [r.anchor for r in folds.anchored_windows(df, "k", ["i"], "at", 12 * 3600).orderBy("i").collect()]
    assert got == [ts(0), ts(0), ts(0), ts(721), ts(721), ts(1442)]


def test_anchored_windows_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(k, i, ts(m)) for k in range(4) for i, m in enumerate(sorted(rng.choices(range(9000), k=80)))] + [(None, 0, ts(5)), (None, 1, ts(6))]
    got = {(r.k, r.i): r.anchor for r in folds.anchored_windows(spark.createDataFrame(rows, "k int, i int, at timestamp"), "k", ["i"], "at", 3600 * 3).collect()}
    want, last = {}, {}
    for k, i, at in rows:
        if k not in last or (at - last[k]).total_seconds() > 3600 * 3:
            last[k] = at
        want[k, i] = last[k]
    assert got == want


def test_within_bounds(spark):
    a = spark.createDataFrame([(1, 1, ts(0)), (2, 1, ts(100)), (3, None, ts(0))], "x int, k int, at timestamp")
    b = spark.createDataFrame([(7, 1, ts(60)), (8, 1, ts(161)), (9, None, ts(0))], "y int, k int, bt timestamp")
    pairs = joins.within(a, b, ["k"], "at", "bt", 3600)
    assert {(r.x, r.y) for r in pairs.collect()} == {(1, 7), (2, 7)}
    assert joins.unique_links(pairs, "x", "y").count() == 0


def test_as_of_and_names(spark):
    a = spark.createDataFrame([(1, ts(5)), (1, ts(10)), (2, ts(0))], "k int, at timestamp")
    b = spark.createDataFrame([(1, ts(10), None), (1, ts(6), "p"), (2, ts(1), "q")], "k int, bt timestamp, v string")
    got = {(r.k, r.at): r.v for r in joins.as_of(a, b, "k", "at", "bt", ["v"]).collect()}
    assert got == {(1, ts(5)): None, (1, ts(10)): None, (2, ts(0)): None}
    n = spark.createDataFrame([("Son Heung-min", "Heung-min Son"), ("Kim Min", "K. Min"), ("A B", "C B"), ("A B", "A C")], "a string, b string")
    assert [r.m for r in n.select(joins.name_match(F.col("a"), F.col("b")).alias("m")).collect()] == ["full", "initial", None, None]


def test_upsert_and_content(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "id int, v string")
    got = {r.id: (r.v, r.change) for r in select.upsert(old, new, "id", ["v"]).collect()}
    assert got == {1: ("a", "kept"), 2: ("B", "replaced"), 3: (None, "same"), 4: ("d", "added")}
    assert select.same_content(old, old.orderBy(F.desc("id")), ["id", "v"]) and not select.same_content(old, new, ["id", "v"])


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, False), ("b", None, True), ("b", 2, True), ("c", 5, False)], "k string, v int, ok boolean")
    got = {r.k: r.s for r in df.groupBy("k").agg(aggregate.poisoned_sum(F.col("v"), F.col("ok")).alias("s")).collect()}
    assert got == {"a": 1, "b": None, "c": 0}


def test_importance_edges(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 2.0), (4, 1.3), (5, 1.29)], "rank int, score double")
    got = [r.i for r in df.select("rank", keywords.importance(F.col("score"), F.col("rank"), F.lit(False)).alias("i")).orderBy("rank").collect()]
    assert got == [5, 4, 3, 2, 1]


def plain_clusters(n, pairs, bond, anchors):
    """The greedy over all documents at once, as one list of pairs."""
    table = {(a, b): (s, f) for a, b, s, f, _ in pairs}
    groups, held = {i: [i] for i in range(n)}, dict(anchors)
    of = list(range(n))
    for a, b, _, _, linked in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        x, y = of[a], of[b]
        if not linked or x == y or (held.get(x) and held.get(y) and held[x] != held[y]):
            continue
        if all((min(i, j), max(i, j)) in table and table[min(i, j), max(i, j)][0] >= table[min(i, j), max(i, j)][1] * bond for i, j in itertools.product(groups[x], groups[y])):
            for j in groups.pop(y):
                of[j] = x
                groups[x].append(j)
            held[x] = held.get(x) or held.get(y)
    return {i: min(groups[of[i]]) for i in range(n)}


def test_clusters_per_component_equal_the_whole(spark):
    rng = random.Random(4)
    names = ["Arsenal", "Chelsea", "Madrid", "Bayern", "Napoli"]
    titles = [f"{rng.choice(names)} {rng.choice(['beat', 'sign', 'sack'])} {rng.choice(names)} {rng.choice(['Smith', 'Jones', 'Kovac'])} {rng.choice(['deal', 'fee', 'coach'])}" for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "en", "es"]), ts(rng.randint(0, 3000)), rng.choice(["p", "q", None]), rng.choice([None] * 9 + ["x", "y"])) for i, t in enumerate(titles)]
    docs = spark.createDataFrame(rows, "id int, title string, lang string, at timestamp, publisher string, anchor string")
    policy = cluster.Policy(together=1 / 3600)
    pairs = [tuple(r) for r in cluster.scored_pairs(docs, policy).select("a", "b", "sim", "floor", "linked").collect()]
    want = plain_clusters(60, pairs, policy.bond, {r[0]: r[5] for r in rows if r[5]})
    got = {r.id: r.cluster for r in cluster.clusters(docs, policy).collect()}
    assert got == want and len(set(got.values())) < 60


def test_copies_of_a_title_are_one_story(spark):
    rows = [(i, "Arsenal sign Smith deal now", "en", ts(i % 50), "p", None) for i in range(200)] + [(300, "Arsenal sign Smith deal now", "en", ts(55), "q", None), (301, "Nothing of the kind here", "en", ts(55), "q", None)]
    docs = spark.createDataFrame(rows, "id int, title string, lang string, at timestamp, publisher string, anchor string")
    assert cluster.scored_pairs(docs).count() == 1
    got = {r.id: r.cluster for r in cluster.clusters(docs).collect()}
    assert got == {i: 0 for i in range(200)} | {300: 0, 301: 301}
    assert cluster.clusters(docs.limit(0)).count() == 0


def test_title_features(spark):
    rows = [
        ("Man Utd 2-1 Chelseas [PL] win", "en"), ("손흥민 골", "ko"), (None, "en"), ("", "en"), ("[UCL REVIEW] 맨시티, PSG에 2-4로 참패", "ko"), ("2026-27 season: 10-man Spurs, U-21 side, 8.4초 1/10", "en"),
        ("Ｒeal Madrid 4–3 Ro\u0301ma, Ana María López win Win Madrid", None), ("PSG LAFC 손흥민", "ko"), ("NEW York: Red Bulls 韓 班 99 2026 x", "en"), ("pass Pass Press cross", "en"),
    ]
    df = spark.createDataFrame(rows, "t string, l string")
    korean = F.coalesce(F.col("l") == "ko", F.lit(False))
    got = [{x.feature: round(x.w, 12) for x in r.f or []} for r in df.select(cluster.title_features(F.col("t"), korean, ("win",), {"utd": "united"}).alias("f")).collect()]
    half, third = round(2**-0.5, 12), round(3**-0.5, 12)
    assert got[0] == {"score:1-2": 1, "man": half, "united": half, "chelse": 1}
    assert got[1] == {"손흥": 1, "흥민": 1} and got[2] == got[3] == {}
    assert got[4] == {"맨시": 1, "시티": 1, "psg": 1, "score:2-4": 1, "참패": 1}
    assert got[5] == {"2026": 1, "season": 1, "man": 1, "spur": 1, "side": 1}
    assert got[6] == {"real": half, "madrid": 1, "score:3-4": 1, "roma": 1, "ana": third, "maria": third, "lopez": third}
    assert got[7] == {"psg": 1, "lafc": 1, "손흥": 1, "흥민": 1}
    assert got[8] == {"new": half, "york": half, "red": half, "bull": half, "2026": 1}
    assert got[9] == {"pass": 1, "press": half, "cross": 1}


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in checks.duplicates("d", df, "k").collect()] == [("d", "a", 2)]
    assert checks.out_of_order(df.withColumn("p", F.monotonically_increasing_id()), [], "p", "v").count() == 1
    checks.gate(spark.createDataFrame([("r", "k", "warn")], "rule string, key string, severity string"))


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, t int, e string, at timestamp, source string")
    assert windows.trailing(df, "k", ["t"], F.col("e") == "c", F.col("e") == "s", "t").count() == 0
    assert select.dedup(df, "k", "t", "source").count() == 0
    assert windows.with_quota(df, ["k"], F.col("e") == "c", [F.col("t")], 3, 1).count() == 0
    assert joins.within(df, df.withColumnRenamed("at", "bt").select("k", "bt"), ["k"], "at", "bt", 10).count() == 0


def test_anchored_windows_of_long_runs(spark, monkeypatch):
    """Runs over the limit are chained by doubling; one busy key, a null key, equal times."""
    monkeypatch.setattr(folds, "LONG", 3)
    rng = random.Random(8)
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(k, i, t0 + datetime.timedelta(minutes=rng.randrange(60 * 24 * (20 if k == 1 else 3)))) for i in range(500) for k in ([1, 1, 1, 2, None][i % 5],)] + [(1, 900, None)]
    got = {(r.k, r.i): r.anchor for r in folds.anchored_windows(spark.createDataFrame(rows, "k int, i int, at timestamp"), "k", ["i"], "at", 3600 * 3).collect()}
    want = {}
    for k in (1, 2, None):
        anchor = None
        for t, i in sorted((t, i) for q, i, t in rows if q == k and t):
            if anchor is None or t - anchor > datetime.timedelta(hours=3):
                anchor = t
            want[k, i] = anchor
    assert got == want


def test_anchored_and_speech(spark):
    patterns = [("official", f"{keywords.ANCHOR} signs"), ("rumour", f"linked with {keywords.ANCHOR}")]
    rows = [("Ann signs; club linked with Ann", "Ann"), ("Anna signs", "Ann"), ("ann signs", "Ann"), (r"A\Eb (x) SIGNS", r"A\Eb (x)"), (None, "Ann"), ("Ann signs", None), ("", "")]
    df = spark.createDataFrame(rows, "t string, n string")
    got = [[tuple(x) for x in r.x] for r in df.select(keywords.anchored(F.col("t"), F.col("n"), patterns).alias("x")).collect()]
    assert got == [[("official", "Ann signs"), ("rumour", "linked with Ann")], [], [], [("official", r"A\Eb (x) SIGNS")], [], [], []]
    said = spark.createDataFrame([('Ann: "we go on"',), ('Ann said, “we go on”',), ('"We go on," says Ann',), ('Ann: "yes"',), (None,)], "t string")
    assert [r.f for r in said.select(keywords.speech(F.col("t"), F.lit("Ann"), ("said", "says")).alias("f")).collect()] == ["colon", "before", "after", None, None]


def test_title_claims_reasons(spark):
    rows = spark.createDataFrame([(i, "Ann signs") for i in range(6)] + [(6, None)], "id int, title string")
    names = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (2, "Bob"), (3, "Cid"), (4, "Ann"), (5, "Ann"), (6, "Ann")], "id int, player string")
    clubs = spark.createDataFrame([(1, "X", "from"), (1, "Y", "to"), (4, "X", "to"), (4, "Y", "to"), (5, "X", "from"), (5, "X", "to")], "id int, club string, role string")
    got = {r.id: (r.player, r["from"], r.to, r.status, r.reason) for r in cards.title_claims(rows, names, clubs, [("official", f"{keywords.ANCHOR} signs")]).collect()}
    none = (None,) * 4
    assert got == {0: (*none, "no-player"), 1: ("Ann", "X", "Y", "official", None), 2: (*none, "many-players"), 3: (*none, "no-stage"), 4: (*none, "many-clubs"), 5: (*none, "same-club"), 6: (*none, "no-stage")}


def test_fact_mismatches_and_templates(spark):
    claims = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, None, "b"), (None, 1, "n"), (9, 1, "a")], "k int, v int, w string")
    facts = spark.createDataFrame([(1, 5, "a"), (None, 2, None), (2, 2, "c")], "k int, v int, w string")
    got = sorted((str(r.k), r.mismatches) for r in checks.fact_mismatches(claims, facts, ["k"], ["v", "w"]).collect())
    assert got == [("1", []), ("1", []), ("1", ["w"]), ("9", ["unknown"]), ("None", ["v", "w"])]
    assert checks.fact_mismatches(claims.limit(0), facts, ["k"], ["v"]).count() == 0
    lines = claims.select(text.fill_template(F.lit("x"), {"x": "{v} of {w}"}, {"v": F.col("v"), "w": F.concat(F.lit("{v}"), "w")}).alias("l")).collect()
    assert [r.l for r in lines] == ["5 of {v}a", "5 of {v}a", None, "1 of {v}n", "1 of {v}a"]


def test_cluster_plan_with_nulls(spark):
    rows = [(1, "a", 7, None), (2, "a", 5, True), (3, "a", None, None), (4, "a", None, True), (5, "b", None, True), (6, "b", None, False), (7, "c", None, None), (8, None, None, True), (9, None, None, None), (10, None, 3, None)]
    got = cluster.cluster_plan(spark.createDataFrame(rows, "i int, c string, card int, seen boolean"), "c", "card", "seen")
    assert {r.i: (r.plan, r.card_id) for r in got.collect()} == {
        1: ("existing", 5), 2: ("existing", 5), 3: ("addition", 5), 4: ("existing", 5), 5: ("suppressed", None),
        6: ("suppressed", None), 7: ("fresh", None), 8: ("suppressed", None), 9: ("fresh", None), 10: ("existing", 3),
    }


def test_rerun_changes_nothing(spark):
    kind = "id string, lead string, sources array<string>"
    old = spark.createDataFrame([("x", "p", ["s", "t"]), ("y", "q", None), (None, "n", ["u"])], kind)
    new = spark.createDataFrame([("x", "other", ["t", "v", "v"]), ("z", "r", ["w"]), ("y", "o", ["k"])], kind)
    once = cards.rerun(old, new, "id", "sources")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(once) == rows(spark.createDataFrame([("x", "p", ["s", "t", "v"]), ("y", "q", ["k"]), ("z", "r", ["w"]), (None, "n", ["u"])], kind))
    assert rows(cards.rerun(once, new, "id", "sources")) == rows(once)


def test_gate_and_run_decision(spark):
    rows = spark.createDataFrame([(1, "d1", True), (2, "d1", None), (3, "d2", False)], "k int, day string, bad boolean")
    issues = checks.row_issues(rows, "k", [("bad", "error", F.col("bad")), ("day", "warning", F.col("day") == "d1")])
    assert sorted((r.rule, r.severity, r.key) for r in issues.collect()) == [("bad", "error", "1"), ("day", "warning", "1"), ("day", "warning", "2")]
    assert [(r.key, r.n) for r in checks.too_few("floor", rows, ["day"], F.lit(2)).collect()] == [("d2", 1)]
    checks.gate(issues.where("severity = 'warning'"))
    with pytest.raises(ValueError, match="bad: 1"):
        checks.gate(issues)
    runs = [("a", "09:00", "d", False), ("b", "09:00", "d", True), ("b", None, "d", True), ("c", "09:00", "d", True), ("c", "10:00", "d", None), ("e", "09:00", "before", True), ("f", None, None, None)]
    df = spark.createDataFrame(runs, "k string, at string, day string, waits boolean").withColumns({"at": F.to_timestamp(F.concat(F.lit("2026-03-02 "), "at")), "now": F.lit("2026-03-02 21:00:00").cast("timestamp"), "today": F.lit("d")})
    said = lambda hours: {r.k: r.decision for r in checks.run_decision(df, "k", "at", "day", "today", "now", hours, "waits").collect()}
    assert said(12) == {"a": "skip", "b": "retry", "c": "skip", "e": "run", "f": "run"}
    assert said(11) == {"a": "run", "b": "run", "c": "retry", "e": "run", "f": "run"}


@pytest.mark.parametrize("most", [1 << 18, 20, 2])
def test_components_of_any_size_are_merged_alike(spark, monkeypatch, most):
    """In a task each, level by level, and in rounds."""
    rng, n = random.Random(most), 15 if most > 2 else 8
    pairs = [(i, j, rng.choice([1.0, 1.0, 0.9, 0.7, rng.random()]), 0.5, rng.random() < 0.7) for i in range(n) for j in range(i + 1, n) if i // 5 == j // 5 or rng.random() < 0.2]
    anchors = {i: rng.choice("xy") for i in range(0, n, 4)}
    monkeypatch.setattr(cluster, "TASK_PAIRS", most)
    monkeypatch.setattr(cluster, "LEVELS", (1.0, 0.7))
    made = cluster.complete_link(spark.createDataFrame(pairs, "a int, b int, sim double, floor double, linked boolean"), spark.createDataFrame(list(anchors.items()), "id int, anchor string"), 0.6)
    got = {i: i for i in range(n)} | {r.id: r.cluster for r in made.collect()}
    assert got == plain_clusters(n, pairs, 0.6, anchors) and len(set(got.values())) < n


def test_one_story_of_many_publishers_needs_no_rounds(spark, monkeypatch):
    """Equally similar pairs are merged one after another, so a round merged one; and tables of rounds stayed on disk."""
    written = []
    monkeypatch.setattr(cluster, "materialise", lambda df, name, make=cluster.materialise: written.append(make(df, name)) or written[-1])
    pairs = [(i, j, 1.0, 0.45, True) for i in range(12) for j in range(i + 1, 12)]
    made = cluster.complete_link(spark.createDataFrame(pairs, "a long, b long, sim double, floor double, linked boolean"), spark.createDataFrame([], "id long, anchor string"), 0.6)
    assert {(r.id, r.cluster) for r in made.collect()} == {(i, 0) for i in range(12)}
    left = [t for t in written if os.path.exists(t.scratch_path.removeprefix("file://"))]
    assert len(written) < 12 and len(left) <= 3
