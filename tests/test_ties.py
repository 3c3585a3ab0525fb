"""Equal intervals, and texts at one time."""

import datetime

from tidemill.operators import cards, observations, windows
from tidemill.plans import catalog

START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_equal_intervals_are_one_row_before_any_window(spark):
    day = lambda d: datetime.date(2026, 1, d)
    rows = [(1, day(1), day(3))] * 5 + [(1, day(4), day(6))] * 2 + [(1, day(9), day(9)), (None, day(1), None)]
    out = windows.merge_intervals(spark.createDataFrame(rows, "k int, a date, b date"), "k", "a", "b")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, day(1), day(6), 7), (1, day(9), day(9), 1), (None, day(1), None, 1)]
    # two windows over rows of equal start and end may put them in two orders
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.index("Aggregate [k", plan.rindex("Window")) and "count(1) AS _n" in plan


def test_last_fact_at_one_time_is_the_least(spark):
    texts = ["b", "d", "a", "c"]
    wanted = [observations.Fact("first", "([a-z])", "first"), observations.Fact("last", "([a-z])", "last")]
    for order in (texts, texts[::-1], sorted(texts)):
        lines = spark.createDataFrame([(1, at(5), t) for t in order] + [(1, at(1), "z"), (1, None, "y")], "run int, at timestamp, text string").coalesce(1)
        assert [(r.first, r.last) for r in observations.facts(lines.where("at IS NOT NULL"), "run", "at", "text", wanted).collect()] == [("z", "a")]
        assert [r.last for r in observations.facts(lines, "run", "at", "text", wanted).collect()] == ["a"]


def test_keys_at_one_place_go_by_the_least(spark):
    own = spark.createDataFrame([(1, 10, False), (2, 20, False), (3, 30, False)], "ord long, id long, existing boolean")
    for order in (1, -1):
        rows = [(1, 1, 8), (2, 1, 7), (3, 1, 8), (3, 1, 7)][::order]
        keys = spark.createDataFrame(rows, "ord long, pos int, key long").coalesce(1)
        assert sorted((r.ord, r.owner) for r in cards.merge_in_order(own, keys).collect()) == [(1, 1), (2, 2), (3, 2)]


def test_every_line_of_an_order_is_a_key(spark, tmp_path):
    spark.createDataFrame([(1001, 1), (1002, 2), (1003, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1001, 1, 5, 50.0), (1002, 1, 5, 3.0), (1003, 1, 6, 1.0), (1002, 2, 6, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["ordered_card_merge"](spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.owner, r.action) for r in rows) == [(1001, 1001, "added"), (1002, 1001, "attached"), (1003, 1001, "attached")]
