import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources import readers, sinks
from tidemill.streaming import state

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def test_json_modes(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for d, lines in ((good, ['{"id":1,"name":"a"}']), (bad, ['{"id":1,"name":"a"}', '{"id":"x"'])):
        d.mkdir()
        (d / "x.json").write_text("\n".join(lines))
    assert readers.read_json(spark, str(good), SCHEMA).count() == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_json(spark, str(bad), SCHEMA).collect()
    rows, broken = readers.read_json_parts(spark, str(bad), SCHEMA)
    assert [r.id for r in rows.collect()] == [1]
    assert [r._corrupt_record for r in broken.collect()] == ['{"id":"x"']


def test_registry():
    r = readers.Registry([("news/*.json", SCHEMA), ("*", T.StructType())])
    assert r.find("news/a.json") is SCHEMA and r.find("other") == T.StructType()
    assert readers.Registry([("runs.json", SCHEMA)]).suggest("run.json") == "runs.json"
    assert readers.Registry([("runs.json", SCHEMA)]).suggest("something") is None


def test_feed_items(spark):
    xml = "<item><title>A &amp; B</title><link>http://x</link><pubDate>2026-11-03 10:15:00</pubDate><author>p</author><author>q</author></item>"
    r = readers.feed_items(spark.createDataFrame([(1, xml)], "i int, xml string"), "xml", F.lit("Asia/Seoul")).first()
    assert (r.title, r.link, r.published, r.author) == ("A & B", "http://x", datetime.datetime(2026, 11, 3, 1, 15), ["p", "q"])


def test_search_plan(spark):
    rows = [("s", 1, True, True, False), ("s", 2, False, True, False), ("s", 3, True, True, False), ("s", 4, True, True, False), ("t", 5, True, False, False), ("u", 6, True, True, True)]
    out = readers.paged_search(spark.createDataFrame(rows, "source string, ord int, enabled boolean, known boolean, blocked boolean"), 2)
    assert [r.plan for r in out.orderBy("ord").collect()] == ["run", "disabled", "run", "over cap", "source missing", "source blocked"]


def test_suggest_finds_all_near_names(spark):
    names = ["alpha", "alpine", "beta", "betas", "gamma", "g", "ga", "delta"]
    known = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.distance for r in readers.suggest(known, "n", known, "n", 3).collect()}
    want = {}
    for a in names:
        near = [readers.edit_distance(a, b) for b in names if a != b and len(a) > 3]
        if near and min(near) <= 3:
            want[a] = min(near)
    assert {k: v for k, v in got.items() if len(k) > 3} == want
    short = ["a", "bc", "cb", "xyz", "abcd", "q", "longer name"]
    known = spark.createDataFrame([(n,) for n in [*short, ""]], "n string")
    got = {r.n: (r.distance, r.nearest) for r in readers.suggest(known, "n", known, "n", 3).collect()}
    for a in short:
        near = min(((readers.edit_distance(a, b), b) for b in short if a != b), default=None)
        assert got.get(a) == (near if near[0] <= 3 else None), a


def test_partitions_and_no_op_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, m string")
    path = str(tmp_path / "t")
    sinks.write_partitions(df, path, "m")
    sinks.write_partitions(spark.createDataFrame([(9, "b")], "id int, m string"), path, "m")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "m").collect()) == [(1, "a"), (9, "b")]
    other = str(tmp_path / "u")
    assert sinks.write_if_changed(df, other, ["id", "m"]) and not sinks.write_if_changed(df.orderBy(F.desc("id")), other, ["id", "m"])


def test_documents(spark):
    df = spark.createDataFrame([(1, "a; b, c", datetime.datetime(2026, 1, 2, 3, 4))], "id int, s string, at timestamp")
    event = sinks.calendar_event(df, "id", "s", "at").first().event
    assert "DTSTART:20260102T030400Z" in event and r"SUMMARY:a\; b\, c" in event
    assert sinks.feed_xml(df, "s", "s", "at").first().item.startswith("<item><title>a; b, c</title>")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)) for k, h in [(1, 0), (2, 1), (1, 30), (3, 100), (2, 100), (4, 2)]]
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "k int, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("k int, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.k: r["first"] for r in state.first_seen_stream(stream, "k", "at", 3).collect()}
    assert got == {1: rows[0][1], 2: rows[4][1], 3: rows[3][1]}  # 2 had expired when it came back
    root = str(tmp_path / "_state")
    one = state.first_seen_stream(stream.where("k = 1"), "k", "at", 3, root).collect()
    more = datetime.datetime(2025, 12, 31)
    spark.createDataFrame([(1, more)], "k int, at timestamp").write.mode("append").parquet(str(tmp_path))
    two = state.first_seen_stream(stream.where("k = 1"), "k", "at", 3, root).collect()
    assert one[0]["first"] == rows[0][1] and two[0]["first"] == more
    starts = spark.createDataFrame([(k, datetime.datetime(2026, 1, 2)) for k in (1, 2, 3, 4)], "k int, start timestamp")
    counts = {(r.k, r.verdict): r.n for r in state.verdict_stream(stream, starts, "k", "at", F.lit(datetime.datetime(2026, 1, 3))).collect()}
    assert counts == {(1, "out"): 2, (1, "in"): 1, (2, "out"): 1, (2, "future"): 1, (3, "future"): 1, (4, "out"): 1}


def test_pending(spark):
    p = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "id int, retries int")
    t = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    left, dropped = state.pending_retries(p, t, 2)
    assert sorted(tuple(r) for r in left.collect()) == [(3, 1)] and [r.id for r in dropped.collect()] == [2]
