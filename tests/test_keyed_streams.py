import datetime
import glob
import os

from pyspark.sql import functions as F

from tidemill.streaming import keyed

T0 = datetime.datetime(2026, 1, 1)


def hours(h):
    return T0 + datetime.timedelta(hours=h)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_first_seen_expires_by_timer_and_survives_a_restart(spark, tmp_path):
    schema, parts = "k long, at timestamp", [[(1, hours(0)), (2, hours(1)), (1, hours(5)), (9, None)], [(3, hours(100)), (2, hours(99))], [(2, hours(102)), (4, hours(101))]]
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sizes = []
    for part in parts:  # each run is a restart from the checkpoint of the one before
        put(spark, source, part, schema)
        changes = keyed.first_seen(stream(), "k", "at", 3, root=root)
        sizes.append(changes.count())
    got = {r.k: (r["first"], r.newest, r.state) for r in keyed.latest(changes, ["k"]).collect()}
    assert got == {1: (hours(0), hours(5), "expired"), 2: (hours(99), hours(102), "again"), 3: (hours(100), hours(100), "new"), 4: (hours(101), hours(101), "new")}
    # what a run appends are the keys that changed: 1 and 2; 3 and 2 with what expired; 2 and 4
    assert sizes[0] == 2 and sizes[1] - sizes[0] <= 4 and sizes[2] - sizes[1] == 2
    again = keyed.first_seen(stream(), "k", "at", 3, root=root)
    assert again.count() == sizes[2]
    whole = keyed.first_seen(stream(), "k", "at", 3, root=str(tmp_path / "whole"))  # the same files in one run
    assert sorted((r.k, r.newest, r.state) for r in keyed.latest(whole, ["k"]).collect()) == sorted((k, v[1], v[2]) for k, v in got.items())
    assert glob.glob(os.path.join(root, "checkpoint", "state", "0", "*", "**", "*.zip"), recursive=True)  # RocksDB snapshots or change logs, in the checkpoint


def test_retries(spark, tmp_path):
    schema = "k string, at timestamp, ok boolean"
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    put(spark, source, [("a", hours(0), False), ("b", hours(0), False), ("b", hours(1), False), ("c", hours(0), True), ("d", hours(0), None), ("e", hours(0), False)], schema)
    first = keyed.latest(keyed.retries(stream(), "k", "at", "ok", 2, 2, root=root), ["k"])
    assert {r.k: (r.tries, r.state) for r in first.collect()} == {"a": (1, "pending"), "b": (2, "pending"), "e": (1, "pending")}
    put(spark, source, [("a", hours(2), True), ("b", hours(2), False), ("z", hours(90), False)], schema)
    second = keyed.latest(keyed.retries(stream(), "k", "at", "ok", 2, 2, root=root), ["k"])
    assert {r.k: (r.tries, r.state) for r in second.collect()} == {"a": (1, "done"), "b": (3, "dropped"), "e": (1, "expired"), "z": (1, "pending")}
    assert second.where(F.col("version") < 1).isEmpty()
