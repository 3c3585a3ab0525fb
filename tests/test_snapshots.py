import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.sources.snapshots import Conflict, Snapshots, compact

SCHEMA = "part string, id long, day date, v string"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def rows(spark, triples):
    return spark.createDataFrame([(d.isoformat() if d else "none", i, d, v) for i, d, v in triples], SCHEMA)


def content(t, version=None):
    return sorted((r.part, r.id, r.v) for r in t.read(version).collect())


class Stop(Exception):
    pass


def stop_at(name):
    def step(at):
        if at == name:
            raise Stop(at)

    return step


def test_versions_unchanged_partitions_and_conflicts(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.read().count() == 0 and t.commit(rows(spark, [])) is None
    first = rows(spark, [(1, day(0), "a"), (2, day(0), "b"), (2, day(0), "b"), (3, day(1), "c=d/é"), (4, None, None)])
    assert t.commit(first) == 1
    assert t.commit(first.orderBy(F.desc("id"))) is None  # same rows in another order
    folder = t.parts()["2024-01-01"]["folder"]
    assert t.commit(rows(spark, [(1, day(0), "a"), (2, day(0), "b"), (2, day(0), "b"), (3, day(1), "new")])) == 2
    assert t.parts()["2024-01-01"]["folder"] == folder and len(content(t)) == 5
    assert ("2024-01-02", 3, "c=d/é") in content(t, 1) and ("2024-01-02", 3, "new") in content(t)
    with pytest.raises(Conflict):
        t.commit(rows(spark, [(9, day(5), "x")]), base=1)
    assert t.versions() == [1, 2]
    assert t.commit(rows(spark, []), drop=["none"]) == 3 and "none" not in t.parts()
    t.vacuum(1)
    assert t.versions() == [3] and len(content(t)) == 4


@pytest.mark.parametrize("at", ["write", "list", "commit"])
def test_a_crash_between_steps_leaves_the_old_table(spark, tmp_path, at):
    t = Snapshots(spark, f"file://{tmp_path}/t", SCHEMA)
    t.commit(rows(spark, [(n, day(n), "a") for n in range(0, 60, 4)]))
    before = content(t)
    with pytest.raises(Stop):
        compact(t, "id", "day", "yyyy-MM", F.lit(datetime.date(2024, 6, 1)), 90, stop_at(at))
    again = Snapshots(spark, f"file://{tmp_path}/t", SCHEMA)
    assert content(again) == before and again.versions() == [1]
    version, _ = compact(again, "id", "day", "yyyy-MM", F.lit(datetime.date(2024, 6, 1)), 90)
    assert version == 2 and sorted(again.parts()) == ["2024-01", "2024-02"]
    assert sorted(x[1:] for x in content(again)) == sorted(x[1:] for x in before)
    again.vacuum(1)
    assert sorted(x[1:] for x in content(again)) == sorted(x[1:] for x in before)


def test_compaction_refuses_conflicts_and_keeps_what_is_not_due(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", SCHEMA)
    t.commit(rows(spark, [(1, day(0), "a"), (1, day(3), "a"), (2, day(40), "x"), (2, day(41), "y"), (3, day(100), "z"), (4, None, "n")]).unionByName(rows(spark, [(1, day(0), "a")]).withColumn("part", F.lit("copy"))))
    version, conflicts = compact(t, "id", "day", "yyyy-MM", F.lit(day(140)), 90)
    # January: id 1 has two days, so two contents; February: id 2 too; nothing is merged
    assert version is None and {r.period: r["keys"] for r in conflicts.collect()} == {"2024-01": 1}
    t = Snapshots(spark, f"file://{tmp_path}/u", SCHEMA)
    t.commit(rows(spark, [(1, day(0), "a"), (5, day(3), "a"), (2, day(40), "x"), (3, day(100), "z"), (4, None, "n")]).unionByName(rows(spark, [(1, day(0), "a")]).withColumn("part", F.lit("copy"))))
    version, conflicts = compact(t, "id", "day", "yyyy-MM", F.lit(day(140)), 90)
    assert version == 2 and conflicts.isEmpty() and sorted(t.parts()) == ["2024-01", day(40).isoformat(), day(100).isoformat(), "none"]
    assert [x for x in content(t) if x[0] == "2024-01"] == [("2024-01", 1, "a"), ("2024-01", 5, "a")]
