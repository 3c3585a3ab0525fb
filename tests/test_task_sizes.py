"""What one task gets does not grow with the table."""

from pyspark.sql import functions as F

from tidemill.operators import audit, lineups
from tidemill.sources import snapshots


def test_unique_values_are_counted_in_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "TASK_ROWS", 10)
    rows = spark.range(200).selectExpr("id % 190 AS k", "CASE WHEN id % 50 <> 7 THEN 1 END AS v")
    out = audit.audit({"t": rows}, {}, [audit.Unique("u", "t", ("k", "v"))])
    assert sorted(map(tuple, out.collect())) == sorted(("u", "error", f"{k}:1", 2) for k in range(10) if k != 7)
    assert "RepartitionByExpression [k" in out._jdf.queryExecution().optimizedPlan().toString() and ", 20" in out._jdf.queryExecution().optimizedPlan().toString()


def test_players_are_swept_in_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(lineups, "TASK_ROWS", 10)
    listed = spark.range(100).selectExpr("id AS match", "'home' AS side", "id AS player", "'n' AS name", "true AS start")
    changes = spark.createDataFrame([(1, 0, "home", 60, 0, "out", 1)], "match long, ord int, side string, minute int, extra int, kind string, player long")
    out = lineups.minutes(listed, changes, spark.range(99).selectExpr("id AS match", "90 AS minute"))
    assert {(r.match, r.minutes, *r.problems) for r in out.collect()} == {(i, 60 if i == 1 else 90) for i in range(99)} | {(99, None, "no-end")}
    assert "RepartitionByExpression [match" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", 11" in plan


def test_a_large_partition_is_compared_and_written_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(snapshots, "TASK_ROWS", 10)
    t = snapshots.Snapshots(spark, f"file://{tmp_path}/t", "part string, id long, day date")
    rows = spark.range(200).selectExpr("date_format(date'2020-01-01' + cast(id % 60 as int), 'yyyy-MM') AS part", "id", "date'2020-01-01' + cast(id % 60 as int) AS day")
    t.commit(rows)
    _, conflicts = snapshots.compact(t, "id", "day", "yyyy", F.lit("2022-01-01").cast("date"), 90)
    got = t.read()
    assert conflicts.isEmpty() and sorted(r.id for r in got.collect()) == list(range(200)) and {r.part for r in got.collect()} == {"2020"}
    assert len(got.inputFiles()) > 8
