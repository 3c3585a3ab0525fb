"""A record for each day from runs and their log lines: lines find their run by time, a table of patterns says what they tell."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.joins import as_of


@dataclass(frozen=True)
class Fact:
    """What a pattern's first group tells of a run: the ``sum`` or ``max`` of its numbers, ``count`` of lines that match, ``first`` or ``last`` text by time."""

    name: str
    pattern: str
    take: str = "last"


def stitched(lines: DataFrame, runs: DataFrame, key: str, at: str, started: str, ended: str, run: str) -> DataFrame:
    """``lines`` with ``run``: the last run of their ``key`` that had begun and, if it has an end, had not ended; null without one.

    The join cuts time into ranges, so one key of all rows is spread over tasks.
    """
    found = as_of(lines, runs.withColumn("_ended", F.col(ended)), key, at, started, [run, "_ended"])
    return found.withColumn(run, F.when(F.col("_ended").isNull() | (F.col(at) <= F.col("_ended")), F.col(run))).drop("_ended")


def facts(lines: DataFrame, run: str, at: str, text: str, wanted: Sequence[Fact]) -> DataFrame:
    """(run, one column for each fact): what the lines of each run tell; null where no line matches, 0 for counts.  Lines without a run tell nothing; of texts at the same time the least counts."""
    back = -(F.unix_micros(F.col(at).cast("timestamp")) if dict(lines.dtypes)[at].startswith(("timestamp", "date")) else F.col(at))

    def told(f: Fact) -> Column:
        hit, group = F.col(text).rlike(f.pattern), F.regexp_extract(text, f.pattern, 1) if "(" in f.pattern else F.lit("")
        if f.take == "count":
            return F.count_if(F.coalesce(hit, F.lit(False)))
        if f.take in ("sum", "max"):
            return (F.sum if f.take == "sum" else F.max)(F.when(hit, group.try_cast("decimal(38,6)").cast("double")))
        # of texts at the same time the least, for the last as for the first
        return F.min_by(F.when(hit, group), F.when(hit, F.struct(at, group) if f.take == "first" else F.struct(F.col(at).isNull(), back, group)))

    return lines.where(F.col(run).isNotNull()).groupBy(run).agg(*[told(f).alias(f.name) for f in wanted], F.count("*").alias("lines"))


def day_records(runs: DataFrame, told: DataFrame, run: str, job: str, started: str, ok: str, sums: Sequence[str], first: Column, last: Column) -> DataFrame:
    """A row for each day from ``first`` to ``last``: runs, jobs, failed (``ok`` false or null), silent (runs without a line), the ``sums`` of facts, and state: ``missing`` without a run, ``bad`` if all failed, else ``good``."""
    rows = runs.select(run, job, ok, F.to_date(started).alias("day")).join(told, run, "left")
    days = rows.groupBy("day").agg(
        F.count("*").alias("runs"), F.count_distinct(job).alias("jobs"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"), F.count_if(F.col("lines").isNull()).alias("silent"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )
    spine = runs.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    counts = ["runs", "jobs", "failed", "silent", *sums]
    out = spine.join(days, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.withColumn("state", F.when(F.col("runs") == 0, "missing").when(F.col("failed") == F.col("runs"), "bad").otherwise("good"))
