"""Constraints and verdicts as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason``: the first rule that holds, null for good rows."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return rows.withColumn("reason", out)


def duplicates(rule: str, rows: DataFrame, key: str) -> DataFrame:
    """(rule, key, n) for keys that occur more than once."""
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")


def at_least(rule: str, rows: DataFrame, key: str, least: int) -> DataFrame:
    """(rule, key, n) if there are fewer rows than ``least``."""
    return rows.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(rule).alias("rule"), F.lit(key).alias("key"), "n")


def too_few(rule: str, rows: DataFrame, keys: Sequence[str], floor: Column) -> DataFrame:
    """(rule, severity, key, n) for keys with fewer rows than their ``floor`` (an expression over ``keys``); a key without rows is in no table, see :func:`at_least`."""
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < floor).select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), key.alias("key"), "n")


def row_issues(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(rule, severity, key, n = 1) for every one of ``rules`` (rule, severity, condition) that holds of a row, in one pass; a null condition does not hold."""
    found = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, bad in rules])
    issues = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return issues.select("i.rule", "i.severity", "key", F.lit(1).cast("long").alias("n"))


def run_decision(runs: DataFrame, key: str, done_at: str, day: str, today: str, now: str, hours: int = 12, pending: str | None = None) -> DataFrame:
    """(key, decision, recent): whether to run again, from the successful ``runs`` of a key.

    A success of the same publish day in the last ``hours`` is a reason to skip; successes of other days do not count.
    Where ``pending`` (results of that day are still missing) holds and there was exactly one such success, the run is
    tried once more.  Nulls in ``done_at`` or ``day`` are no success.
    """
    same = F.coalesce((F.col(day) == F.col(today)) & (F.col(done_at) <= F.col(now)) & (F.unix_micros(done_at) >= F.unix_micros(now) - hours * 3_600_000_000), F.lit(False))
    waits = F.bool_or(F.coalesce(F.col(pending), F.lit(False))) if pending else F.lit(False)
    seen = runs.groupBy(key).agg(F.count_if(same).alias("n"), F.max(F.when(same, F.col(done_at))).alias("recent"), waits.alias("_waits"))
    said = F.when(F.col("n") == 0, "run").when(F.col("_waits") & (F.col("n") == 1), "retry").otherwise("skip")
    return seen.select(key, said.alias("decision"), "recent")


def conflicts(rows: DataFrame, key: str, setting: str) -> DataFrame:
    """Keys with more than one setting; no setting is a setting of its own."""
    return rows.groupBy(key).agg(F.count_distinct(F.coalesce(setting, F.lit(-1))).alias("settings")).where("settings > 1")


def out_of_order(rows: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Rows whose value is not above that of the row before."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("before", before).where(F.col(value) <= F.col("before"))


def fact_mismatches(claims: DataFrame, facts: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``claims`` (keys and fields) with ``mismatches``: the fields that differ from the facts, in order, or ``unknown`` where no fact has the keys.

    A claim's null field says nothing and is never a mismatch; null keys are keys like any other.  ``facts`` has
    one row per key (see :func:`duplicates`); a key with several is held against the fact that differs least.
    """
    right = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)], F.lit(True).alias("_known"))
    mine = claims.withColumn("_row", F.monotonically_increasing_id())
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    wrong = F.filter(F.array(*[F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_f{i}")), F.lit(f)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
    wrong = F.when(F.col("_known"), wrong).otherwise(F.array(F.lit("unknown")))
    rows = mine.join(right, on, "left").select("_row", *claims.columns, wrong.alias("mismatches"))
    return rows.groupBy("_row").agg(F.min_by(F.struct(*claims.columns, "mismatches"), F.struct(F.size("mismatches"), "mismatches")).alias("r")).select("r.*")


def gate(issues: DataFrame) -> None:
    """Ends the job if any issue is an error; at most twenty are shown."""
    bad = issues.where("severity = 'error'").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.key}" for r in bad))


def contrast(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Contrast ratio of two colours given as shares of red, green and blue."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    light = lambda c: sum((linear(x) * w for x, w in zip(c, (0.2126, 0.7152, 0.0722))), F.lit(0.0))
    return (F.greatest(light(a), light(b)) + 0.05) / (F.least(light(a), light(b)) + 0.05)
