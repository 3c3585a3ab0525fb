"""A registry of rules over several tables, run table by table: all rules that judge single rows of a table share one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARN = "error", "warn"
#: Rows that one task counts the values of, about.
TASK_ROWS = 500_000
ISSUE = "rule string, severity string, key string, n long"


@dataclass(frozen=True)
class Row:
    """A condition that a row must not meet; null is no."""

    rule: str
    table: str
    bad: Column
    severity: str = ERROR


@dataclass(frozen=True)
class Unique:
    """Columns whose values together occur once; rows with a null among them do not count."""

    rule: str
    table: str
    columns: tuple[str, ...]
    severity: str = ERROR


@dataclass(frozen=True)
class Refers:
    """A column whose values, apart from null, are among those of another table's column."""

    rule: str
    table: str
    column: str
    to: str
    to_column: str
    severity: str = ERROR


@dataclass(frozen=True)
class Size:
    """A table that has ``least`` rows and more, of those that meet ``where``."""

    rule: str
    table: str
    least: int
    where: Column | None = None
    severity: str = ERROR


def audit(tables: Mapping[str, DataFrame], keys: Mapping[str, str], rules: Sequence[Row | Unique | Refers | Size]) -> DataFrame:
    """(rule, severity, key, n): every breach of ``rules``; ``keys`` names the column by which a table's rows are known.

    A row rule gives an issue for each row, the others one for each value with the rows that have it, or for the table.  Names of rules are unique.
    """
    names = [r.rule for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("two rules share a name")
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], ISSUE)
    for name, df in tables.items():
        mine = [r for r in rules if r.table == name]
        rows = [r for r in mine if isinstance(r, Row)]
        if rows:
            broken = F.filter(F.array(*[F.when(r.bad, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rows]), lambda x: x.isNotNull())
            found = df.select(F.col(keys[name]).cast("string").alias("key"), F.explode(broken).alias("i"))
            out = out.unionByName(found.select("i.rule", "i.severity", "key", F.lit(1).cast("long").alias("n")))
        # what must be counted over a whole table is counted for all its rules at once
        sizes = [r for r in mine if isinstance(r, Size)]
        if sizes:
            counts = df.agg(*[F.count_if(F.coalesce(r.where, F.lit(False)) if r.where is not None else F.lit(True)).alias(f"_{i}") for i, r in enumerate(sizes)])
            small = F.array(*[F.when(F.col(f"_{i}") < r.least, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(name).alias("key"), F.col(f"_{i}").alias("n"))) for i, r in enumerate(sizes)])
            out = out.unionByName(counts.select(F.explode(F.filter(small, lambda x: x.isNotNull())).alias("i")).select("i.*"))
        for r in mine:
            if isinstance(r, Unique):
                key = F.concat_ws(":", *[F.col(c).cast("string") for c in r.columns])
                # values are mostly unique, so nothing is gained by counting before they are dealt; a task gets TASK_ROWS of them, however many there are
                whole = df.dropna(subset=list(r.columns)).select(*r.columns)
                parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
                twice = whole.repartition(parts, *r.columns).groupBy(*r.columns).agg(F.count("*").alias("n")).where("n > 1")
                out = out.unionByName(twice.select(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), key.alias("key"), "n"))
            if isinstance(r, Refers):
                used = df.where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("_v")).agg(F.count("*").alias("n"))
                known = tables[r.to].select(F.col(r.to_column).alias("_v")).distinct()
                out = out.unionByName(used.join(known, "_v", "left_anti").select(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.col("_v").cast("string").alias("key"), "n"))
    return out
