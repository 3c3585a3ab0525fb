"""Exact order statistics by refining ranges: counts per range, then only the range that holds the rank, no buffer of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Ranges into which a round cuts what is left.
RANGES = 256


def _at_ranks(rows: DataFrame, keys: Sequence[str], value: str, rank: Column) -> DataFrame:
    """(keys, value): the value at ``rank`` (from 1, a column over n, the rows of a key) for each key."""
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys] or [F.lit(True)]
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.col(value).alias("_o"), v.alias("_v"))
    state = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n")).withColumn("_rank", rank)
    state = materialise(state.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_lo", "_hi", "_rank"), "ranks")
    done = None
    while True:
        ended = state.where("_lo = _hi")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("_lo < _hi")
        if state.isEmpty():
            return done.select(*[F.col(f"_s{k}").alias(k) for k in keys], F.col("_lo").alias(value))
        inside = rows.join(state, [*same("", "_s"), F.col("_v").between(F.col("_lo"), F.col("_hi"))])
        # halves first, so that the width of a range of all doubles stays finite
        width = F.col("_hi") / 2 - F.col("_lo") / 2
        share = F.when(width > 0, F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, width)).otherwise((F.col("_v") > F.col("_lo")).cast("double"))
        names = [f"_s{k}" for k in keys]
        part = inside.groupBy(*names, "_rank", F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(*names).orderBy("_b")  # at most RANGES rows a key
        part = part.withColumn("_upto", F.sum("_n").over(order)).where("_upto >= _rank AND _upto - _n < _rank")
        state = materialise(part.select(*names, "_lo", "_hi", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank")), "ranks")


def lower_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): of an even number the lower of the two in the middle.  Nulls and NaN do not count; a key without values has no row; values are compared as doubles."""
    return _at_ranks(rows, keys, value, F.expr("(n + 1) div 2"))


def median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): of an even number the mean of the two in the middle; else as :func:`lower_median`."""
    low, high = _at_ranks(rows, keys, value, F.expr("(n + 1) div 2")), _at_ranks(rows, keys, value, F.expr("n div 2 + 1"))
    high = high.select(*[F.col(k).alias(f"_j{k}") for k in keys], F.col(value).alias("_high"))
    on = [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys] or [F.lit(True)]
    return low.join(high, on).select(*keys, (F.col(value) / 2 + F.col("_high") / 2).alias(value))
