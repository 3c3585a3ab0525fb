"""Rankings, streaks, neighbours and quotas. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.selection import lower_median
from tidemill.scratch import materialise


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; Spark cuts each task's rows to ``n`` before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def last_list(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Per key the last ``n`` values as an array, oldest first."""
    kept = top(rows, keys, [F.col(c).desc() for c in order], n, "_rn")
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias(value))


def with_quota(rows: DataFrame, keys: Sequence[str], inside: Column, order: Sequence[Column], slots: int, quota: int) -> DataFrame:
    """Per key ``slots`` rows: the first ``quota`` that are ``inside``, the rest by order; ``rank`` is the order of the output."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_in").orderBy(*order))).where(F.col("_n") <= slots)
    marked = marked.withColumn("_q", F.col("_in") & (F.col("_n") <= quota)).withColumn("_taken", F.sum(F.col("_q").cast("int")).over(Window.partitionBy(*keys)))
    marked = marked.withColumn("_rest", F.row_number().over(Window.partitionBy(*keys, "_q").orderBy(*order)))
    kept = marked.where(F.col("_q") | (F.col("_rest") <= F.lit(slots) - F.col("_taken")))
    return kept.withColumn("rank", F.row_number().over(by)).drop("_in", "_n", "_q", "_taken", "_rest")


def round_robin(rows: DataFrame, stratum: str, order: Sequence[Column], strata: Column, n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn, strata in the order of ``strata``."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", strata, *order).limit(n)


def hash_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows with the least SHA-256 of seed and key: the same on every run and in any order of the input."""
    return rows.withColumn("sample_key", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)).orderBy("sample_key", key).limit(n)


def trailing(rows: DataFrame, key: str, order: Sequence[str], counts: Column, stops: Column, since: str) -> DataFrame:
    """Per key, from the latest row back: how many rows count before the first that stops, and the earliest of them.

    Rows that neither count nor stop are skipped.  The latest stop is found by aggregation, so keys of any length fit.
    """
    order_key = F.struct(*order)
    last_stop = rows.where(stops).groupBy(key).agg(F.max(order_key).alias("_stop"))
    open_rows = rows.join(last_stop, key, "left").where(F.col("_stop").isNull() | (order_key > F.col("_stop")))
    found = open_rows.where(counts).groupBy(key).agg(F.count("*").alias("streak"), F.min(since).alias("since"))
    return rows.select(key).distinct().join(found, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def longest_run(rows: DataFrame, key: str, day: str, good: Column) -> DataFrame:
    """Longest run of successive good days per key."""
    days = rows.where(good).select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day)))
    runs = days.withColumn("_i", island).groupBy(key, "_i").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with _i, the place of a row in its key from 0, and _n, the key's rows; ``order`` tells the rows of a key apart.

    Rows are dealt out by ranges of key and order and numbered inside their range, and a range begins where those before it end, so a key with most rows is spread over tasks.
    """
    dealt = materialise(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    held = held.select(*[F.col(k).alias(f"_j{k}") for k in keys], F.col("_p").alias("_q"), "_b", "_n")
    inside = Window.partitionBy(*keys, "_p").orderBy(*order)
    on = [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys] + [F.col("_p") == F.col("_q")]
    out = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(held, on)
    return out.select(*rows.columns, (F.col("_b") + F.col("_r")).alias("_i"), "_n")


def chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Even chunks of at most ``size`` rows per key, the first ones larger by one where it does not divide."""
    out = positions(rows, keys, order).withColumn("_k", F.ceil(F.col("_n") / size)).withColumn("_b", F.expr("_n div _k")).withColumn("_e", F.expr("_n % _k"))
    return out.withColumn("chunk", F.expr("if(_i < _e * (_b + 1), _i div (_b + 1), _e + (_i - _e * (_b + 1)) div _b) + 1")).drop("_i", "_n", "_k", "_b", "_e")


def mode_recent(rows: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """Most frequent value per key; of equally frequent ones the most recently used, then the least."""
    uses = rows.groupBy(*keys, value).agg(F.count("*").alias("uses"), F.max(at).alias("last_used"))
    least_first = Window.partitionBy(*keys).orderBy(F.desc("uses"), F.desc("last_used"), value)
    return uses.withColumn("_rn", F.row_number().over(least_first)).where("_rn = 1").drop("_rn")


def neighbours(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key with the ones before and after, first and latest, position and number."""
    w = Window.partitionBy(key).orderBy(value)
    every = Window.partitionBy(key)
    return rows.select(key, value).distinct().select(key, value, F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"), F.min(value).over(every).alias("first"), F.max(value).over(every).alias("latest"), F.row_number().over(w).alias("position"), F.count("*").over(every).alias("of"))


def densify(rows: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """A row per day of the span: published (with its ordinal) or missing."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    have = rows.select(day).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(day)))
    return spine.join(have, day, "left").withColumn("state", F.when(F.col("ordinal").isNotNull(), "published").otherwise("missing"))


def around(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], is_self: Column, span: int) -> DataFrame:
    """For each row that ``is_self`` picks (one per key): the min(n, 2 * span + 1) rows around it, shifted at the edges."""
    out = positions(rows, keys, order)
    # one row a key says where the others stand to it
    own = out.where(is_self).groupBy(*keys).agg(F.max("_i").alias("_s")).select(*[F.col(k).alias(f"_j{k}") for k in keys], "_s")
    out = out.join(own, [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys]).drop(*[f"_j{k}" for k in keys]) if keys else out.crossJoin(F.broadcast(own))
    out = out.withColumn("_from", F.greatest(F.lit(0), F.least(F.col("_s") - span, F.col("_n") - (2 * span + 1))))
    return out.where((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_from") + 2 * span + 1)).withColumn("row_no", F.col("_i") + 1).drop("_i", "_n", "_s", "_from")


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, gap_days: int = 1, span: str = "month") -> DataFrame:
    """Date intervals per key, joined where they overlap or lie at most ``gap_days`` apart; intervals without a start are left out.

    A key is cut by the ``span`` of the starts: how far the intervals before a span reach, and how many are new before it, is handed on from span to span.
    """
    # equal intervals are one row, so that no two windows can order them differently
    rows = rows.where(F.col(start).isNotNull()).groupBy(key, start, end).agg(F.count("*").alias("_n")).withColumn("_r", F.date_trunc(span, start))
    inside = Window.partitionBy(key, "_r").orderBy(start, end)
    earlier = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, fold: Column) -> DataFrame:
        """``df`` with _b, what the spans before a row's own fold to."""
        spans = df.groupBy(key, "_r").agg(fold.alias("_f"))
        spans = spans.select(F.col(key).alias("_k"), F.col("_r").alias("_q"), (F.max if fold is reach else F.sum)("_f").over(earlier).alias("_b"))
        return df.join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q"))).drop("_k", "_q")

    reach = F.max(end)
    so_far = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_b"))
    fresh = carried(rows, reach).withColumn("_m", so_far).withColumn("_new", F.when(F.col("_m").isNull() | (F.col(start) > F.date_add("_m", gap_days)), 1).otherwise(0)).drop("_b", "_m")
    numbered = carried(fresh, F.sum("_new")).withColumn("_g", F.coalesce("_b", F.lit(0)) + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_g")


def lower_median_window(rows: DataFrame, keys: Sequence[str], at: str, reach_days: int, tail_hours: int) -> DataFrame:
    """Per key the span of rows at most ``reach_days`` from the lower median, with ``tail_hours`` after the last."""
    mid = lower_median(rows.select(*keys, F.unix_timestamp(at).alias("_mid")), keys, "_mid")
    near = rows.join(mid, list(keys)).where(F.abs(F.unix_timestamp(at) - F.col("_mid")) <= reach_days * 86400)
    return near.groupBy(*keys).agg(F.min(at).alias("opens"), F.timestamp_seconds(F.max(F.unix_timestamp(at)) + tail_hours * 3600).alias("closes"), F.count("*").alias("n"))
