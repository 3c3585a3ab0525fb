"""Ordered folds over the events of a key, as aggregations and two-level windows: no key's events are gathered in one row.

A key is cut into time ranges.  What a range hands on is a few values, these are accumulated over a key's ranges, and
windows run inside a range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Ranks of statuses; the last is the collapse that only the one before it survives.
RUMOR, NEGOTIATING, AGREED, OFFICIAL, COLLAPSED = range(5)


def _firsts(rank: str, at: Column) -> list[tuple[str, Column]]:
    """When each rank was first and the collapse last reached, as aggregates."""
    return [(f"_f{v}", F.min(F.when(F.col(rank) == v, at))) for v in range(COLLAPSED)] + [("_c", F.max(F.when(F.col(rank) == COLLAPSED, at)))]


def _peak() -> Column:
    """The highest rank that has been reached; null for none."""
    return F.coalesce(*[F.when(F.col(f"_f{v}").isNotNull(), v) for v in reversed(range(COLLAPSED))])


def _reached() -> Column:
    """When the peak was first reached."""
    return F.coalesce(*[F.col(f"_f{v}") for v in reversed(range(COLLAPSED))])


def _status() -> Column:
    """The peak, or the collapse where that came later and the peak does not survive it.

    A status rises to the highest rank; it collapses unless it is official, and revives only above its peak.  So the
    peak is the greatest rank so far, and a collapse counts until the peak rises again.
    """
    gone = F.col("_c").isNotNull() & (_reached().isNull() | ((_peak() < OFFICIAL) & (F.col("_c") > _reached())))
    return F.when(gone, COLLAPSED).otherwise(_peak())


def status_of(events: DataFrame, key: str, order: Sequence[str], rank: str) -> DataFrame:
    """Per key the final status, the peak, and the number of events."""
    seen = events.groupBy(key).agg(*[c.alias(n) for n, c in _firsts(rank, F.struct(*order))], F.count("*").cast("int").alias("n"))
    return seen.select(key, _status().alias("status"), _peak().alias("peak"), "n")


def _range(df: DataFrame, column: str, span: str, numbers: int = 4096) -> Column:
    """The range of a time, or of a number, that a row lies in."""
    timed = df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    return F.date_trunc(span, column) if timed else F.floor(F.col(column) / numbers)


def status_changes(events: DataFrame, key: str, order: Sequence[str], rank: str, span: str = "month") -> DataFrame:
    """Every event with the status after it and whether it changed the state; ``order`` starts with a time or number and tells all events of a key apart."""
    at = F.struct(*order)
    rows = events.select(key, *order, rank, at.alias("_at"), _range(events, order[0], span).alias("_r"))
    names = [n for n, _ in _firsts(rank, F.col("_at"))]
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per_range = rows.groupBy(key, "_r").agg(*[c.alias(n) for n, c in _firsts(rank, F.col("_at"))])
    so_far = per_range.select(F.col(key).alias("_k"), F.col("_r").alias("_q"), *[(F.max if n == "_c" else F.min)(n).over(before).alias(f"{n}b") for n in names])
    inside = Window.partitionBy(key, "_r").orderBy(*order)
    rows = rows.select("*", *[c.over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, c in _firsts(rank, F.col("_at"))], F.max(F.when(F.col(rank) == COLLAPSED, F.col("_at"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    rows = rows.join(so_far, F.col(key).eqNullSafe(F.col("_k")) & F.col("_r").eqNullSafe(F.col("_q")))
    rows = rows.select(key, *order, rank, "_at", *[(F.greatest if n == "_c" else F.least)(n, f"{n}b").alias(n) for n in names], F.greatest("_p", "_cb").alias("_p"))
    falls = (F.col(rank) == COLLAPSED) & F.coalesce(_peak() < OFFICIAL, F.lit(True)) & F.coalesce(F.when(_reached().isNull(), F.col("_p").isNull()).otherwise(F.col("_p") <= _reached()), F.lit(True))
    rises = (F.col(rank) != COLLAPSED) & (_reached() == F.col("_at"))
    return rows.select(key, *order, _status().alias("status"), F.coalesce(rises | falls, F.lit(False)).alias("changed"))


def _sessions(rows: DataFrame, key: str, order: Sequence[str], at: str, seconds: int, span: str) -> DataFrame:
    """``rows`` with _s, the time at which their run of events without a gap of more than ``seconds`` began."""
    rows = rows.withColumn("_u", F.unix_micros(at)).withColumn("_r", F.date_trunc(span, at))
    key_and_range = lambda df: df.select(F.col(key).alias("_k"), F.col("_r").alias("_q"), "_b")
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_r").eqNullSafe(F.col("_q"))
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_r").orderBy(at, *order)
    last = rows.groupBy(key, "_r").agg(F.max("_u").alias("_m")).withColumn("_b", F.max("_m").over(before))
    rows = rows.withColumn("_l", F.lag("_u").over(inside)).join(key_and_range(last), same).withColumn("_l", F.coalesce("_l", "_b")).drop("_k", "_q", "_b")
    rows = rows.withColumn("_o", F.when(F.col("_l").isNull() | (F.col("_u") - F.col("_l") > F.lit(seconds * 1_000_000)), F.col("_u")))
    opened = rows.groupBy(key, "_r").agg(F.max("_o").alias("_m")).withColumn("_b", F.max("_m").over(before))
    rows = rows.withColumn("_s", F.max("_o").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(key_and_range(opened), same)
    return rows.withColumn("_s", F.coalesce("_s", "_b")).drop("_k", "_q", "_b", "_l", "_o", "_r")


#: Times of a run that one row may hold; longer runs are chained by doubling.
LONG = 1000


def _chained(times: DataFrame, width: int) -> DataFrame:
    """(_k, _s, _u): the starts of windows of short runs; ``times``: _k, _s and the times of a run."""
    begin = F.struct(F.lit(None).cast("long").alias("a"), F.array().cast("array<bigint>").alias("out"))
    opens = lambda s, t: s["a"].isNull() | (t > s["a"] + width)
    starts = F.aggregate("times", begin, lambda s, t: F.when(opens(s, t), F.struct(t.alias("a"), F.concat(s["out"], F.array(t)).alias("out"))).otherwise(s), lambda s: s["out"])
    return times.select("_k", "_s", F.explode(starts).alias("_u"))


def _next_times(times: DataFrame, width: int) -> DataFrame:
    """(_k, _u, _n): for each time the first one more than ``width`` later, null if there is none.

    It lies in the next slot of ``width`` or, if there is none late enough, is the first of the next slot with times: no frame spans a key.
    """
    slot = F.floor(F.col("_u") / width)
    marks = times.select("_k", "_u", slot.alias("_q"), F.lit(False).alias("_probe")).unionByName(times.select("_k", (F.col("_u") + width).alias("_u"), (slot + 1).alias("_q"), F.lit(True).alias("_probe")))
    after = Window.partitionBy("_k", "_q").orderBy("_u").rangeBetween(1, Window.unboundedFollowing)
    probes = marks.withColumn("_n", F.min(F.when(~F.col("_probe"), F.col("_u"))).over(after)).where("_probe").select("_k", (F.col("_u") - width).alias("_u"), "_q", "_n")
    firsts = times.groupBy("_k", slot.alias("_f")).agg(F.min("_u").alias("_m"))
    # for each probed slot the first time of a later one
    order = Window.partitionBy("_k").orderBy("_p").rangeBetween(1, Window.unboundedFollowing)
    slots = firsts.select("_k", F.col("_f").alias("_p"), "_m").unionByName(firsts.select("_k", (F.col("_f") + 1).alias("_p"), F.lit(None).cast("long").alias("_m"))).groupBy("_k", "_p").agg(F.min("_m").alias("_m"))
    later = slots.withColumn("_l", F.min("_m").over(order)).select(F.col("_k").alias("_j"), "_p", "_l")
    return probes.join(later, F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_q") == F.col("_p")), "left").select("_k", "_u", F.coalesce("_n", "_l").alias("_n"))


def _doubled(times: DataFrame, width: int) -> DataFrame:
    """(_k, _u): the starts of windows of long runs, by following the pointers to the next start in strides that double."""
    jumps = materialise(_next_times(times, width), "jumps")
    starts = materialise(times.where("_u = _s").select("_k", "_u"), "starts")
    n = starts.count()
    while True:
        ahead = jumps.where("_n IS NOT NULL").select(F.col("_k").alias("_j"), F.col("_u").alias("_v"), "_n")
        there = starts.join(ahead, F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_u") == F.col("_v"))).select("_k", F.col("_n").alias("_u"))
        starts = materialise(starts.unionByName(there).distinct(), "starts")
        before, n = n, starts.count()
        if n == before:
            return starts
        jumps = materialise(jumps.where("_n IS NOT NULL").join(ahead.withColumnRenamed("_n", "_m"), F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_n") == F.col("_v"))).select("_k", "_u", F.col("_m").alias("_n")), "jumps")


def anchored_windows(events: DataFrame, key: str, order: Sequence[str], at: str, seconds: int, span: str = "day") -> DataFrame:
    """Every event with ``anchor``, the first time of its window: a window starts at its first event and takes in what follows it within ``seconds``.

    A gap of more than ``seconds`` always starts a window, so windows are chained inside runs without such a gap, over
    their distinct times: a run of up to ``LONG`` in one expression, longer ones by pointers from each time to the next possible start, which are followed in
    strides that double.  Then each range of ``span`` carries on the last start before it, so a key with most events is spread over tasks.  Null times form no window.
    """
    columns = list(dict.fromkeys([at, *order]))
    rows = _sessions(events.select(key, *columns).where(F.col(at).isNotNull()), key, [c for c in order if c != at], at, seconds, span)
    width = seconds * 1_000_000
    times = materialise(rows.select(F.col(key).alias("_k"), "_s", "_u").distinct(), "times")
    runs = times.groupBy("_k", "_s").agg(F.count("*").alias("n"))
    long_runs = runs.where(F.col("n") > LONG).select(F.col("_k").alias("_j"), F.col("_s").alias("_z"))
    some = not long_runs.isEmpty()
    of_long = F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_s") == F.col("_z"))
    short = times.join(long_runs, of_long, "left_anti") if some else times
    starts = _chained(short.groupBy("_k", "_s").agg(F.array_sort(F.collect_list("_u")).alias("times")), width).select("_k", "_u")
    if some:
        starts = starts.unionByName(_doubled(times.join(long_runs, of_long, "left_semi"), width))
    starts = starts.select("_k", F.col("_u").alias("_o"))
    rows = rows.drop("_s").withColumn("_r", F.date_trunc(span, at)).join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_u") == F.col("_o")), "left").drop("_k")
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_r").orderBy("_u").rangeBetween(Window.unboundedPreceding, 0)
    opened = rows.groupBy(key, "_r").agg(F.max("_o").alias("_m")).withColumn("_b", F.max("_m").over(before)).select(F.col(key).alias("_k"), F.col("_r").alias("_q"), "_b")
    out = rows.withColumn("_a", F.max("_o").over(inside)).join(opened, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q")))
    return out.select(key, *order, F.timestamp_micros(F.coalesce("_a", "_b")).alias("anchor"))
