"""State per key with event-time timers, in the RocksDB store: what a batch writes follows the batch, not the state.

Each operator is a stateful processor under :func:`run`, which appends a row for every change of a key to a table of the shared folder.  A restart
from the checkpoint goes on where the last run stopped, the file sink's log takes a batch that is run again once, and :func:`latest` reads the
table as what is known of each key now.  Timers, not scans, find the keys whose time is up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.scratch import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def run(stream: DataFrame, keys: list[str], at: str, delay: str, processor: StatefulProcessor, schema: str, name: str, root: str | None = None) -> DataFrame:
    """Run ``stream`` to its end through ``processor``; the table of all changes so far, with the columns of ``schema``.

    ``delay`` is how late rows may come (an interval) before the watermark of ``at`` leaves them out.  A later run with the same ``root`` continues.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, name)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        changes = stream.withWatermark(at, delay).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
        changes.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(schema).parquet(f"{root}/changes")


def latest(changes: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_c")).select(*keys, "_c.*")


def _millis(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


class _Timed(StatefulProcessor):
    """A value per key that a timer clears; ``version`` counts the changes of the key, also across its returns."""

    fields, columns = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.fields)
        self.count = handle.getValueState("count", "n long")

    def versions(self, n: int) -> int:
        """The version before the ``n`` changes that are made now: every call to the state is a round trip, so a key makes one of each."""
        last = self.count.get()[0] if self.count.exists() else 0
        self.count.update((last + n,))
        return last

    def set_timer(self, millis: int, last: int) -> None:
        # a key that never changed before has no timer
        for old in list(self.handle.listTimers()) if last else ():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)

    def rows(self, key, changes: list[tuple], last: int) -> pd.DataFrame:
        """A frame of ``changes``, one for all of a key."""
        names = [self.key, *self.columns, "version"]
        return pd.DataFrame([(key[0], *c, last + i) for i, c in enumerate(changes, 1)], columns=names)

    def close(self) -> None:
        pass


class FirstSeen(_Timed):
    """Earliest and latest time of a key, until ``days`` of event time pass without it.

    Output: key, first, newest, state (``new``, ``again`` or ``expired``), version.  Null times count for nothing.
    """

    fields, columns = "first timestamp, newest timestamp", ("first", "newest", "state")

    def __init__(self, key: str, at: str, days: float):
        self.key, self.at, self.days = key, at, days

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(map(pd.Timestamp, self.value.get())) if self.value.exists() else None
        first, newest = known or (None, None)
        state, before, most, changes = ("again" if known else "new"), known, pd.Timedelta(days=self.days), []
        for t in sorted(t for p in rows for t in p[self.at] if t is not pd.NaT):
            if newest is not None and t > newest + most:
                # the time was up between two rows of one batch: as if they had come in two
                changes.append((first, newest, "expired"))
                first, newest, state, before = None, None, "new", None
            first, newest = (t, t) if first is None else (min(first, t), max(newest, t))
        moved = first is not None and before != (first, newest)
        if moved:
            changes.append((first, newest, state))
        if changes:
            last = self.versions(len(changes))
            if moved:
                self.value.update((first.to_pydatetime(), newest.to_pydatetime()))
                self.set_timer(_millis(newest) + int(self.days * 86_400_000), last)
            yield self.rows(key, changes, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            first, newest = self.value.get()
            self.value.clear()
            yield self.rows(key, [(first, newest, "expired")], self.versions(1))


class Retries(_Timed):
    """Items that wait for a result: ``failed`` rows add a try, an ``ok`` row ends the wait, more than ``most`` tries or ``days`` of event time without a row end it too.

    Rows are taken in order of time (``failed`` before ``ok`` at the same time).  Output: key, tries, state (``pending``, ``done``, ``dropped`` or ``expired``), version.
    """

    fields, columns = "tries long", ("tries", "state")

    def __init__(self, key: str, at: str, ok: str, most: int, days: float):
        self.key, self.at, self.ok, self.most, self.days = key, at, ok, most, days

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain values: a frame for the few rows of a key costs more than they do
        every = sorted((t, bool(ok)) for p in rows for t, ok in zip(p[self.at], p[self.ok]) if t is not pd.NaT and ok is not None and ok == ok)
        waiting = self.value.exists()
        tries, state, changes = (self.value.get()[0] if waiting else 0), "pending" if waiting else "", []
        for _, ok in every:
            if ok:
                tries, state = (tries, "done") if state == "pending" else (tries, state)
            elif state == "pending" or not state:
                tries, state = tries + 1, "pending"
            if state == "pending" and tries > self.most:
                state = "dropped"
            if state in ("done", "dropped"):
                changes.append((tries, state))
                tries, state = 0, ""
        pending = state == "pending"
        if pending and every:
            changes.append((tries, state))
        last = self.versions(len(changes)) if changes else 0
        if pending:
            self.value.update((tries,))
            if every:
                self.set_timer(_millis(every[-1][0]) + int(self.days * 86_400_000), last)
        elif waiting:
            self.value.clear()
        if changes:
            yield self.rows(key, changes, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            tries = self.value.get()[0]
            self.value.clear()
            yield self.rows(key, [(tries, "expired")], self.versions(1))


def first_seen(stream: DataFrame, key: str, at: str, days: float, delay: str = "0 seconds", root: str | None = None) -> DataFrame:
    """All changes of :class:`FirstSeen` for the keys of ``stream``; null keys are a key of their own."""
    kind = stream.schema[key].dataType.simpleString()
    return run(stream.select(key, at), [key], at, delay, FirstSeen(key, at, days), f"`{key}` {kind}, first timestamp, newest timestamp, state string, version long", "first-seen", root)


def retries(stream: DataFrame, key: str, at: str, ok: str, most: int, days: float, delay: str = "0 seconds", root: str | None = None) -> DataFrame:
    """All changes of :class:`Retries` for the keys of ``stream``."""
    kind = stream.schema[key].dataType.simpleString()
    return run(stream.select(key, at, ok), [key], at, delay, Retries(key, at, ok, most, days), f"`{key}` {kind}, tries long, state string, version long", "retries", root)
