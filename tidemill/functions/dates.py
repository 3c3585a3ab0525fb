"""Calendar functions. Instants are UTC; local calendars are named by their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_utc(c: Column) -> Column:
    """``YYYYMMDDTHHMMSSZ`` as an instant; null if it isn't one."""
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def feed_date(c: Column, zone: Column) -> Column:
    """RFC 822 or ISO dates as UTC instants. Without a zone of its own the date is read in ``zone``; null if that is null or nothing fits."""
    text = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", ""))
    named = F.create_map(*[F.lit(x) for pair in (("GMT", "+0000"), ("UTC", "+0000"), ("UT", "+0000"), ("Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"), ("BST", "+0100"), ("CET", "+0100"), ("CEST", "+0200"), ("KST", "+0900")) for x in pair])
    tail = F.regexp_extract(text, r"(?:\s|(?<=\d))(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})$", 1)
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*(Z|[A-Z]{2,4}|(?<=:\d{2}(?:\.\d{1,9})?\s?)[+-]\d{2}:?\d{2})$", "")), r"\.\d+$", "")
    offset = F.when(tail == "", None).when(tail.rlike(r"^[+-]"), F.replace(tail, F.lit(":"), F.lit(""))).otherwise(F.try_element_at(named, tail))
    seen = None
    for pattern in ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"):
        at = F.try_to_timestamp(plain, F.lit(pattern))
        seen = at if seen is None else F.coalesce(seen, at)
    minutes = F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int"))
    shifted = F.timestamp_seconds(F.unix_timestamp(seen) - minutes * 60)
    return F.when(offset.isNotNull(), shifted).when(tail == "", F.to_utc_timestamp(seen, zone))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_month(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def day_range(day: Column, zone: str) -> tuple[Column, Column]:
    """The half-open range of instants that is a local day."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def overnight_range(day: Column, from_hour: int, to_hour: int, zone: str) -> tuple[Column, Column]:
    """[from, to) of a local day; a window that does not end later than it starts ends on the next day."""
    start = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + from_hour * 3600)
    end = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + (to_hour + (24 if to_hour <= from_hour else 0)) * 3600)
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(end, zone)


def iso_week(day: Column) -> Column:
    """``YYYY-WW`` by ISO 8601."""
    return F.format_string("%d-%02d", F.date_part(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def is_eu_summer(ts: Column) -> Column:
    """Between 01:00 UTC of the last Sundays of March and October."""
    year = F.year(ts)
    last_sunday = lambda month: F.timestamp_seconds(F.unix_timestamp(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(31)), 7), "SUN").cast("timestamp")) + 3600)
    return (ts >= last_sunday(3)) & (ts < last_sunday(10))


def days_between(first: Column, last: Column) -> Column:
    """All days from ``first`` to ``last``, both included; empty if there are none."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def relative(ts: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    return F.when(minutes < 1, "now").when(minutes < 60, F.format_string("%d min", minutes)).when(minutes < 1440, F.format_string("%d h", F.floor(minutes / 60))).otherwise(F.format_string("%d d", F.floor(minutes / 1440)))


def to_utc(local: Column, zone: str, choice: str = "compatible") -> Column:
    """The instant of a wall-clock time, given as the timestamp that shows it in UTC.

    A time that the zone has twice is the first of both (``later``: the second); one that it skips is read by the offset
    before the gap (``earlier``: by the one after it).  ``reject`` gives null for both kinds.
    """
    shown = lambda u: F.from_utc_timestamp(u, zone)
    offset = lambda u: F.unix_micros(shown(u)) - F.unix_micros(u)
    # a zone changes at most once within two days, so the offsets a day before and after are all there are
    day = F.expr("INTERVAL 24 HOUR")
    before, after = offset(local - day), offset(local + day)
    early, late = (F.timestamp_micros(F.unix_micros(local) - o) for o in (F.greatest(before, after), F.least(before, after)))
    unclear = lambda u: F.lit(None).cast("timestamp") if choice == "reject" else u
    once = F.when(early == late, early).when((shown(early) == local) & (shown(late) != local), early).when((shown(early) != local) & (shown(late) == local), late)
    twice = unclear(late if choice == "later" else early)
    skipped = unclear(early if choice == "earlier" else late)
    return F.coalesce(once, F.when(shown(early) == local, twice).otherwise(skipped))


def slot(day: Column, zone: str, times: dict[str, tuple[str, str]], lead_minutes: int, target: str) -> Column:
    """Instants of a local day as a struct: each of ``times`` (summer, winter) by the season at its midnight, and ``deadline`` so many minutes before ``target``."""
    summer = is_eu_summer(day_range(day, zone)[0])
    at = {n: to_utc(F.to_timestamp(F.concat(day.cast("string"), F.when(summer, F.lit(f" {s}")).otherwise(F.lit(f" {w}")))), zone) for n, (s, w) in times.items()}
    deadline = F.timestamp_seconds(F.unix_timestamp(at[target]) - lead_minutes * 60)
    return F.struct(F.when(summer, "summer").otherwise("winter").alias("season"), *[c.alias(n) for n, c in at.items()], deadline.alias("deadline"))
