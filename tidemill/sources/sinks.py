"""Sinks: partitioned tables, month compaction, posting lists, feed and calendar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import escape_ics, escape_xml, fold_ics
from tidemill.operators.select import same_content
from tidemill.scratch import new_path


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions that occur in ``rows``, one shuffle by partition so that each gets few files; others stay."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_if_changed(rows: DataFrame, path: str, columns: list[str]) -> bool:
    """Write unless the table there holds the same rows in ``columns``; says whether it wrote."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) and same_content(spark.read.parquet(path), rows, columns):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def round_trip_partitions(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` written by partition to the shared folder and read again."""
    path = new_path(rows.sparkSession, "partitions")
    write_partitions(rows, path, by)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def compaction_plan(rows: DataFrame, day: str, today: Column, keep_days: int) -> DataFrame:
    """(month, days, due): months whose last day is more than ``keep_days`` ago are due for merging."""
    days = rows.select(day).distinct()
    return days.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), (F.date_add(F.last_day(F.min(day)), keep_days) < today).alias("due"))


def posting_lists(rows: DataFrame, id_: str, tokens: str, block: int = 4096) -> DataFrame:
    """(token, block, df, postings): the ids of a token as text, in blocks of so many ids, so that no list grows with the table."""
    words = rows.select(id_, F.explode(F.array_distinct(tokens)).alias("token"))
    return words.groupBy("token", F.floor(F.col(id_) / block).alias("block")).agg(F.count("*").alias("df"), F.array_join(F.array_sort(F.collect_list(F.col(id_).cast("string"))), ",").alias("postings"))


def feed_xml(rows: DataFrame, title: str, link: str, at: str) -> DataFrame:
    """``rows`` with ``item``, an RSS item."""
    stamp = F.date_format(at, "dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), escape_xml(F.col(title)), F.lit("</title><link>"), escape_xml(F.col(link)), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    return rows.withColumn("item", item)


def calendar_event(rows: DataFrame, uid: str, summary: str, start: str, minutes: int = 120) -> DataFrame:
    """``rows`` with ``event``, an iCalendar event of folded lines."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    end = F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60)
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART:"), stamp(F.col(start))), F.concat(F.lit("DTEND:"), stamp(end)), fold_ics(F.concat(F.lit("SUMMARY:"), escape_ics(F.col(summary)))), F.lit("END:VEVENT")]
    return rows.withColumn("event", F.concat_ws("\r\n", *lines))
