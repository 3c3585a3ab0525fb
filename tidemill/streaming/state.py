"""Incremental forms: first-seen state with expiry, and low watermarks per key, each run as a stream into a table.

Micro-batches merge into Parquet state written anew under the shared folder, so a restart from the checkpoint
continues, and a batch that is run twice gives the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.select import window_verdict
from tidemill.scratch import new_path


def _last_state(spark, root: str) -> str | None:
    """The newest state table under ``root``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/state-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    numbers = [int(f.getPath().getName().rpartition("-")[2]) for f in found or ()]
    return f"{root}/state-{max(numbers)}" if numbers else None


def run_batches(stream: DataFrame, merge, schema: str, name: str, root: str | None = None) -> DataFrame:
    """Run ``stream`` to its end; ``merge(state, batch)`` gives the next state. Returns the last state.

    Batch n reads the state of batch n - 1 and overwrites its own, so running a batch again changes nothing, and
    a later run with the same ``root`` goes on where the last one stopped.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, name)

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{root}/state-{number - 1}") if number else spark.createDataFrame([], schema)
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/state-{number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = _last_state(spark, root)
    return spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)


def first_seen_stream(stream: DataFrame, key: str, at: str, days: int, root: str | None = None) -> DataFrame:
    """Earliest time per key, without keys that the newest time seen leaves ``days`` behind: each batch drops them from the state, and a key that comes back later starts anew."""
    kind = stream.schema[key].dataType.simpleString()

    def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
        rows = state.unionByName(batch.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("newest")))
        top = rows.agg(F.unix_timestamp(F.max("newest"))).first()[0] or 0
        return rows.groupBy(key).agg(F.min("first").alias("first"), F.max("newest").alias("newest")).where(F.unix_timestamp("newest") >= top - days * 86400)

    return run_batches(stream, merge, f"{key} {kind}, first timestamp, newest timestamp", "first-seen", root)


def verdict_stream(stream: DataFrame, starts: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """Counts per key and verdict over the stream; late and future rows are counted, not dropped unseen."""
    kind = stream.schema[key].dataType.simpleString()

    def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.join(starts, key).groupBy(key, window_verdict(F.col(at), F.col("start"), now).alias("verdict")).agg(F.count("*").alias("n"))
        return state.unionByName(new).groupBy(key, "verdict").agg(F.sum("n").alias("n"))

    return run_batches(stream, merge, f"{key} {kind}, verdict string, n long", "verdicts")


def dedup_stream(stream: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """First rows of keys as they arrive; a key is remembered for ``ttl`` of event time."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def stream_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-only stream to its end into a table of the shared folder."""
    spark = stream.sparkSession
    root = new_path(spark, name)
    stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def pending_retries(pending: DataFrame, tried: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(still pending, dropped): pending (id, retries) after outcomes (id, ok); one more retry each, dropped past ``most``."""
    after = pending.join(tried.groupBy("id").agg(F.bool_or("ok").alias("ok")), "id", "left").where(~F.coalesce("ok", F.lit(False)))
    after = after.withColumn("retries", F.col("retries") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)).drop("ok")
    return after.where(F.col("retries") <= most), after.where(F.col("retries") > most).withColumn("reason", F.lit("too many retries"))
