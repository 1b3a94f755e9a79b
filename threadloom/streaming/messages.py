"""Streams of messages: imports without repeats, bursts as sessions, activity by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_repeats(stream: DataFrame, key: str = "message_id", time: str = "timestamp", late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within `late`; older state goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, keys: tuple[str, ...], gap: str, minimum: int, time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Runs of an actor's messages with no pause over gap, of `minimum` messages or more. A session has no greatest length, unlike a burst's window."""
    rows = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("message_count"))
    return rows.where(F.col("message_count") >= minimum).select(*keys, F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), "message_count")


def activity(stream: DataFrame, by: str, window: str, time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Messages by window and group."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("message_count"))
    return rows.select(by, F.col("window.start").alias("window_start"), "message_count")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into Parquet; run again, it goes on where it stopped."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch to merge(batch, batch_id), which must be safe to repeat."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregate over all that is there now; path has its rows as of the last batch, open windows too."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
