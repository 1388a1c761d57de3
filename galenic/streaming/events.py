"""Change feeds and event windows on Structured Streaming; the windows are an extension of the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table as a stream of files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total; the same for a batch and, with a watermark, for a stream."""
    if late:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events with less than the gap between."""
    if late:
        events = events.withWatermark("ts", late)
    w = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Of each key the first event, as long as its time is within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def cascade(changes: DataFrame, dimension: DataFrame, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of a dimension's changes (key, active, ts), joined with the rows that depend on them, to the sink. Of
    several changes of a key within a batch the last counts; a batch that is tried again has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by("active", "ts").alias("__active"))
        sink(dimension.join(last, key).withColumn("active", F.col("active") & F.col("__active")).drop("__active"), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh(rows: DataFrame, stamp: str, now: str, days: int = 30) -> DataFrame:
    """Rows whose stamp, an ISO time in the JSON column `attributes`, is within so many days before now."""
    at = F.try_to_timestamp(F.get_json_object("attributes", f"$.{stamp}"))
    return rows.where(at > F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
