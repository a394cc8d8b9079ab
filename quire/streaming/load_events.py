"""An append-only log of load events as a stream, and windows over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session_id string, event string, file_path string, load_reason string, source string, cwd string, ts string"


def read_log(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    """New lines of the log files of a directory; a line that is no JSON has nulls only."""
    return spark.readStream.schema(SCHEMA).options(mode="PERMISSIVE", **options).json(directory)


def reshaped(events: DataFrame) -> DataFrame:
    """Six fields of each event; the reason falls back to the source, the time is parsed."""
    return events.select("session_id", "event", "file_path", F.coalesce("load_reason", "source").alias("load_reason"), "cwd", F.try_to_timestamp("ts").alias("ts"))


def compactions(events: DataFrame) -> DataFrame:
    return events.filter("event = 'SessionStart' AND load_reason = 'compact'")


def append(events: DataFrame, path: str, checkpoint: str):
    """A query that appends the events as JSON lines, exactly once."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Beyond the log: events by window and type, each event once within the delay."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
