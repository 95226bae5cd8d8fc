"""Pipeline events as streams: counts in windows, and each notice once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Files of events as they arrive in a folder; times are UTC."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(stage, start, n, failures, total) of closed windows; events later than `late` behind the newest are left out."""
    seen = events.withWatermark("ts", late)
    counts = seen.groupBy(F.window("ts", length), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return counts.select("stage", F.col("window.start").alias("start"), "n", "failures", "total")


def notices(events: DataFrame, late: str = "30 days") -> DataFrame:
    """The first event of each (user, stage) within the lateness, so nobody is told twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select(F.col("event_id").alias("run"), F.col("user_id").alias("owner"), F.col("event_type").alias("stage"), "ts")


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, writes Parquet with exactly-once file commits, and stops."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
