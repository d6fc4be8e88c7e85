"""Streams: text files as they arrive become pages, and timed rows become windowed counts. An extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, tokenise


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """path, page_no, page_text, arrived of text files dropped into a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    pages = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode(F.split("value", "\f")).alias("page_no", "page_text"))
    return pages.select("path", (F.col("page_no") + 1).alias("page_no"), clean(F.col("page_text")).alias("page_text"), "arrived")


def arrivals(pages: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pages and words per window of arrival; state is kept only as long as late rows are waited for."""
    return pages.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size(tokenise(F.col("page_text")))).alias("words"))


def event_windows(events: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """window_start, event_type, events, total of timed events; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Writes all that is there now and ends; a later call goes on where this one stopped."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
