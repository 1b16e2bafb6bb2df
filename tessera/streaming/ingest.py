"""Streams of new filings and of run events, on the same operators as the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.html import html_blocks


def file_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def block_stream(pages: DataFrame) -> DataFrame:
    """Blocks of each new page; pages are independent, so no state is kept."""
    return html_blocks(pages)


def latency_windows(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and maximum of `value` by type and event-time window; rows later than `late` are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Event sessions of each user, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def publish(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch once, under its own folder: a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
