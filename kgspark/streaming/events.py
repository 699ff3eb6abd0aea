"""Event streams: windows and sessions with late data, and merges into a table by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Parquet files of events as they arrive, a bounded number at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by type and window; a window closes once the watermark has passed it."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's events without a pause as long as the gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """Each key once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def merge_into(folder: str, keys: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the newest row of each key in ``folder``, a version for each batch.

    A version is the last one merged with the batch and written beside it, so a
    batch that runs again after a failure gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}").unionByName(batch)
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(newest), *[F.desc(c) for c in batch.columns if c not in (*keys, newest)]))
        rows.withColumn("_k", rank).where("_k = 1").drop("_k").write.mode("overwrite").parquet(f"{folder}/version={number}")

    return merge
