"""Tumbling windows per user: count, sum and mean of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import WINDOW_MS
from .eventtime import window_start


def aggregates(events: DataFrame, by: str = "user_id", time_ms: str = "ts_ms", size: int = WINDOW_MS) -> DataFrame:
    """One row a key and window that has events; partial sums before the exchange."""
    return finish(events.groupBy(by, window_start(F.col(time_ms), size).alias("window_start_ms")).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_volume")), size)


def merge(partials: DataFrame, by: str = "user_id", size: int = WINDOW_MS) -> DataFrame:
    """Adds up aggregates of the same key and window."""
    return finish(partials.groupBy(by, "window_start_ms").agg(F.sum("transaction_count").alias("transaction_count"), F.sum("total_volume").alias("total_volume")), size)


def finish(sums: DataFrame, size: int) -> DataFrame:
    mean = F.col("total_volume").cast("double") / F.col("transaction_count")
    return sums.withColumn("window_end_ms", F.col("window_start_ms") + size).withColumn("average_transaction_value", mean)


def parted(sums: DataFrame, watermark_ms: int | None, size: int = WINDOW_MS) -> tuple[DataFrame, DataFrame]:
    """Windows that the watermark has passed, and those that are open."""
    if watermark_ms is None:
        return sums.limit(0), sums
    over = F.col("window_start_ms") + (size - 1) <= watermark_ms
    return sums.where(over), sums.where(~over)


def closed(classified: DataFrame, by: str = "user_id", time_ms: str = "ts_ms", size: int = WINDOW_MS) -> DataFrame:
    """Windows of events on time that are over once all records have come: each as it is emitted, once, at its close."""
    mark = classified.agg(F.max("watermark_ms").alias("mark"))  # one row
    sums = aggregates(classified.where("lateness = 'on_time'"), by, time_ms, size)
    return sums.join(F.broadcast(mark), F.col("window_start_ms") + (size - 1) <= F.col("mark")).drop("mark")
