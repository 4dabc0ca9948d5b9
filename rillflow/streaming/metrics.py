"""What a running query reports: micro-batches, checkpoint writes, and how far it is behind its sources."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

CHECKPOINT_STEPS = ("walCommit", "commitOffsets")  # parts of a micro-batch that write its checkpoint
BATCHES = "query string, batch long, at string, rows long, duration_ms long, checkpoint_ms long, rows_per_second double"
LAGS = "source string, partition int, end_offset long, latest_offset long"


def batch_rows(progress: dict) -> list[tuple]:
    """One row of a progress report."""
    took = progress.get("durationMs") or {}
    return [(progress.get("name") or str(progress.get("id")), progress["batchId"], progress.get("timestamp"), progress.get("numInputRows") or 0, took.get("triggerExecution", 0), sum(took.get(k, 0) for k in CHECKPOINT_STEPS), float(progress.get("processedRowsPerSecond") or 0))]


def lag_rows(progress: dict) -> list[tuple]:
    """Where each partition of each source with offsets by partition was read to, and where it ends."""
    found = []
    for source in progress.get("sources", []):
        ends, latest = (json.loads(x) if isinstance(x := source.get(k), str) and x.startswith("{") else x for k in ("endOffset", "latestOffset"))
        for topic, parts in (ends.items() if isinstance(ends, dict) else ()):
            if isinstance(parts, dict):
                last = (latest or {}).get(topic, {})
                found += [(topic, int(p), int(end), int(last.get(p, end))) for p, end in sorted(parts.items())]
    return found


class ProgressLog(StreamingQueryListener):
    """Keeps the last reports of all queries of a session it is added to (``spark.streams.addListener``)."""

    def __init__(self, most: int = 10_000):
        self.reports: deque[dict] = deque((), most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.reports.append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def batches(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for p in list(self.reports) for r in batch_rows(p)], BATCHES)

    def lags(self, spark: SparkSession) -> DataFrame:
        """Of each query's last report."""
        last = {p["id"]: p for p in list(self.reports)}
        return spark.createDataFrame([r for p in last.values() for r in lag_rows(p)], LAGS)


def progress(query: StreamingQuery, spark: SparkSession) -> DataFrame:
    """The query's recent micro-batches."""
    return spark.createDataFrame([r for p in query.recentProgress for r in batch_rows(json.loads(p.json) if hasattr(p, "json") else dict(p))], BATCHES)


def lag(offsets: DataFrame) -> DataFrame:
    """Adds ``lag`` to rows with end_offset and latest_offset."""
    return offsets.withColumn("lag", F.greatest(F.col("latest_offset") - F.col("end_offset"), F.lit(0).cast("long")))


def total_lag(offsets: DataFrame) -> DataFrame:
    """One row: partitions, the sums of their ends, and how many records are waiting."""
    return lag(offsets).agg(F.count("*").alias("partitions"), F.coalesce(F.sum("end_offset"), F.lit(0)).cast("long").alias("end_total"), F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("lag_total"))
