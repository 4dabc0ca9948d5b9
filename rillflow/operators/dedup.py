"""First-wins de-duplication by event id in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import DEDUP_TTL


def first_arrivals(events: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """The row of smallest ``order`` for each key.

    A partial aggregate keeps one row a key and task before the exchange, so a
    key that holds a large share of the rows costs no more than others.
    """
    rows = F.struct(F.col(order).alias("_order"), *[F.col(c) for c in events.columns])
    return events.groupBy(F.col(key).alias("_key")).agg(F.min_by(rows, F.col(order)).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in events.columns])


def new_arrivals(events: DataFrame, seen: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """First arrivals whose key is in no earlier batch."""
    return first_arrivals(events, key, order).join(seen.select(key), key, "left_anti")


def within_watermark(stream: DataFrame, key: str = "event_id", time: str = "event_time", horizon: str = DEDUP_TTL) -> DataFrame:
    """Streaming form: a key's repeats within ``horizon`` of event time are dropped."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
