"""Anomalies on a stream: a state for each user, in the state store, that goes when the user has been idle for long.

A user's state is the event times of the last minute and the last 256 amounts.
A timer in event time, one a user, clears it ``idle`` after the user's latest
event, so the store holds the users of that stretch and not all users ever
seen; a user who comes back later begins anew.  The timer is only moved when
it fires, so a micro-batch reads and writes one value a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.anomaly import COLUMNS, DTYPES, SCHEMA, UserState
from ..workers import importable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
STATE = "times array<bigint>, amounts array<bigint>, latest bigint"
IDLE, DELAY = "7 days", "1 minute"


class Anomalies(StatefulProcessor):
    """Both anomalies of a user's events, those of a micro-batch in order of ``o``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("user", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.state.get()
        times, amounts, latest = before if before is not None else ((), (), None)
        user, arrived, found = UserState(times, amounts), [], []
        for some in rows:  # of a user's rows only what an anomaly needs is kept until all are there to be ordered
            arrived += zip(some["o"].tolist(), some["ts"].tolist(), some["amount"].tolist(), some["event_id"].tolist(), strict=True)
        for _, ts, amount, event_id in sorted(arrived):
            found += user.arrive(event_id, key[0], ts, amount)
        newest = max(ts for _, ts, _, _ in arrived)
        if latest is None:
            self.handle.registerTimer(newest + self.idle_ms)
        self.state.update((list(user.times.ordered), list(user.amounts.arrived), newest if latest is None else max(latest, newest)))
        if found:
            yield pd.DataFrame(found, columns=COLUMNS).astype(DTYPES)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = self.state.get()[2] + self.idle_ms
        if until > expiredTimerInfo.getExpiryTimeInMs():  # there have been events since
            self.handle.registerTimer(until)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def anomalies(stream: DataFrame, user: str = "user_id", time_ms: str = "ts_ms", order: str = "seq", idle: str = IDLE, delay: str = DELAY) -> DataFrame:
    """Both anomalies of each user's events, a micro-batch's events in order of ``order``.

    Events over ``delay`` behind the latest of the micro-batches before are
    dropped by the stream's watermark; what the job calls late is nearer.
    """
    spark = stream.sparkSession
    importable(spark)
    spark.conf.set(PROVIDER, ROCKS_DB)  # the only store that has timers
    spark.conf.set(CHANGES, "true")  # a micro-batch stores what it changed, not the store as a whole
    rows = stream.select(F.col("event_id").cast("string").alias("event_id"), F.col(user).cast("string").alias("user_id"), F.col(time_ms).alias("ts"), "amount", F.col(order).alias("o"), F.timestamp_millis(time_ms).alias("at"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("at", delay).groupBy("user_id").transformWithStateInPandas(Anomalies(idle_ms), SCHEMA, "Append", "EventTime")
