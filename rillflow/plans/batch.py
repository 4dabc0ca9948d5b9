"""The whole dataflow over a bounded set of raw records, as outputs that are computed as they are asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..folders import stored
from ..operators import anomaly, dedup, eventtime, validate, windows


class Outputs:
    """dead_letters, events, late, aggregates, anomalies.  What none of those asked for needs is not run.

    Classes of lateness read the events more than once, so these are kept in
    files: records are parsed and de-duplicated once for all three.
    """

    def __init__(self, judged: DataFrame, order: str):
        self._valid, self.dead_letters = validate.split(judged)
        self._order = order

    @cached_property
    def events(self) -> DataFrame:
        return dedup.first_arrivals(self._valid, order=self._order).withColumn("ts_ms", F.unix_millis("event_time"))

    @cached_property
    def _classes(self) -> DataFrame:
        return eventtime.classified(stored(self.events, "events"), order=self._order)

    @cached_property
    def late(self) -> DataFrame:
        return self._classes.where("lateness = 'late'")

    @cached_property
    def aggregates(self) -> DataFrame:
        return windows.aggregates(self._classes.where("lateness = 'on_time'"))

    @cached_property
    def anomalies(self) -> DataFrame:
        return anomaly.in_arrival_order(self._classes.where("lateness <> 'late'"), order=self._order)


def run(records: DataFrame, raw: str = "raw", order: str = "seq", strict: bool = True) -> Outputs:
    """Validate, de-duplicate, classify by lateness; events take in late ones, aggregates only those on time.

    Anomalies see what isn't late, in order of arrival.
    """
    return Outputs(validate.judged(records, raw, strict), order)
