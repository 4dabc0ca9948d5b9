"""Event time: running watermark, late routing, and the three classes of lateness.

The watermark after a record is the largest time so far less the allowed
disorder and one millisecond.  A record is ``late`` if it is over 45 s behind;
``dropped`` if its window has closed (it still counts as an event, but in no
aggregate); else ``on_time``.

Where records come from several partitions, each has a largest time of its own
and the watermark is that of the least one among the partitions that are
active: a partition that has brought nothing for 30 s of arrival is idle and
holds nothing back.  It never goes back, not even when an idle partition wakes.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import IDLE_AFTER_MS, LATE_AFTER_MS, OUT_OF_ORDER_MS, WINDOW_MS

CHUNK = 50_000  # arrivals in one part of the running maximum
SPAN = 20_000  # chunks whose totals one task goes through


def before_chunks(totals: DataFrame, values: dict[str, str], span: int = SPAN) -> DataFrame:
    """_chunk and, for each name of ``values``, the largest of its column in all chunks ahead; null if there is none.

    ``totals`` has one row a chunk.  Inside spans of chunks and over the spans'
    largest, so that no window holds more than a span's rows or one row a span:
    a thousand for 10^12 arrivals.
    """
    spans = totals.withColumn("_span", F.floor(F.col("_chunk") / span))
    inside, over = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.partitionBy("_span").orderBy("_chunk"), W.orderBy("_span")))
    tops = spans.groupBy("_span").agg(*[F.max(v).alias(f"_top{n}") for n, v in values.items()])
    tops = tops.select("_span", *[F.max(f"_top{n}").over(over).alias(f"_above{n}") for n in values])
    held = spans.withColumns({f"_in{n}": F.max(v).over(inside) for n, v in values.items()})
    return held.join(F.broadcast(tops), "_span").select("_chunk", *[F.greatest(f"_above{n}", f"_in{n}").alias(n) for n in values])  # a row a span


def running_max(events: DataFrame, value: str, order: str, name: str, chunk: int = CHUNK, carry: int | None = None) -> DataFrame:
    """Adds the largest ``value`` so far in order of ``order``.

    A running maximum inside chunks of consecutive arrivals, and those over the
    chunks' maxima, so no task has to hold all rows.
    """
    parts = events.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = before_chunks(parts.groupBy("_chunk").agg(F.max(value).alias("_top")), {"_before": "_top"})
    inside = W.partitionBy("_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    floor = [] if carry is None else [F.lit(carry)]
    top = F.greatest(F.max(value).over(inside), F.col("_before"), *floor)  # nulls don't count
    return parts.join(tops, "_chunk").withColumn(name, top).drop("_chunk", "_before")


def with_watermark_ms(events: DataFrame, time_ms: str = "ts_ms", order: str = "seq", carry: int | None = None) -> DataFrame:
    """Adds ``watermark_ms`` as it stands after each record; ``carry`` is the largest time before these."""
    topped = running_max(events, time_ms, order, "_max", carry=carry)
    return topped.withColumn("watermark_ms", F.col("_max") - OUT_OF_ORDER_MS - 1).drop("_max")


@dataclass
class PartitionClock:
    """Where the watermark stands: of each partition that is known its largest time (None before its first record) and last arrival, and the watermark.

    ``partitions`` of a new clock are known from the first arrival on, so one
    that never brings a record holds the watermark back until it is idle.
    """

    partitions: int
    tops: dict[int, int] = field(default_factory=dict)
    arrivals: dict[int, int] = field(default_factory=dict)
    watermark_ms: int | None = None
    began_ms: int | None = None

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, found: dict | None) -> PartitionClock:
        """From ``as_dict``, also by way of JSON."""
        if not found:
            return cls(0)
        numbered = {k: {int(p): x for p, x in found[k].items()} for k in ("tops", "arrivals")}
        return cls(found["partitions"], **numbered, watermark_ms=found["watermark_ms"], began_ms=found["began_ms"])


def _least_active(top: list[Column], arrival: list[Column], now: Column, idle_ms: int) -> Column:
    """The least largest time among the active partitions; null if one of them has none yet.

    Partitions become idle one after the other; once all are, what the last
    ones to do so had reached stays.  So those count that have been heard of
    after the idle time's beginning, or else last of all.
    """
    newest = reduce(lambda a, b: F.greatest(a, b), arrival)
    heard = F.least(now - idle_ms, newest - 1)
    active = F.array_compact(F.array(*[F.when(a > heard, F.struct(t.alias("top"))) for t, a in zip(top, arrival, strict=True)]))
    held = F.exists(active, lambda p: p["top"].isNull())
    return F.when(~held, F.array_min(F.transform(active, lambda p: p["top"])))


def with_partition_watermark_ms(
    events: DataFrame, clock: PartitionClock, time_ms: str = "ts_ms", order: str = "seq", partition: str = "partition", arrival_ms: str = "arrival_ms", idle_ms: int = IDLE_AFTER_MS, chunk: int = CHUNK
) -> DataFrame:
    """Adds ``watermark_ms`` as it stands after each record, from the clock before the first; null while a partition that is active has brought nothing.

    Each partition's largest time and last arrival run on over chunks, and so
    does the watermark over what they come to.  What partitions that fell idle
    since the record before let through counts as well.
    """
    known, nothing = range(clock.partitions), F.lit(None).cast("long")
    began = F.lit(clock.began_ms).cast("long") if clock.began_ms is not None else F.col("_began")
    rows = events.withColumn("_chunk", F.floor(F.col(order) / chunk))
    values = {f"_t{p}": F.when(F.col(partition) == p, F.col(time_ms)) for p in known} | {f"_a{p}": F.when(F.col(partition) == p, F.col(arrival_ms)) for p in known}
    carried = {f"_t{p}": clock.tops.get(p) for p in known} | {f"_a{p}": clock.arrivals.get(p) for p in known}
    sums = rows.groupBy("_chunk").agg(*[F.max(v).alias(k) for k, v in values.items()], F.min(arrival_ms).alias("_first"))  # one row a chunk
    joined = rows.join(before_chunks(sums, {f"_before{k}": k for k in values}), "_chunk")
    if clock.began_ms is None:
        joined = joined.join(F.broadcast(sums.agg(F.min("_first").alias("_began"))), F.lit(True))  # one row
    own = W.partitionBy("_chunk").orderBy(order)
    upto, ahead = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, -1)

    def state(name: str, frame) -> Column:
        return F.greatest(F.max(values[name]).over(frame), F.col(f"_before{name}"), F.lit(carried[name]).cast("long") if carried[name] is not None else nothing)

    names = {**{f"{k}{side}": state(k, frame) for k in values for side, frame in (("n", upto), ("p", ahead))}}
    told = joined.select(*events.columns, "_chunk", began.alias("_began"), *[c.alias(k) for k, c in names.items()])
    lows = []
    for side in ("p", "n"):
        tops = [F.col(f"_t{p}{side}") for p in known]
        arrivals = [F.coalesce(f"_a{p}{side}", "_began") for p in known]
        lows.append(_least_active(tops, arrivals, F.col(arrival_ms), idle_ms))
    told = told.select(*events.columns, F.greatest(*lows).alias("_low"))
    carry = None if clock.watermark_ms is None else clock.watermark_ms + OUT_OF_ORDER_MS + 1
    topped = running_max(told, "_low", order, "_max", chunk, carry)
    return topped.withColumn("watermark_ms", F.col("_max") - OUT_OF_ORDER_MS - 1).drop("_low", "_max")


def advanced(clock: PartitionClock, marked: DataFrame, time_ms: str = "ts_ms", partition: str = "partition", arrival_ms: str = "arrival_ms") -> PartitionClock:
    """The clock after the records that ``with_partition_watermark_ms`` marked; one row a partition comes to the driver."""
    found = marked.groupBy(partition).agg(F.max(time_ms).alias("top"), F.max(arrival_ms).alias("arrival"), F.min(arrival_ms).alias("first"), F.max("watermark_ms").alias("mark")).collect()
    most = lambda a, b: b if a is None else a if b is None else max(a, b)
    tops, arrivals, mark, began = dict(clock.tops), dict(clock.arrivals), clock.watermark_ms, clock.began_ms
    for r in found:
        p = r[partition]
        tops[p], arrivals[p], mark = most(tops.get(p), r["top"]), most(arrivals.get(p), r["arrival"]), most(mark, r["mark"])
    if began is None and found:
        began = min(r["first"] for r in found)
    return PartitionClock(max([clock.partitions, *(p + 1 for p in tops)]), tops, arrivals, mark, began)


def window_start(time_ms: Column, size: int = WINDOW_MS) -> Column:
    return (F.floor(time_ms / size) * size).cast("long")


def lateness(time_ms: str = "ts_ms") -> Column:
    """Class of each record with a watermark."""
    ts, wm = F.col(time_ms), F.col("watermark_ms")
    return F.when(wm.isNull(), "on_time").when(wm - ts > LATE_AFTER_MS, "late").when(window_start(ts) + (WINDOW_MS - 1) <= wm, "dropped").otherwise("on_time")


def classified(events: DataFrame, time_ms: str = "ts_ms", order: str = "seq", carry: int | None = None) -> DataFrame:
    """Adds ``watermark_ms`` and ``lateness``."""
    return with_watermark_ms(events, time_ms, order, carry).withColumn("lateness", lateness(time_ms))


def classified_by_partition(events: DataFrame, clock: PartitionClock, time_ms: str = "ts_ms", order: str = "seq", **columns) -> DataFrame:
    """``classified`` by the watermark of the partitions."""
    return with_partition_watermark_ms(events, clock, time_ms, order, **columns).withColumn("lateness", lateness(time_ms))
