"""Per-user anomalies in arrival order: velocity and amounts above the rolling 99th percentile.

All forms split a user's history, so that one user may hold any share of the
rows: velocity by minutes, each with the minute before as context; amounts by
runs of consecutive events, each with the 256 before; arrivals in any order by
runs, each begun from the state that the runs before it leave.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..folders import scratch, stored
from ..schema import HISTORY_LEAST, HISTORY_ROWS, QUANTILE, VELOCITY_THRESHOLD, VELOCITY_WINDOW_MS
from ..workers import importable

RUN = 2048  # consecutive events of a user in one part
CHUNK = 50_000  # arrivals in one part when events are numbered
STRETCH = 32  # runs whose ends one task goes through in order


def velocity_counts(events: DataFrame, user: str = "user_id", time_ms: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Adds ``transaction_count``: a user's events of the last 60 s up to each, for arrivals in order of time."""
    minute = F.floor(F.col(time_ms) / VELOCITY_WINDOW_MS)
    parts = events.withColumn("_part", F.explode(F.array(minute, minute + 1))).withColumn("_own", F.col("_part") == minute)
    w = W.partitionBy(user, "_part").orderBy(time_ms)
    so_far = F.row_number().over(W.partitionBy(user, "_part").orderBy(time_ms, order))
    too_old = F.count("*").over(w.rangeBetween(W.unboundedPreceding, -VELOCITY_WINDOW_MS - 1))
    return parts.withColumn("transaction_count", (so_far - too_old).cast("long")).where("_own").drop("_part", "_own")


def velocity(events: DataFrame, user: str = "user_id", time_ms: str = "ts_ms", order: str = "seq") -> DataFrame:
    return velocity_counts(events, user, time_ms, order).where(F.col("transaction_count") > VELOCITY_THRESHOLD)


def numbered(events: DataFrame, user: str, order: str) -> DataFrame:
    """Adds ``_at``: each event's number among its user's, from 0, in two levels."""
    parts = events.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    counts = parts.groupBy(user, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(user).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(user, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(user, "_chunk").orderBy(order)
    return parts.join(counts, [user, "_chunk"]).withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1).drop("_chunk", "_before")


class RecentAmounts:
    """A user's last amounts, at most 256, in order of arrival and in order of size."""

    def __init__(self, amounts: Iterable[int] = ()):
        self.arrived = deque(amounts, HISTORY_ROWS)
        self.ordered = sorted(self.arrived)

    def quantile(self) -> float | None:
        """The 99th percentile between neighbours, from 20 amounts on."""
        if len(self.ordered) < HISTORY_LEAST:
            return None
        rank = (len(self.ordered) - 1) * QUANTILE
        whole = math.floor(rank)
        low, high = self.ordered[whole : whole + 2]  # the rank of a quantile below 1 has one above it
        return low + (high - low) * (rank - whole)

    def add(self, amount: int) -> None:
        if len(self.arrived) == HISTORY_ROWS:
            del self.ordered[bisect_left(self.ordered, self.arrived[0])]
        self.arrived.append(amount)
        insort(self.ordered, amount)


class RecentTimes:
    """A user's event times of the last minute, as each arrival leaves them.

    What is over 60 s before an arrival is forgotten for good; later times
    stay, so late arrivals count against what is left.
    """

    def __init__(self, times: Iterable[int] = ()):
        self.ordered = sorted(times)

    def forget(self, before: int) -> None:
        del self.ordered[: bisect_left(self.ordered, before)]

    def add(self, ts: int) -> int:
        """How many there are with this one."""
        self.forget(ts - VELOCITY_WINDOW_MS)
        insort(self.ordered, ts)
        return len(self.ordered)


TOP = 1 + math.ceil((HISTORY_ROWS - 1) * (1 - QUANTILE))  # of the largest amounts; the quantile lies between two of them
ROWS_AT_ONCE = 4096


def _rolling(amounts_: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The quantile of the ``size`` amounts before each place, NaN below 20; for many places at once.

    ``amounts_`` has the ``HISTORY_ROWS`` places before the first one as well,
    so that each place has a row of as many, of which the newest count.
    """
    found = np.full(len(size), np.nan)
    rows = np.lib.stride_tricks.sliding_window_view(amounts_, HISTORY_ROWS)
    told = np.flatnonzero(size >= HISTORY_LEAST)
    for i in range(0, len(told), ROWS_AT_ONCE):
        at = told[i : i + ROWS_AT_ONCE]
        n = size[at]
        history = np.where(np.arange(HISTORY_ROWS) >= (HISTORY_ROWS - n)[:, None], rows[at], -np.inf)
        top = np.sort(np.partition(history, HISTORY_ROWS - TOP, axis=1)[:, -TOP:], axis=1)
        rank = (n - 1) * QUANTILE
        whole = np.floor(rank).astype(np.int64)
        place, each = TOP - (n - whole), np.arange(len(at))
        low = top[each, place]
        found[at] = low + (top[each, place + 1] - low) * (rank - whole)
    return found


def amount_quantiles(events: DataFrame, user: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds ``history_size`` and, from 20 earlier amounts on, ``rolling_99th_percentile`` of at most 256.

    Runs lie one after the other in a partition; a batch of rows is worked on
    as a whole, with the last amounts of the rows before it.
    """
    importable(events.sparkSession)
    at, names = F.col("_at"), events.columns
    run = F.floor(at / RUN)
    next_too = F.when(at % RUN >= RUN - HISTORY_ROWS, F.array(run, run + 1)).otherwise(F.array(run))
    parts = numbered(events, user, order).withColumn("_run", F.explode(next_too)).withColumn("_own", F.col("_run") == run)
    who, amount = names.index(user), names.index("amount")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail = None, np.zeros(0)  # of the run that a batch ends in
        for batch in it:
            n, own, values = len(names), batch.column(len(names) + 1), batch.column(amount)
            if not batch.num_rows:
                continue
            users, runs = batch.column(who), batch.column(n)
            changes = np.ones(batch.num_rows, bool)
            changes[0] = (users[0].as_py(), runs[0].as_py()) != key
            if batch.num_rows > 1:
                same = pc.and_(pc.equal(runs.slice(1), runs.slice(0, batch.num_rows - 1)), _equal(users.slice(1), users.slice(0, batch.num_rows - 1)))
                changes[1:] = ~same.to_numpy(zero_copy_only=False)
            key = users[-1].as_py(), runs[-1].as_py()
            there = values.is_valid().to_numpy(zero_copy_only=False)  # a row without an amount adds nothing
            before = np.cumsum(there) - there + len(tail)  # amounts before each row, with the run's from earlier batches
            begin = np.maximum.accumulate(np.where(changes, before, 0))
            size = np.minimum(before - begin, HISTORY_ROWS)
            amounts_ = np.concatenate([tail, values.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)])
            asked = np.where(own.to_numpy(zero_copy_only=False), size, 0)
            # rows of equal ``before`` have one window; the windows that end at each are taken by their places
            found = _rolling_at(amounts_, before, asked)
            tail = amounts_[max(int(begin[-1]), len(amounts_) - HISTORY_ROWS) :]
            kept = batch.select(range(n)).filter(own)
            mine = own.to_numpy(zero_copy_only=False)
            columns = pa.array(size[mine].astype(np.int32)), pa.array(found[mine], from_pandas=True)
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*names, "history_size", "rolling_99th_percentile"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", history_size int, rolling_99th_percentile double"
    dealt = parts.select(*names, "_run", "_own", "_at").repartition(user, "_run").sortWithinPartitions(user, "_run", "_at")
    return dealt.mapInArrow(batches, schema)


def _equal(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether values are equal, nulls as well."""
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))


def _rolling_at(amounts_: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The quantile of the ``size`` amounts that end ahead of place ``before`` of ``amounts_``."""
    by_place = np.zeros(len(amounts_) + 1, np.int64)
    by_place[before] = np.maximum(by_place[before], size)  # rows of one place have one size, or 0 where nobody asks
    np.maximum.at(by_place, before, size)
    padded = np.concatenate([np.zeros(HISTORY_ROWS), amounts_])
    return np.where(size > 0, _rolling(padded, by_place)[before], np.nan)


def amounts(events: DataFrame, user: str = "user_id", order: str = "seq") -> DataFrame:
    return amount_quantiles(events, user, order).where(F.col("amount") > F.col("rolling_99th_percentile"))


def union_of(velocity_rows: DataFrame, amount_rows: DataFrame, user: str = "user_id") -> DataFrame:
    """Both kinds in one sparse shape."""
    null = lambda kind: F.lit(None).cast(kind)
    first = velocity_rows.select(
        F.lit("ANOMALY_VELOCITY").alias("anomaly_type"), "event_id", F.col(user).alias("user_id"), "transaction_count",
        F.lit(VELOCITY_WINDOW_MS // 1000).alias("velocity_window_seconds"), F.lit(VELOCITY_THRESHOLD).cast("long").alias("velocity_threshold"),
        null("long").alias("amount"), null("double").alias("rolling_99th_percentile"), null("int").alias("history_size"),
    )
    second = amount_rows.select(
        F.lit("ANOMALY_AMOUNT").alias("anomaly_type"), "event_id", F.col(user).alias("user_id"), null("long").alias("transaction_count"),
        null("int").alias("velocity_window_seconds"), null("long").alias("velocity_threshold"), "amount", "rolling_99th_percentile", "history_size",
    )
    return first.unionByName(second)


class UserState:
    """What one user's past arrivals come to."""

    def __init__(self, times: Iterable[int] = (), amounts: Iterable[int] = ()):
        self.times, self.amounts = RecentTimes(times), RecentAmounts(amounts)

    def arrive(self, event_id, user_id, ts: int, amount: int) -> list[tuple]:
        """The anomalies that one event raises, velocity first."""
        count, limit, size = self.times.add(ts), self.amounts.quantile(), len(self.amounts.ordered)
        self.amounts.add(amount)
        found = []
        if count > VELOCITY_THRESHOLD:
            found.append(("ANOMALY_VELOCITY", event_id, user_id, count, VELOCITY_WINDOW_MS // 1000, VELOCITY_THRESHOLD, None, None, None))
        if limit is not None and amount > limit:
            found.append(("ANOMALY_AMOUNT", event_id, user_id, None, None, None, amount, limit, size))
        return found


def _run_ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run: its largest time, the times it leaves to the next, and its last amounts."""
    key, state, top, out = None, UserState(), 0, []

    def row() -> tuple:
        return (*key, top, list(state.times.ordered), list(state.amounts.arrived))

    for batch in it:
        for u, r, ts, amount in zip(*(batch.column(c).to_pylist() for c in ("user_id", "_run", "ts", "amount")), strict=True):
            if (u, r) != key:
                if key is not None:
                    out.append(row())
                key, state, top = (u, r), UserState(), ts
            state.times.add(ts)
            state.amounts.add(amount)
            top = max(top, ts)
        if out:
            yield _record(out, ENDS)
            out = []
    if key is not None:
        yield _record([row()], ENDS)


def _after(state: tuple, end: tuple) -> tuple:
    """What a stretch of runs (largest time, times left, last amounts) comes to with the stretch behind it; it doesn't matter which are put together first."""
    (top, times, last), (top_, times_, last_) = state, end
    top = top_ if top is None else top if top_ is None else max(top, top_)
    kept = times if top_ is None else times[bisect_left(times, top_ - VELOCITY_WINDOW_MS) :]
    return top, sorted([*kept, *times_]), [*last, *last_][-HISTORY_ROWS:]


NOTHING = (None, [], [])


def _stretches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run or stretch what those of its own stretch before it come to, and of each stretch (_run null) all of it."""
    key, state = None, NOTHING
    for batch in it:
        out = []
        for u, g, r, top, left, last in zip(*(batch.column(c).to_pylist() for c, _ in STRETCHES), strict=True):
            if (u, g) != key:
                if key is not None:
                    out.append((*key, None, *state))
                key, state = (u, g), NOTHING
            out.append((u, g, r, *state))
            state = _after(state, (top, left, last))
        yield _record(out, STRETCHES)
    if key is not None:
        yield _record([(*key, None, *state)], STRETCHES)


def _put_together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stretches before a stretch come to, with what is before a run inside it."""
    names = [c for c, _ in ENDS[2:]]
    for batch in it:
        ahead, inside = (zip(*(batch.column(c).to_pylist() for c in some), strict=True) for some in ([f"_{c}" for c in names], names))
        out = [(u, r, *_after((t, x or [], y or []), b)) for u, r, (t, x, y), b in zip(batch.column("user_id").to_pylist(), batch.column("_run").to_pylist(), ahead, inside, strict=True)]
        yield _record(out, ENDS)


def _starts(ends: DataFrame) -> DataFrame:
    """The state that each run begins with, from the ends of the runs before it.

    ``STRETCH`` runs of a user are gone through in one task, and what they
    come to is gone through in the same way, so a user may have any number of
    runs.
    """
    dealt = ends.withColumn("_group", F.floor(F.col("_run") / STRETCH)).select(*[c for c, _ in STRETCHES])
    dealt = dealt.repartition("user_id", "_group").sortWithinPartitions("user_id", "_group", "_run")
    both = dealt.mapInArrow(_stretches, _schema(STRETCHES))
    if (ends.agg(F.max("_run")).first()[0] or 0) < STRETCH:
        return both.where("_run is not null").drop("_group")
    path = scratch(ends.sparkSession, "stretches")
    both.write.parquet(path)
    both = ends.sparkSession.read.schema(both.schema).parquet(path)
    ahead = _starts(both.where("_run is null").drop("_run").withColumnRenamed("_group", "_run"))
    ahead = ahead.select(F.col("user_id").alias("_user"), F.col("_run").alias("_nth"), *[F.col(c).alias(f"_{c}") for c, _ in ENDS[2:]])
    joined = both.where("_run is not null").join(ahead, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_group") == F.col("_nth")))
    return joined.mapInArrow(_put_together, _schema(ENDS))


def _found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, UserState()
    for batch in it:
        out = []
        for u, r, ts, amount, event_id, times, amounts in zip(*(batch.column(c).to_pylist() for c in ("user_id", "_run", "ts", "amount", "event_id", "times", "amounts")), strict=True):
            if (u, r) != key:  # a run's first row brings its start
                key, state = (u, r), UserState(times or (), amounts or ())
            out += state.arrive(event_id, u, ts, amount)
        yield _record(out, FOUND)


def in_arrival_order(events: DataFrame, user: str = "user_id", time_ms: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Both anomalies exactly as a sequential engine finds them, whatever the order of arrival.

    A time outlives a run if no later one in it is over 60 s above; so a run
    comes down to its largest time, the times that outlive it and its last
    256 amounts.  Those are put together in a tree, and then all runs go
    through their rows at once.
    """
    importable(events.sparkSession)
    rows = events.select(F.col("event_id").cast("string").alias("event_id"), F.col(user).cast("string").alias("user_id"), F.col(time_ms).cast("long").alias("ts"), F.col("amount").cast("long").alias("amount"), F.col(order).alias("o"))
    placed = numbered(rows, "user_id", "o").withColumn("_run", F.floor(F.col("_at") / RUN)).select("user_id", "_run", "_at", "ts", "amount", "event_id")
    dealt = stored(placed, "placed").repartition("user_id", "_run")  # gone through twice, and what is before it may cost much
    path = scratch(events.sparkSession, "runs")
    dealt.select("user_id", "_run", "_at", "ts", "amount").sortWithinPartitions("user_id", "_run", "_at").mapInArrow(_run_ends, _schema(ENDS)).write.parquet(path)
    begun = _starts(events.sparkSession.read.schema(_schema(ENDS)).parquet(path)).where("_run > 0").select(F.col("user_id").alias("_user"), F.col("_run").alias("_nth"), "times", "amounts")
    joined = dealt.join(begun, (F.col("user_id").eqNullSafe(F.col("_user"))) & (F.col("_run") == F.col("_nth")) & (F.col("_at") % RUN == 0), "left")
    sorted_ = joined.select("user_id", "_run", "_at", "ts", "amount", "event_id", "times", "amounts").sortWithinPartitions("user_id", "_run", "_at")
    return sorted_.mapInArrow(_found, SCHEMA)


COLUMNS = ["anomaly_type", "event_id", "user_id", "transaction_count", "velocity_window_seconds", "velocity_threshold", "amount", "rolling_99th_percentile", "history_size"]
DTYPES = {"transaction_count": "Int64", "velocity_window_seconds": "Int32", "velocity_threshold": "Int64", "amount": "Int64", "rolling_99th_percentile": "Float64", "history_size": "Int32"}
SCHEMA = "anomaly_type string, event_id string, user_id string, transaction_count long, velocity_window_seconds int, velocity_threshold long, amount long, rolling_99th_percentile double, history_size int"
ENDS = (("user_id", pa.string()), ("_run", pa.int64()), ("top", pa.int64()), ("times", pa.list_(pa.int64())), ("amounts", pa.list_(pa.int64())))
STRETCHES = (ENDS[0], ("_group", pa.int64()), *ENDS[1:])
FOUND = tuple(zip(COLUMNS, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True))


def _schema(columns: tuple) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{c} {names[t]}" for c, t in columns)


def _record(rows: list[tuple], columns: tuple) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], [c for c, _ in columns])
