"""The dataflow as Structured Streaming: one query from raw records to its sinks, one from events to anomalies.

Each micro-batch is validated, de-duplicated against earlier batches,
classified against the largest time seen so far, and written to all sinks.
What it takes in is published once and for good; every other write is keyed by
batch and derived from that, so a batch that is repeated after a failure
leaves the same tables.  A batch reads nothing of the batches before it but
the ids of the last minutes and one small record.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup, eventtime, validate, windows
from ..plans.reader import AnalyticsReader, Rows
from ..schema import ANOMALY_TYPES, DEDUP_TTL, OUT_OF_ORDER_MS, REQUIRED_FIELDS
from ..sinks.files import Ledger, children, exists, remove
from ..sinks.tables import KeyedTable, TopicWriter, append_batch, append_once, inspect, publish, read_appended, require, with_ids
from .stateful import anomalies

ACCEPTED = (
    "event_id string, user_id string, merchant_id string, amount bigint, currency string, transaction_type string, event_time timestamp, ingest_time timestamp, "
    "schema_version int, seq bigint, received_at timestamp, ts_ms bigint, watermark_ms bigint, lateness string, partition int, arrival_ms bigint"
)
PASSING = ("ts_ms", "watermark_ms", "lateness", "seq", "partition", "arrival_ms")  # of an accepted event, no columns of the table
FOUND = (
    "anomaly_id bigint, anomaly_type string, event_id string, user_id string, transaction_count bigint, velocity_window_seconds int, velocity_threshold bigint, amount bigint, "
    "rolling_99th_percentile double, history_size int, detected_at timestamp"
)
EPOCH = datetime.fromtimestamp(0, UTC)
BUCKET_S = 60  # seconds of arrival whose ids share a folder
OUTPUTS = ("dead_letters", "late", "aggregates")
SUMS = "user_id string, window_start_ms bigint, transaction_count bigint, total_volume bigint"


def with_seq(records: DataFrame) -> DataFrame:
    """Adds ``seq``, the order of arrival inside a micro-batch, where it is missing.

    Kafka's records go by the time at which its log took them, then partition
    and offset, so each partition keeps its order; without those times by
    offset, then partition; others by their place in the files.
    """
    if "seq" in records.columns:
        return records
    if {"partition", "offset"} <= set(records.columns):
        if "timestamp" in records.columns:
            return with_ids(records, "seq", ["timestamp", "partition", "offset"], first=0, parts=records.sparkSession.sparkContext.defaultParallelism)
        partitions = (records.agg(F.max("partition")).first()[0] or 0) + 1
        return records.withColumn("seq", F.col("offset") * partitions + F.col("partition"))
    return records.withColumn("seq", F.monotonically_increasing_id())


class StreamJob:
    """Sinks under ``out``: dead_letters, late, accepted and closed (appended by batch), events and aggregates (upserted by key), anomalies (by their ids).

    Aggregates show each window as it stands, closed shows each window once,
    with its final sums, in the batch after which the watermark has passed its
    end.  Records with a partition have the watermark of all partitions that
    are active; others that of one.

    Ids are remembered for ``remember`` of wall-clock time, so that a batch
    looks through a bounded stretch of history; an older repeat is still one
    row of events, though it counts in the aggregates again.  None remembers
    all.  ``topics`` names writers for any of dead_letters, late and
    aggregates; ``console`` prints some rows of each.
    """

    def __init__(self, spark: SparkSession, out: str, strict: bool = True, remember: str | None = DEDUP_TTL, topics: dict[str, TopicWriter] | None = None, console: bool = False):
        if unknown := set(topics or {}) - set(OUTPUTS):
            raise ValueError(f"no such output: {', '.join(sorted(unknown))}")
        self.spark, self.out, self.strict, self.topics, self.console = spark, out, strict, topics or {}, console
        self.remember_s = None if remember is None else int(pd.Timedelta(remember).total_seconds())
        self.events = KeyedTable(spark, f"{out}/events", ["event_id"], keep=["received_at"], stable=["user_id", "event_time"])
        self.windows = KeyedTable(spark, f"{out}/aggregates", ["user_id", "window_start_ms"], add=["transaction_count", "total_volume"], stable=["user_id", "window_start_ms"])
        self.found = KeyedTable(spark, f"{out}/anomalies", ["anomaly_id"], stable=["user_id", "detected_at"])
        self.ledger, self.anomaly_ledger = Ledger(spark, f"{out}/_progress"), Ledger(spark, f"{out}/_anomaly_progress")

    def _seen(self, batch: int, now_s: int) -> DataFrame | None:
        """Ids of earlier batches that are still remembered; folders of older ones are not even listed, and deleted."""
        least = 0 if self.remember_s is None else now_s - self.remember_s
        folders = []
        for name in children(self.spark, f"{self.out}/seen"):
            if name.startswith("minute="):
                begin = int(name[7:]) * BUCKET_S
                if begin + BUCKET_S >= least:
                    folders.append(f"{self.out}/seen/{name}")
                elif begin + 2 * BUCKET_S < least:
                    remove(self.spark, f"{self.out}/seen/{name}")
        if not folders:
            return None
        ids = self.spark.read.schema("event_id string, at_s bigint, minute bigint, batch_id bigint").option("basePath", f"{self.out}/seen").parquet(*folders)
        return ids.where((F.col("batch_id") < batch) & (F.col("at_s") >= least))

    def process(self, records: DataFrame, batch: int) -> None:
        """One micro-batch of records with column raw, and seq or partition and offset if there are any."""
        now = time.time()
        at = F.timestamp_micros(F.lit(int(now * 1e6)))
        judged = validate.judged(records.drop(*[f for f in (*REQUIRED_FIELDS, "received_at") if f in records.columns]), strict=self.strict)
        # texts are kept where they are told of; on disk, a batch of any size takes no memory to keep
        judged = judged.withColumn("raw_record", F.when(F.col("reason_code").isNotNull(), F.col("raw_record"))).persist(StorageLevel.DISK_ONLY)
        try:
            before = json.loads(self.ledger.get(below=batch) or "{}")
            clock = eventtime.PartitionClock.of(before.get("clock"))
            events, dead = validate.split(judged)
            accepting = lambda: self._accept(with_seq(events), judged, before, clock, batch, now)
            (reached, _) = _together(self.spark, accepting, lambda: append_batch(dead, f"{self.out}/dead_letters", batch))
            top, mark = (_most(before.get(k), reached[k]) for k in ("top", "mark"))
            taken = reached["taken"]
            stored = self.spark.read.schema(ACCEPTED).parquet(f"{self.out}/accepted/batch_id={batch}")  # computed once, for all that follows
            late = stored.where("lateness = 'late'")
            sums = windows.aggregates(stored.where("lateness = 'on_time'")).select("user_id", "window_start_ms", "transaction_count", "total_volume", at.alias("updated_at"))
            landed = require(stored.drop(*PASSING), not_null=["event_id", "user_id", "event_time"])
            _together(
                self.spark, lambda: self._remember(stored, batch), lambda: append_batch(late, f"{self.out}/late", batch), lambda: self.windows.upsert(sums, batch, known=taken),
                lambda: self._close(sums, batch, mark), lambda: self.events.upsert(landed, batch, known=taken),
            )
            for name, rows in zip(OUTPUTS, (dead, late.drop("watermark_ms", "lateness", "partition", "arrival_ms"), self._changed(sums)), strict=True):
                if name in self.topics:
                    self.topics[name].write(rows, batch)
                if self.console:
                    inspect(rows, name)
            if "partition" in records.columns:
                clock = eventtime.advanced(clock, stored)
            self.ledger.put(batch, json.dumps({"top": top, "mark": mark, "clock": clock.as_dict()}))
        finally:
            judged.unpersist()

    def _accept(self, events: DataFrame, judged: DataFrame, before: dict, clock: eventtime.PartitionClock, batch: int, now: float) -> dict:
        """Publishes what the batch takes in, unless that is there already; the largest time and watermark in it, and its number of rows."""
        target, reached = f"{self.out}/accepted", Observation()
        ends = F.max("ts_ms").alias("top"), F.max("watermark_ms").alias("mark"), F.count(F.lit(1)).alias("taken")
        if not exists(self.spark, f"{target}/batch_id={batch}"):
            seen = self._seen(batch, int(now))
            fresh = dedup.first_arrivals(events) if seen is None else dedup.new_arrivals(events, seen)
            fresh = fresh.withColumn("ts_ms", F.unix_millis("event_time")).withColumn("received_at", F.timestamp_micros(F.lit(int(now * 1e6))))
            rows = _typed(self._classified(fresh, before.get("top"), clock, judged, int(now * 1000)), ACCEPTED)
            if append_once(rows.observe(reached, *ends), target, batch):
                return reached.get
        return self.spark.read.schema(ACCEPTED).parquet(f"{target}/batch_id={batch}").agg(*ends).first().asDict()

    def _remember(self, stored: DataFrame, batch: int) -> None:
        """Notes the batch's ids, in folders by minute of arrival."""
        ids = stored.select("event_id", F.unix_seconds("received_at").alias("at_s"))
        ids = ids.withColumn("minute", F.floor(F.col("at_s") / BUCKET_S)).withColumn("batch_id", F.lit(batch))
        ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("minute", "batch_id").parquet(f"{self.out}/seen")

    def _classified(self, fresh: DataFrame, top: int | None, clock: eventtime.PartitionClock, every: DataFrame, now_ms: int) -> DataFrame:
        """By the watermark of the partitions where records have one; Kafka's time of a record is its arrival, else the batch's."""
        nothing = F.lit(None)
        if "partition" not in fresh.columns:
            return eventtime.classified(fresh, carry=top).withColumns({"partition": nothing.cast("int"), "arrival_ms": nothing.cast("long")})
        arrival = F.unix_millis("timestamp") if "timestamp" in fresh.columns else F.lit(now_ms).cast("long")
        known = max(clock.partitions, (every.agg(F.max("partition")).first()[0] or 0) + 1)
        return eventtime.classified_by_partition(fresh.withColumn("arrival_ms", arrival), replace(clock, partitions=known))

    def _close(self, sums: DataFrame, batch: int, mark: int | None) -> None:
        """Moves on the windows that are open: those that the watermark has passed are closed, with what all batches brought to them.

        No event on time can come to a window that is closed, so its sums are final.
        """
        kept = f"{self.out}/_open"
        earlier = [int(n[9:]) for n in children(self.spark, kept) if n.startswith("batch_id=") and int(n[9:]) < batch]
        parts = sums.select("user_id", "window_start_ms", "transaction_count", "total_volume")
        if earlier:
            parts = parts.unionByName(self.spark.read.schema(SUMS).parquet(f"{kept}/batch_id={max(earlier)}"))
        closed, still = windows.parted(windows.merge(parts), mark)
        append_once(closed.withColumn("closed_at_ms", F.lit(mark).cast("long")), f"{self.out}/closed", batch)
        append_once(_typed(still, SUMS), kept, batch)
        for old in sorted(earlier)[:-1]:  # the last is what a repeated batch begins from
            remove(self.spark, f"{kept}/batch_id={old}")

    def closed(self) -> DataFrame:
        """Windows that are over, each once."""
        rows = read_appended(self.spark, f"{self.out}/closed")
        return self.spark.createDataFrame([], f"{SUMS}, window_end_ms bigint, average_transaction_value double, closed_at_ms bigint") if rows is None else rows.drop("batch_id")

    def _changed(self, sums: DataFrame) -> DataFrame:
        """The windows that a batch touched, as they now stand; read from segments that have windows of that time."""
        first, last = sums.agg(F.min("window_start_ms"), F.max("window_start_ms")).first() if self.console or "aggregates" in self.topics else (None, None)
        now = self.windows.read(between={"window_start_ms": (first, last)})
        return windows.finish(now.join(sums.select("user_id", "window_start_ms"), ["user_id", "window_start_ms"], "left_semi"), windows.WINDOW_MS)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """``trigger`` as of DataStreamWriter.trigger, by default all that is there."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def start_anomalies(self, checkpoint: str, **trigger) -> StreamingQuery:
        """Reads what the main query accepted, also before there is any, and appends anomalies with ids."""
        self.spark.createDataFrame([], ACCEPTED).write.mode("ignore").parquet(f"{self.out}/accepted/batch_id=-1")
        accepted = self.spark.readStream.schema(ACCEPTED).parquet(f"{self.out}/accepted").where("lateness <> 'late'")
        return anomalies(accepted).writeStream.foreachBatch(self.record).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def record(self, found: DataFrame, batch: int) -> None:
        """One micro-batch of anomalies."""
        first = int(self.anomaly_ledger.get(below=batch) or 1)
        counted, path = Observation(), f"{self.out}/_found"
        # numbering reads rows twice, and a stream's state must not be gone through again
        new = append_once(found.withColumn("detected_at", F.current_timestamp()).observe(counted, F.count(F.lit(1)).alias("n")), path, batch)
        stored = self.spark.read.parquet(f"{path}/batch_id={batch}")
        n = counted.get["n"] if new else stored.count()
        numbered = with_ids(stored, "anomaly_id", ["event_id", "anomaly_type"], first=first, parts=8)
        self.found.upsert(_typed(require(numbered, not_null=["event_id", "user_id"], one_of={"anomaly_type": ANOMALY_TYPES}), FOUND), batch, known=n)
        self.anomaly_ledger.put(batch, str(first + n))
        remove(self.spark, f"{self.out}/_found/batch_id={batch - 1}")

    def aggregates(self, user: object | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Windows of all batches, a window's parts added up."""
        ms = lambda t: None if t is None else int(t.timestamp() * 1000)
        rows = self.windows.read(at=user, between={"window_start_ms": (ms(start), None if end is None else ms(end) + 1)})
        if rows is None:
            rows = self.spark.createDataFrame([], f"{SUMS}, updated_at timestamp")
        return windows.finish(rows, windows.WINDOW_MS).withColumns({"window_start": F.timestamp_millis("window_start_ms"), "window_end": F.timestamp_millis("window_end_ms")})

    def _timed(self, table: KeyedTable, column: str, empty: DataFrame) -> Rows:
        """A keyed table as the reader asks for it."""
        us = lambda t: None if t is None else (t - EPOCH) // timedelta(microseconds=1)

        def rows(user: object | None, start: datetime | None, end: datetime | None) -> DataFrame:
            found = table.read(at=user, between={column: (us(start), us(end))})
            return empty if found is None else found

        return rows

    def anomalies(self) -> DataFrame:
        rows = self.found.read()
        return self.spark.createDataFrame([], FOUND) if rows is None else rows

    def reader(self) -> AnalyticsReader:
        """Lookups over the job's tables as they stand at each request."""
        events = self._timed(self.events, "event_time", self.spark.createDataFrame([], ACCEPTED).drop(*PASSING))
        sums = lambda user, start, end: self.aggregates(user, start, end).drop("window_start_ms", "window_end_ms")
        return AnalyticsReader(events, sums, self._timed(self.found, "detected_at", self.spark.createDataFrame([], FOUND)), self.spark)

    def tables(self) -> list[KeyedTable]:
        """Those whose segments are to be merged beside the batches."""
        return [self.events, self.windows, self.found]

    def publish(self, database: str = "analytics") -> None:
        """Snapshots of the tables in the catalogue's tables of ``bootstrap``."""
        reader = self.reader()
        for name, rows in (("events", reader.events), ("user_aggregates", reader.aggregates), ("anomalies", reader.anomalies)):
            publish(rows, name, database)


def _together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """The results of steps that don't need each other, run at the same time; their jobs belong to the query that called.  All are ended before an error is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]


def _most(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _typed(rows: DataFrame, ddl: str) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.rsplit(" ", 1) for c in ddl.split(", "))])


def window_finals(stream: DataFrame, size: str = "10 seconds", delay: str = f"{OUT_OF_ORDER_MS} milliseconds") -> DataFrame:
    """Final form: a window is emitted once, when the watermark has passed its end, in append mode."""
    window = F.window("event_time", size)
    sums = stream.withWatermark("event_time", delay).groupBy("user_id", window).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_volume"))
    return _shown(sums)


def _shown(sums: DataFrame) -> DataFrame:
    mean = (F.col("total_volume").cast("double") / F.col("transaction_count")).alias("average_transaction_value")
    return sums.select("user_id", F.unix_millis("window.start").alias("window_start_ms"), F.unix_millis("window.end").alias("window_end_ms"), "transaction_count", "total_volume", mean)


def window_updates(stream: DataFrame, size: str = "10 seconds", delay: str = "45 seconds") -> DataFrame:
    """Revising form: each micro-batch emits the windows it changed, up to ``delay`` behind."""
    window = F.window("event_time", size)
    sums = stream.withWatermark("event_time", delay).groupBy("user_id", window).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_volume"))
    return _shown(sums)


def supervised(begin: Callable[[], StreamingQuery], attempts: int = 10, pause_s: float = 5.0) -> int:
    """Runs a query to its end, starting it anew after a failure; returns the restarts, raises when they are used up."""
    for restart in range(attempts + 1):
        query = begin()
        try:
            query.awaitTermination()
            return restart
        except Exception:
            if restart == attempts:
                raise
            time.sleep(pause_s)
    return attempts
