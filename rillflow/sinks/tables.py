"""Sinks that a batch may reach twice: appends by batch, keyed tables with upsert, and topics.

All are safe to repeat: an append writes its batch's own folder; an upsert
writes its batch's rows as a segment and then a manifest of its batch.
Readers follow the latest manifest, so they never see half a batch, and a
repeated batch starts from the manifest before it.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from ..folders import scratch
from ..functions.expressions import prefixed
from .files import Ledger, children, exists, move, read_text, remove, write_text

FAN = 8  # segments of one level that are merged into one of the next
BUCKETS = 16
FILE_ROWS = 2_000_000  # of a file of a merged segment, about
BATCH_ROWS = 1_000_000  # of a file of a batch's segment at most, about, if all rows fall into one bucket
GRACE_S = 600.0


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def append_once(rows: DataFrame, path: str, batch: int) -> bool:
    """Publishes a batch's folder whole and for good: whoever follows the path sees its files once, and a repeated batch finds them there."""
    spark, target = rows.sparkSession, f"{path}/batch_id={batch}"
    if exists(spark, target):
        return False
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    if move(spark, staged, target):
        return True
    remove(spark, staged)
    return False


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if any(n.startswith("batch_id=") for n in children(spark, path)) else None


class KeyedTable:
    """A table of one row a key, kept as segments that reading merges.

    A batch writes its own rows and nothing else, so what it writes doesn't
    grow with the table.  ``compact`` merges each ``FAN`` segments of a level
    into one of the next; it is meant for a loop of its own beside the batches
    (``maintained``), one a table.  Batches and merging have a ledger each and
    never write the other's: a manifest names the segments that a batch left,
    a merge what one segment stands for, and readers put them together.
    ``keep`` names columns that stay as first written, ``add`` columns that
    are summed up over the batches; all others take the latest batch's value.

    ``stable`` names columns in which all versions of a key agree.  The first
    deals the rows into buckets, a folder each, in which files are sorted by
    the stable columns and carry a Bloom filter of the first; of the others
    the manifest has each segment's range.  So a lookup of one value opens one
    bucket's files of the segments whose range it meets.  A row that comes
    again with another stable value is a row beside the first until that is
    rewritten: the table doesn't look for it elsewhere.

    Segments that were merged stay for ``grace_s``, and as long as a lease
    that names them, so readers outlive merges.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], keep: Sequence[str] = (), add: Sequence[str] = (), stable: Sequence[str] = (), buckets: int = BUCKETS, grace_s: float = GRACE_S):
        if not 1 <= buckets <= 62:
            raise ValueError("1 to 62 buckets")
        self.spark, self.path, self.keys, self.keep, self.add = spark, path, list(keys), list(keep), list(add)
        self.stable, self.buckets, self.grace_s = list(stable), buckets, grace_s
        self.ledger, self.merges = Ledger(spark, f"{path}/_manifest", keep=2), Ledger(spark, f"{path}/_merges", keep=2)

    def _manifest(self, below: int | None = None) -> dict:
        """What the last batch (before ``below``) left, with what has been merged since in its place."""
        found, merged = self.ledger.get(below), self.merges.get()
        manifest = json.loads(found) if found else {"segments": [], "columns": []}
        return manifest | {"segments": _merge_applied(manifest["segments"], json.loads(merged)["done"] if merged else [])[0]}

    def bucket_of(self, value: object) -> int:
        return int(hashlib.md5(str(value).encode()).hexdigest()[:8], 16) % self.buckets

    def _chosen(self, manifest: dict, at: object | None, between: dict[str, tuple]) -> list[dict]:
        """Segments that may have rows of the bucket and the ranges."""
        found = []
        for s in manifest["segments"]:
            ranges = s.get("ranges", {})
            if at is not None and not s.get("held", -1) >> self.bucket_of(at) & 1:
                continue
            if all(c not in ranges or (low is None or ranges[c][1] is None or ranges[c][1] >= low) and (high is None or ranges[c][0] is None or ranges[c][0] <= high) for c, (low, high) in between.items()):
                found.append(s)
        return found

    def _read(self, segments: list[dict], at: object | None = None) -> DataFrame | None:
        rows = None
        for s in segments:
            folder, schema = f"{self.path}/data/{s['name']}", T.StructType.fromJson(s["schema"])
            inside = f"{folder}/_bucket={self.bucket_of(at)}" if at is not None and "held" in s else folder
            part = self.spark.read.schema(schema).parquet(inside).select(*schema.names)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key, with the bookkeeping columns: the latest batch and order, and the first batch."""
        own = [c for c in rows.columns if c not in self.keys]
        special = {*self.keep, *self.add, "_batch", "_order", "_since"}
        latest = [c for c in own if c not in special]
        at = F.struct("_batch", "_order")
        found = [F.max_by(F.struct(*latest), at).alias("_latest")] if latest else []
        found += [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_since", "_order"))).alias(c) for c in self.keep]
        found += [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.add]
        found += [F.max(at).alias("_at"), F.min("_since").alias("_since")]
        one = rows.groupBy(*self.keys).agg(*found)
        shown = {**{c: F.col(f"_latest.{c}").alias(c) for c in latest}, "_batch": F.col("_at._batch").alias("_batch"), "_order": F.col("_at._order").alias("_order")}
        return one.select(*[shown.get(c, F.col(c)) for c in rows.columns])

    def read(self, where: Column | None = None, at: object | None = None, between: dict[str, tuple] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """All rows, or those that ``where`` holds for; None before the first batch.

        ``at`` is a value of the first stable column, ``between`` has lowest
        and highest values (None: open) of other stable columns, times as
        microseconds; rows outside are left out before versions are merged.
        ``where`` may be of any columns: it is first put to all versions of
        the rows, where it reaches the scan; only the keys that it finds are
        merged, and then it is put to what they now are.
        """
        manifest, between = manifest or self._manifest(), between or {}
        if unknown := set(between) - set(self.stable[1:]):
            raise ValueError(f"not stable: {', '.join(sorted(unknown))}")
        if at is not None and not self.stable:
            raise ValueError("no stable column")
        if not manifest["segments"]:
            return None
        chosen = self._chosen(manifest, at, between)
        rows = self._read(chosen or manifest["segments"][:1], at if chosen else None)
        rows = rows if chosen else rows.limit(0)
        if at is not None:
            rows = rows.where(F.col(self.stable[0]) == F.lit(at))
        for c, (low, high) in between.items():
            bound = lambda x, c=c: F.timestamp_micros(F.lit(x)) if isinstance(rows.schema[c].dataType, T.TimestampType) else F.lit(x)
            rows = rows.where(F.col(c) >= bound(low)) if low is not None else rows
            rows = rows.where(F.col(c) <= bound(high)) if high is not None else rows
        if len(chosen) > 1 or (chosen and chosen[0]["level"] == 0):
            if where is not None:
                some = rows.where(where).select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
                same = F.lit(True)
                for k in self.keys:
                    same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                rows = rows.join(some, same, "left_semi")
            rows = self._merged(rows)
        named = rows.columns
        rows = rows.select(*[F.col(c) if c in named else F.lit(None).alias(c) for c in manifest["columns"]])
        return rows if where is None else rows.where(where)

    def _write(self, rows: DataFrame, name: str, level: int, known: int = 0) -> dict:
        """A segment's entry; ``known`` is how many rows it may have, as far as that is known."""
        target, ranges = f"{self.path}/data/{name}", [c for c in self.stable[1:] if _rangeable(rows, c)]
        segment = {"name": name, "level": level, "schema": json.loads(rows.schema.json())}
        if not self.stable:
            rows.write.mode("overwrite").parquet(target)
            return segment
        bucket = (F.conv(F.substring(F.md5(F.col(self.stable[0]).cast("string")), 1, 8), 16, 10).cast("long") % self.buckets).cast("int")
        # of a bucket; a value that many rows have is in all of its bucket's.  Of a batch nobody knows how its rows fall into buckets
        files = 1 + known // (self.buckets * FILE_ROWS if level else BATCH_ROWS)
        dealt = rows.withColumn("_bucket", F.coalesce(bucket, F.lit(0))).withColumn("_file", F.pmod(F.xxhash64(*self.keys), F.lit(files)))
        seen = Observation()
        stats = [F.count(F.lit(1)).alias("rows"), F.expr("bit_or(shiftleft(1L, _bucket))").alias("held")]
        for c in ranges:
            value = F.unix_micros(c) if isinstance(rows.schema[c].dataType, T.TimestampType) else F.col(c)
            stats += [F.min(value).alias(f"low_{c}"), F.max(value).alias(f"high_{c}")]
        placed = dealt.repartition(self.buckets * files, "_bucket", "_file").drop("_file").sortWithinPartitions("_bucket", *self.stable, *[k for k in self.keys if k not in self.stable])
        placed.observe(seen, *stats).write.mode("overwrite").partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{self.stable[0]}", "true").parquet(target)
        told = seen.get
        return segment | {"rows": told["rows"], "held": told["held"] or 0, "ranges": {c: [told[f"low_{c}"], told[f"high_{c}"]] for c in ranges}}

    def upsert(self, rows: DataFrame, batch: int, order: str | None = None, known: int = 0) -> None:
        """Adds a batch; of several rows of a key the one of largest ``order`` holds.

        ``known`` is how many rows it may have, as far as that is known: a
        large batch is written by more tasks, so that none sorts more rows
        than a task of a smaller one.
        """
        before = self._manifest(below=batch)
        marked = rows.withColumn("_batch", F.lit(batch).cast("long")).withColumn("_order", F.col(order).cast("long") if order else F.lit(0).cast("long")).withColumn("_since", F.col("_batch"))
        segments = [*before["segments"], self._write(marked, f"v={batch}", 0, known)]
        columns = list(dict.fromkeys([*before["columns"], *rows.columns]))
        self.ledger.put(batch, json.dumps({"segments": segments, "columns": columns}))

    def compact(self) -> bool:
        """Merges the oldest ``FAN`` segments of the lowest level that has so many, if any; then deletes what nobody needs.

        The last batch's segment is left alone, as that batch may come again.
        """
        batches = self.ledger.batches()
        if not batches:
            return False
        text = self.merges.get()
        log = json.loads(text) if text else {"done": [], "gone": {}}
        kept = [json.loads(self.ledger.get(b + 1))["segments"] for b in batches]
        now = _merge_applied(kept[-1], log["done"])[0]
        free = [s for s in now if s["name"] != f"v={batches[-1]}"]
        due = next((some[:FAN] for level in sorted({s["level"] for s in free}) if len(some := [s for s in free if s["level"] == level]) >= FAN), None)
        if due:
            level = due[0]["level"] + 1
            into = self._write(self._merged(self._read(due)), f"c={level}-{uuid.uuid4().hex}", level, sum(s.get("rows", 0) for s in due))
            log["done"].append({"into": into, "of": [s["name"] for s in due]})
        # a merge is needed as long as a manifest has what it stands for
        needed = {n for segments in kept for n in _merge_applied(segments, log["done"])[1]}
        log["done"] = [m for m in log["done"] if m["into"]["name"] in needed]
        used = {s["name"] for segments in kept for s in [*segments, *_merge_applied(segments, log["done"])[0]]} | self._leased()
        used |= {n for n in children(self.spark, f"{self.path}/data") if n.startswith("v=") and int(n[2:]) > batches[-1]}  # being written
        at, old = time.time(), [n for n in children(self.spark, f"{self.path}/data") if n not in used and not n.startswith("_")]
        log["gone"] = {n: log["gone"].get(n, at) for n in old}
        late = [n for n, since in log["gone"].items() if at - since >= self.grace_s]
        log["gone"] = {n: since for n, since in log["gone"].items() if n not in late}
        done = self.merges.batches()
        if due or late or text is None or json.loads(text) != log:
            self.merges.put(done[-1] + 1 if done else 0, json.dumps(log))
        for name in late:
            remove(self.spark, f"{self.path}/data/{name}")
        return due is not None

    def _leased(self) -> set[str]:
        """Names that leases hold; those that have run out are deleted."""
        names: set[str] = set()
        for n in children(self.spark, f"{self.path}/_leases"):
            if not n.startswith("_"):
                lease = json.loads(read_text(self.spark, f"{self.path}/_leases/{n}"))
                if lease["until"] >= time.time():
                    names |= set(lease["names"])
                else:
                    remove(self.spark, f"{self.path}/_leases/{n}")
        return names

    def lease(self, seconds: float = 3600.0) -> Lease:
        """The table as it now stands, readable until the lease is released or its time is over."""
        return Lease(self, seconds)


class Lease:
    """A snapshot of a keyed table that merges leave in place; a context manager."""

    def __init__(self, table: KeyedTable, seconds: float):
        self.table, self.path = table, f"{table.path}/_leases/{uuid.uuid4().hex}"
        self.manifest = table._manifest()
        write_text(table.spark, self.path, json.dumps({"until": time.time() + seconds, "names": [s["name"] for s in self.manifest["segments"]]}))

    def read(self, where: Column | None = None, at: object | None = None, between: dict[str, tuple] | None = None) -> DataFrame | None:
        return self.table.read(where, at, between, self.manifest)

    def release(self) -> None:
        remove(self.table.spark, self.path)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def _merge_applied(segments: list[dict], done: list[dict]) -> tuple[list[dict], list[str]]:
    """Segments with each merge in place of what it stands for, as far as all of that is there; and the names of the merges put in."""
    put = []
    for merge in done:
        names = [s["name"] for s in segments]
        if set(merge["of"]) <= set(names):
            first = min(map(names.index, merge["of"]))
            segments = [s for s in segments[:first] if s["name"] not in merge["of"]] + [merge["into"]] + [s for s in segments[first:] if s["name"] not in merge["of"]]
            put.append(merge["into"]["name"])
    return segments, put


def _rangeable(rows: DataFrame, column: str) -> bool:
    return isinstance(rows.schema[column].dataType, (T.TimestampType, T.LongType, T.IntegerType))


def maintained(tables: Sequence[KeyedTable], every_s: float = 5.0) -> Callable[[], None]:
    """Merges segments of the tables in a thread of its own until the returned function is called; a failed round is tried again."""
    ended = threading.Event()

    def run() -> None:
        while not ended.wait(every_s):
            for table in tables:
                try:
                    while table.compact() and not ended.is_set():
                        pass
                except Exception as e:  # noqa: BLE001  the next round begins from the ledgers
                    print(f"merging {table.path}: {type(e).__name__}: {e}")

    thread = threading.Thread(target=run, daemon=True)
    thread.start()

    def end() -> None:
        ended.set()
        thread.join()

    return end


class TopicWriter:
    """Writes rows as compact JSON to a topic: Kafka's, or a folder of key and value (each batch once)."""

    def __init__(self, location: str, kind: str = "folder", key: str | None = None, **options: str):
        if kind not in ("folder", "kafka"):
            raise ValueError("a topic is a folder or Kafka's")
        self.location, self.kind, self.key, self.options = location, kind, key, options

    def write(self, rows: DataFrame, batch: int) -> None:
        lines = kafka_rows(rows, self.key)
        if self.kind == "kafka":
            lines.write.format("kafka").option("topic", self.location).options(**self.options).save()
        else:
            append_once(lines, self.location, batch)


def require(rows: DataFrame, not_null: Sequence[str] = (), one_of: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Fails the write on a row that breaks a constraint; nothing is dropped."""
    for c in not_null:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)))
    for c, allowed in (one_of or {}).items():
        rows = rows.withColumn(c, F.when(~F.col(c).isin(*allowed), F.raise_error(F.concat(F.lit(f"{c} is "), F.col(c)))).otherwise(F.col(c)))
    return rows


def with_ids(rows: DataFrame, name: str, order: Sequence[str], first: int = 1, parts: int = 64) -> DataFrame:
    """Adds gapless ids in order, in two levels: ranges of ``order``, then ranks inside each.

    The ranges are drawn from a sample, anew whenever rows are computed, so
    they are stored before they are counted and ranked.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy(*order)
    return ranged.join(counts, "_range").withColumn(name, F.col("_before") + F.row_number().over(inside) - 1 + first).drop("_range", "_before")


def kafka_rows(rows: DataFrame, key: str | None = None) -> DataFrame:
    """key and value (compact JSON) for a Kafka or text sink."""
    value = F.to_json(F.struct(*rows.columns)).alias("value")
    return rows.select(F.col(key).cast("string").alias("key"), value) if key else rows.select(value)


def lines_of(rows: DataFrame, prefix: str) -> DataFrame:
    """A line of JSON behind ``prefix`` for each row."""
    return rows.select(prefixed(prefix, F.to_json(F.struct(*rows.columns))).alias("line"))


def inspect(rows: DataFrame, prefix: str, most: int = 20) -> list[str]:
    """Prints some rows of a batch as lines, and returns them."""
    shown = [r["line"] for r in lines_of(rows, prefix).limit(most).collect()]
    for line in shown:
        print(line)
    return shown


# fixed values: columns of the stored tables
TABLES = {
    "events": "event_id STRING, user_id STRING, merchant_id STRING, amount BIGINT, currency STRING, transaction_type STRING, event_time TIMESTAMP, ingest_time TIMESTAMP, schema_version INT, received_at TIMESTAMP",
    "user_aggregates": "user_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, transaction_count BIGINT, total_volume BIGINT, average_transaction_value DOUBLE, updated_at TIMESTAMP",
    "anomalies": "anomaly_id BIGINT, anomaly_type STRING, event_id STRING, user_id STRING, transaction_count BIGINT, velocity_window_seconds INT, velocity_threshold BIGINT, amount BIGINT, rolling_99th_percentile DOUBLE, history_size INT, detected_at TIMESTAMP",
    "schema_migrations": "version STRING, applied_at TIMESTAMP",
}


def publish(rows: DataFrame, name: str, database: str = "analytics") -> None:
    """Puts rows into a table of ``bootstrap`` in place of what it held, columns by name."""
    table = rows.sparkSession.table(f"{database}.{name}")
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]).write.mode("overwrite").insertInto(f"{database}.{name}")


def bootstrap(spark: SparkSession, database: str = "analytics", version: str = "2") -> None:
    """Creates the tables that are missing and notes the version; may run again.

    An events table of an older shape, without event_id, is dropped first.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if spark.catalog.tableExists(f"{database}.events") and "event_id" not in spark.table(f"{database}.events").columns:
        spark.sql(f"DROP TABLE {database}.events")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    ledger = f"{database}.schema_migrations"
    if spark.table(ledger).where(F.col("version") == version).isEmpty():
        spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("applied_at")).write.insertInto(ledger)
