"""Reading transaction events: tables, raw text streams, offset ranges, tolerant JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARTITIONS = 6  # of the raw topic; a record's partition follows its user


def table(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as transactions; the id is the order of arrival."""
    return as_transactions(table(spark, sf_dir))


def as_transactions(events: DataFrame) -> DataFrame:
    """Times without zone are UTC."""
    zoned = dict(events.dtypes)["ts"] == "timestamp"
    epoch = F.unix_millis("ts") if zoned else F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select(
        "event_id", F.col("event_id").alias("seq"), "user_id", F.get_json_object("props", "$.k").alias("merchant_id"),
        F.round(F.col("value") * 100).cast("long").alias("amount"), F.lit("USD").alias("currency"), F.col("event_type").alias("transaction_type"),
        epoch.alias("ts_ms"), F.lit(1).alias("schema_version"),
    )


def between(events: DataFrame, from_ms: Column, to_ms: Column, then: Callable[[DataFrame], DataFrame] = as_transactions, time: str = "ts") -> DataFrame:
    """Events of milliseconds from_ms to to_ms, both included, compared on the stored time; ``then`` shapes them."""
    kind = dict(events.dtypes)[time]
    # whole milliseconds: everything before the next one is inside
    first, after = (F.timestamp_millis(ms).cast(kind) if kind == "timestamp" else F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast(kind)) for ms in (from_ms, to_ms + 1))
    return then(events.where((F.col(time) >= first) & (F.col(time) < after)))


def stressed(transactions_: DataFrame, disorder: bool = True) -> DataFrame:
    """Few users and dense times, some of them late: fixture columns by integer arithmetic on the id."""
    late = F.when(F.col("event_id") % 37 == 5, 20_000).when(F.col("event_id") % 41 == 7, 90_000).otherwise(0) if disorder else F.lit(0)
    return transactions_.withColumn("user_id", F.col("user_id") % 10).withColumn("ts_ms", F.lit(1_704_067_200_000) + F.col("event_id") * 600 - late)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key over four tasks a core, where what follows costs more a row than to move it: the row groups of a file may be fewer than the cores."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def raw_stream(spark: SparkSession, location: str, kind: str = "text", most: int | None = None, **options: str) -> DataFrame:
    """A stream of ``raw`` records: Kafka (earliest offsets, values as text, with partition, offset and timestamp) or files of a line each.

    A micro-batch takes at most ``most`` records of Kafka, or files.
    """
    reader = spark.readStream.format(kind)
    if most:
        reader = reader.option("maxOffsetsPerTrigger" if kind == "kafka" else "maxFilesPerTrigger", most)
    if kind == "kafka":
        reader = reader.option("subscribe", location).option("startingOffsets", "earliest").options(**options)
        return kafka_records(reader.load())
    return reader.options(**options).load(location).select(F.col("value").alias("raw"))


def kafka_records(rows: DataFrame) -> DataFrame:
    """raw, partition, offset, and timestamp if there is one, of Kafka's rows; a null value is an empty text, which fails validation."""
    return rows.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("raw"), "partition", "offset", *[c for c in ("timestamp",) if c in rows.columns])


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path; partitionColumn, lowerBound, upperBound and numPartitions split the scan."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def with_partition(events: DataFrame, key: str = "user_id", partitions: int = PARTITIONS) -> DataFrame:
    """Adds the topic partition a record belongs to: its key's digest, so any client can tell it."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return events.withColumn("partition", (digest % partitions).cast("int"))


def offset_range(records: DataFrame, ranges: dict[int, tuple[int, int]], partition: str = "partition", offset: str = "offset") -> DataFrame:
    """The records of each partition from its start offset up to, not including, its end; pushed down to the scan."""
    found: Column = F.lit(False)
    for p, (start, end) in sorted(ranges.items()):
        found = found | ((F.col(partition) == p) & (F.col(offset) >= start) & (F.col(offset) < end))
    return records.where(found)


def offsets_table(lines: DataFrame, text: str = "value") -> DataFrame:
    """topic, partition, offset of lines ``topic:partition:offset``."""
    part = F.split(text, ":")
    return lines.select(part[0].alias("topic"), part[1].try_cast("int").alias("partition"), part[2].try_cast("long").alias("offset"))


def offset_totals(offsets: DataFrame) -> DataFrame:
    """One row a topic: its partitions' offsets summed up; lines without a number don't count."""
    return offsets.groupBy("topic").agg(F.count("offset").alias("partitions"), F.sum("offset").alias("total"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT ``record`` a line; lines that are no JSON are skipped."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("record")).where("record is not null")
