"""Record shapes and constants of the transaction stream."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: required fields of a record in checking order, with their JSON types
REQUIRED_FIELDS = {
    "event_id": "STRING",
    "user_id": "STRING",
    "merchant_id": "STRING",
    "amount": "BIGINT",
    "currency": "STRING",
    "transaction_type": "STRING",
    "event_time": "STRING",
    "ingest_time": "STRING",
    "schema_version": "BIGINT",
}

# fixed values: event-time and anomaly parameters
OUT_OF_ORDER_MS = 50
LATE_AFTER_MS = 45_000
IDLE_AFTER_MS = 30_000
WINDOW_MS = 10_000
VELOCITY_WINDOW_MS = 60_000
VELOCITY_THRESHOLD = 10
HISTORY_ROWS = 256
HISTORY_LEAST = 20
QUANTILE = 0.99
DEDUP_TTL = "10 minutes"

ANOMALY_TYPES = ("ANOMALY_VELOCITY", "ANOMALY_AMOUNT")

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("merchant_id", T.StringType()),
    T.StructField("amount", T.LongType()), T.StructField("currency", T.StringType()), T.StructField("transaction_type", T.StringType()),
    T.StructField("event_time", T.TimestampType()), T.StructField("ingest_time", T.TimestampType()), T.StructField("schema_version", T.IntegerType()),
])

DEAD_LETTER = T.StructType([T.StructField("reason_code", T.StringType()), T.StructField("raw_record", T.StringType())])

ANOMALY = (
    "anomaly_type string, event_id string, user_id string, transaction_count long, velocity_window_seconds int, "
    "velocity_threshold long, amount long, rolling_99th_percentile double, history_size int"
)
