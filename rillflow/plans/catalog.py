"""All queries of the core engine by name, each with its DuckDB twin.

``QUERIES`` maps a name to a function of (spark, folder of the tables),
``ORACLES`` to SQL with the same columns.  Times are shown as milliseconds,
so no session time zone matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..folders import scratch
from ..functions.expressions import cursor_of
from ..operators import anomaly, dedup, eventtime, quality, validate, windows
from ..schema import REQUIRED_FIELDS
from ..sinks.tables import KeyedTable, append_batch, read_appended
from ..sources.events import as_transactions, between, offset_range, stressed, table, transactions
from ..streaming import job, stateful
from .reader import AnalyticsReader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TX = """tx AS (SELECT event_id, event_id AS seq, user_id, json_extract_string(props, '$.k') AS merchant_id,
  CAST(round(value * 100) AS BIGINT) AS amount, event_type AS transaction_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms FROM events)"""
_ST = _TX + """, st AS (SELECT event_id, seq, user_id % 10 AS user_id, merchant_id, amount, transaction_type,
  1704067200000 + event_id * 600 - CASE WHEN event_id % 37 = 5 THEN 20000 WHEN event_id % 41 = 7 THEN 90000 ELSE 0 END AS ts_ms FROM tx)"""
_SO = _TX + """, so AS (SELECT event_id, seq, user_id % 10 AS user_id, merchant_id, amount, transaction_type, 1704067200000 + event_id * 600 AS ts_ms FROM tx)"""
_CL = _ST + """, wm AS (SELECT *, max(ts_ms) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - 51 AS watermark_ms FROM st),
  cl AS (SELECT *, CASE WHEN watermark_ms - ts_ms > 45000 THEN 'late' WHEN ts_ms // 10000 * 10000 + 9999 <= watermark_ms THEN 'dropped' ELSE 'on_time' END AS lateness FROM wm)"""
_AGG = """SELECT user_id, ts_ms // 10000 * 10000 AS window_start_ms, count(*) AS transaction_count, CAST(sum(amount) AS BIGINT) AS total_volume,
  ts_ms // 10000 * 10000 + 10000 AS window_end_ms, CAST(sum(amount) AS DOUBLE) / count(*) AS average_transaction_value FROM {0} GROUP BY user_id, ts_ms // 10000 * 10000"""
_VEL = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq)
  - count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 60001 PRECEDING) AS transaction_count FROM so"""
_AMT = """SELECT *, h[lo + 1] + (h[least(lo + 1, n - 1) + 1] - h[lo + 1]) * (pos - lo) AS rolling_99th_percentile
  FROM (SELECT *, (n - 1) * CAST(0.99 AS DOUBLE) AS pos, CAST(floor((n - 1) * CAST(0.99 AS DOUBLE)) AS INTEGER) AS lo FROM
  (SELECT *, len(h) AS n FROM (SELECT *, list_sort(list(CAST(amount AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)) AS h FROM {0})) WHERE n >= 20)"""
_ANOMALIES = """SELECT 'ANOMALY_VELOCITY' AS anomaly_type, event_id, user_id, transaction_count, 60 AS velocity_window_seconds, CAST(10 AS BIGINT) AS velocity_threshold,
  CAST(NULL AS BIGINT) AS amount, CAST(NULL AS DOUBLE) AS rolling_99th_percentile, CAST(NULL AS INTEGER) AS history_size FROM (""" + _VEL + """) WHERE transaction_count > 10
  UNION ALL SELECT 'ANOMALY_AMOUNT', event_id, user_id, NULL, NULL, NULL, amount, rolling_99th_percentile, CAST(n AS INTEGER) FROM (""" + _AMT.format("so") + ") WHERE amount > rolling_99th_percentile"  # fmt: skip
_STORED = """stored AS (SELECT concat('00000000-0000-4000-a000-', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS event_id, user_id, merchant_id, amount, transaction_type, ts_ms FROM tx)"""
# the same text is SQL for both engines: a record as JSON, faulty in one of several ways
_RAW = """CASE event_id % 23
  WHEN 1 THEN concat('{"event_id":"', event_id, '","user_id"')
  WHEN 2 THEN '[1]'
  WHEN 3 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1}')
  WHEN 4 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":"12","currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1}')
  WHEN 5 THEN concat('{"event_id":"', event_id, '","merchant_id":"m","currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1}')
  WHEN 6 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":12,"currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":true}')
  WHEN 7 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":null,"currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1}')
  WHEN 8 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":12} x')
  WHEN 9 THEN concat('{"event_id":', event_id, ',"user_id":"u', user_id, '","merchant_id":"m","amount":12}')
  WHEN 10 THEN concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":1.5}')
  ELSE concat('{"event_id":"', event_id, '","user_id":"u', user_id, '","merchant_id":"m","amount":', event_id % 1000, ',"currency":"ZZZ","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1,"extra":[]}') END"""
_REASON = "CASE WHEN NOT json_valid(raw) THEN 'malformed_json' WHEN json_type(raw) <> 'OBJECT' THEN 'invalid_type:root' " + " ".join(
    f"WHEN json_type(raw, '$.{f}') IS NULL THEN 'missing_field:{f}' WHEN json_type(raw, '$.{f}') NOT IN ({types}) THEN 'invalid_type:{f}'" for f, types in ((f, "'VARCHAR'" if k == "STRING" else "'UBIGINT', 'BIGINT'") for f, k in REQUIRED_FIELDS.items())
) + " END"
_RAWS = f"raws AS (SELECT event_id AS seq, {_RAW} AS raw FROM events), judged AS (SELECT seq, raw, {_REASON} AS reason_code FROM raws)"


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def register(of: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[of.__name__] = of
        if sql is not None:
            ORACLES[of.__name__] = sql
        return of

    return register


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select(F.col("event_id").alias("seq"), F.expr(_RAW).alias("raw"))


def _stressed(spark: SparkSession, sf_dir: str, disorder: bool = True) -> DataFrame:
    return stressed(transactions(spark, sf_dir), disorder)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventtime.classified(_stressed(spark, sf_dir))


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with every 17th arriving again later, changed."""
    tx = transactions(spark, sf_dir).select("event_id", "seq", "user_id", "amount", "ts_ms")
    again = tx.where("event_id % 17 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "amount": F.col("amount") + 1})
    return tx.unionByName(again)


_TWICE = _TX + """, twice AS (SELECT event_id, seq, user_id, amount, ts_ms FROM tx UNION ALL
  SELECT event_id, seq + 1000000000, user_id, amount + 1, ts_ms FROM tx WHERE event_id % 17 = 0)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_stored(table(spark, sf_dir))


def _as_stored(events: DataFrame) -> DataFrame:
    """Events as the reader's table has them, with ids of UUID form."""
    uuid = F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return as_transactions(events).select(uuid.alias("event_id"), "user_id", "merchant_id", "amount", "transaction_type", F.timestamp_millis("ts_ms").alias("event_time"))


def _reader(spark: SparkSession, sf_dir: str) -> AnalyticsReader:
    sums = windows.aggregates(_stressed(spark, sf_dir, False)).withColumns({"window_start": F.timestamp_millis("window_start_ms"), "window_end": F.timestamp_millis("window_end_ms")})
    found = _anomalies(spark, sf_dir).withColumns({
        "anomaly_id": F.col("event_id") * 2 + (F.col("anomaly_type") == "ANOMALY_AMOUNT").cast("long"),
        "detected_at": F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("event_id") * 600),
    })
    return AnalyticsReader(_stored(spark, sf_dir), sums, found)


def _shown(events: DataFrame) -> DataFrame:
    return events.withColumn("ts_ms", F.unix_millis("event_time")).drop("event_time")


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    so = _stressed(spark, sf_dir, False)
    return anomaly.union_of(anomaly.velocity(so), anomaly.amounts(so))


# windows and event time


@query(f"WITH {_TX} {_AGG.format('tx')}")
def user_window_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.aggregates(transactions(spark, sf_dir))


@query(f"WITH {_CL} SELECT event_id, user_id, ts_ms, watermark_ms FROM cl WHERE lateness = 'late'")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).where("lateness = 'late'").select("event_id", "user_id", "ts_ms", "watermark_ms")


@query(f"WITH {_CL} SELECT event_id, user_id, ts_ms, watermark_ms FROM cl WHERE lateness = 'dropped'")
def window_dropped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).where("lateness = 'dropped'").select("event_id", "user_id", "ts_ms", "watermark_ms")


@query(f"WITH {_CL}, ot AS (SELECT * FROM cl WHERE lateness = 'on_time') {_AGG.format('ot')}")
def on_time_window_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.aggregates(_classes(spark, sf_dir).where("lateness = 'on_time'"))


@query(f"WITH {_CL} SELECT lateness, count(*) AS n FROM cl GROUP BY lateness")
def lateness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).groupBy("lateness").agg(F.count("*").alias("n"))


# validation and de-duplication


@query(f"WITH {_RAWS} SELECT coalesce(reason_code, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1")
def validation_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.with_reason(_raws(spark, sf_dir)).groupBy(F.coalesce("reason_code", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_RAWS} SELECT reason_code, raw AS raw_record FROM judged WHERE reason_code IS NOT NULL")
def deadletter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dead_letters(_raws(spark, sf_dir))


@query(f"WITH {_RAWS} SELECT seq, raw->>'$.event_id' AS event_id, raw->>'$.user_id' AS user_id, CAST(raw->>'$.amount' AS BIGINT) AS amount, CAST(raw->>'$.schema_version' AS INTEGER) AS schema_version FROM judged WHERE reason_code IS NULL")
def valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.valid_events(_raws(spark, sf_dir)).select("seq", "event_id", "user_id", "amount", "schema_version")


@query(f"WITH {_TWICE} SELECT event_id, seq, user_id, amount, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS nth FROM twice) WHERE nth = 1")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_arrivals(_twice(spark, sf_dir))


# anomalies


@query(f"WITH {_SO} SELECT event_id, user_id, ts_ms, transaction_count FROM ({_VEL}) WHERE transaction_count > 10")
def velocity_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.velocity(_stressed(spark, sf_dir, False)).select("event_id", "user_id", "ts_ms", "transaction_count")


@query(f"WITH {_TX} SELECT event_id, user_id, amount, rolling_99th_percentile, CAST(n AS INTEGER) AS history_size FROM ({_AMT.format('tx')}) WHERE amount > rolling_99th_percentile")
def amount_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.amounts(transactions(spark, sf_dir)).select("event_id", "user_id", "amount", "rolling_99th_percentile", "history_size")


@query(f"WITH {_SO} {_ANOMALIES}")
def anomalies_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir)


# a time counts from its arrival to that of the first time over 60 s above it
_ARRIVAL = """gone AS (SELECT a.user_id, min(b.seq) AS seq FROM st a JOIN st b ON a.user_id = b.user_id AND b.seq > a.seq AND b.ts_ms > a.ts_ms + 60000 GROUP BY a.user_id, a.seq),
  steps AS (SELECT user_id, seq, 1 AS step FROM st UNION ALL SELECT user_id, seq, -1 FROM gone), sums AS (SELECT user_id, seq, sum(step) AS step FROM steps GROUP BY user_id, seq),
  counts AS (SELECT user_id, seq, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS transaction_count FROM sums)"""


@query(f"""WITH {_ST}, {_ARRIVAL}, a AS (SELECT 'ANOMALY_VELOCITY' AS anomaly_type, event_id, user_id, transaction_count, 60 AS velocity_window_seconds, CAST(10 AS BIGINT) AS velocity_threshold,
  CAST(NULL AS BIGINT) AS amount, CAST(NULL AS DOUBLE) AS rolling_99th_percentile, CAST(NULL AS INTEGER) AS history_size FROM st JOIN counts USING (user_id, seq) WHERE transaction_count > 10
  UNION ALL SELECT 'ANOMALY_AMOUNT', event_id, user_id, NULL, NULL, NULL, amount, rolling_99th_percentile, CAST(n AS INTEGER) FROM ({_AMT.format('st')}) WHERE amount > rolling_99th_percentile)
  SELECT * REPLACE (CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id) FROM a""")
def anomalies_in_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-order arrivals, with pruning that forgets for good."""
    return anomaly.in_arrival_order(_stressed(spark, sf_dir))


# reader


@query(f"WITH {_TX}, {_STORED} SELECT * FROM stored WHERE user_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 5")
def user_transactions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_reader(spark, sf_dir).user_transactions_query(7, 5))


@query(f"WITH {_TX}, {_STORED} SELECT * FROM stored WHERE user_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 5 OFFSET 5")
def user_transactions_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return _shown(reader.user_transactions_query(7, 5, reader.user_transactions(7, 5).next_cursor))


@query(f"WITH {_SO} SELECT window_start_ms, window_end_ms, user_id, transaction_count, total_volume, average_transaction_value FROM ({_AGG.format('so')}) WHERE user_id = 3 ORDER BY window_start_ms DESC LIMIT 50")
def user_aggregates_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).user_aggregates_query(3).drop("window_start", "window_end")


_PAGE = "SELECT *, event_id * 2 + CASE WHEN anomaly_type = 'ANOMALY_AMOUNT' THEN 1 ELSE 0 END AS anomaly_id FROM (" + _ANOMALIES + ")"


@query(f"WITH {_SO} SELECT * FROM ({_PAGE}) WHERE user_id = 3 AND anomaly_type = 'ANOMALY_AMOUNT' ORDER BY event_id DESC, anomaly_id DESC LIMIT 50")
def user_anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).anomalies_query(3, anomaly_type="ANOMALY_AMOUNT").drop("detected_at")


@query(f"WITH {_SO} SELECT * FROM ({_PAGE}) ORDER BY event_id DESC, anomaly_id DESC LIMIT 200")
def global_anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).anomalies_query(limit=200).drop("detected_at")


@query(f"WITH {_TX}, {_STORED}, b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM tx) SELECT stored.* FROM stored, b WHERE ts_ms BETWEEN lo + (hi - lo) // 4 AND lo + (hi - lo) // 2")
def time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the table's own times; the filter is on the stored column, so it reaches the scan."""
    lo, hi = transactions(spark, sf_dir).agg(F.min("ts_ms"), F.max("ts_ms")).first()
    at = lambda ms: F.lit(ms).cast("long")
    return _shown(between(table(spark, sf_dir), at(lo + (hi - lo) // 4), at(lo + (hi - lo) // 2), _as_stored))


@query(f"WITH {_TX}, {_STORED} SELECT * FROM stored")
def events_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stored(spark, sf_dir))


@query("SELECT translate(rtrim(translate(to_base64(encode(concat(CAST(event_id AS VARCHAR), ',', CAST(user_id AS VARCHAR)))), '=', ' ')), '+/', '-_') AS cursor, event_id FROM events")
def event_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select(cursor_of(F.col("event_id"), F.col("user_id")).alias("cursor"), "event_id")


@query(f"WITH {_TX}, {_STORED}, one AS (SELECT event_id FROM stored WHERE user_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 5), two AS (SELECT event_id FROM stored WHERE user_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 5 OFFSET 5) SELECT count(*) AS shared FROM one JOIN two USING (event_id)")
def page_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = user_transactions_page(spark, sf_dir), user_transactions_second_page(spark, sf_dir)
    return one.select("event_id").intersect(two.select("event_id")).agg(F.count("*").alias("shared"))


@query(f"WITH {_TX} SELECT event_id, user_id, amount, ts_ms FROM tx ORDER BY ts_ms DESC, event_id DESC LIMIT 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(1).select("event_id", "user_id", "amount", "ts_ms")


# reconciliation and metrics


@query("SELECT count(*) AS n FROM events")
def events_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {_TWICE} SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids FROM twice")
def distinct_vs_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir).agg(F.count("*").alias("total"), F.count_distinct("event_id").alias("distinct_ids"))


@query(f"WITH {_TWICE} SELECT event_id, count(*) AS n FROM twice GROUP BY event_id HAVING count(*) > 1")
def duplicate_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(_twice(spark, sf_dir), ["event_id"])


@query(f"WITH {_SO}, w AS (SELECT user_id, ts_ms // 10000 * 10000 AS window_start_ms FROM so) SELECT user_id, window_start_ms, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stressed(spark, sf_dir, False).select("user_id", eventtime.window_start(F.col("ts_ms")).alias("window_start_ms"))
    return quality.duplicates(rows, ["user_id", "window_start_ms"])


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = _twice(spark, sf_dir).select("event_id")
    return raw, raw.where("event_id % 10 <> 3 and event_id % 101 <> 0"), raw.where("event_id % 10 = 3")


@query("SELECT event_id FROM events WHERE event_id % 10 <> 3 AND event_id % 101 = 0")
def unaccounted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unaccounted(*_three(spark, sf_dir))


@query(f"""WITH {_TWICE}, l AS (SELECT event_id FROM twice WHERE event_id % 10 <> 3 AND event_id % 101 <> 0) SELECT
  (SELECT count(DISTINCT event_id) FROM twice) AS raw_unique, (SELECT count(DISTINCT event_id) FROM l) AS landed_unique,
  (SELECT count(DISTINCT event_id) FROM twice WHERE event_id % 10 = 3) AS dead_unique,
  (SELECT count(DISTINCT event_id) FROM twice WHERE event_id % 10 <> 3 AND event_id % 101 = 0) AS unaccounted,
  (SELECT count(*) - count(DISTINCT event_id) FROM l) AS landed_duplicates""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile(*_three(spark, sf_dir))


@query(f"WITH {_TX}, x AS (SELECT CAST((event_id * 7919) % 5000 AS DOUBLE) AS ms FROM tx) SELECT round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms FROM x")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_millis("ts_ms")
    rows = transactions(spark, sf_dir).select(at.alias("event_time"), F.timestamp_millis(F.col("ts_ms") + F.col("event_id") * 7919 % 5000).alias("received_at"))
    found = quality.latency(rows, "received_at", "event_time")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("""WITH d AS (SELECT CAST((event_id * 7919) % 200 + 50 AS BIGINT) AS ms FROM events) SELECT count(*) AS n, min(ms) AS min_ms,
  avg(ms) AS avg_ms, max(ms) AS max_ms, list_sort(list(ms))[greatest(1, CAST(floor(count(*) * 0.95) AS BIGINT))] AS p95_ms FROM d""")
def checkpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duration_stats(table(spark, sf_dir).select((F.col("event_id") * 7919 % 200 + 50).alias("ms")), "ms")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select((F.col("event_id") % 6).cast("int").alias("partition"), F.floor(F.col("event_id") / 6).alias("offset"), "event_id", "user_id")


@query("SELECT CAST(event_id % 6 AS INTEGER) AS partition, max(event_id // 6) + 1 AS end_offset FROM events GROUP BY 1")
def offset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))


@query("SELECT CAST(event_id % 6 AS INTEGER) AS partition, event_id // 6 AS \"offset\", event_id, user_id FROM events WHERE (event_id % 6 = 0 AND event_id // 6 BETWEEN 100 AND 149) OR (event_id % 6 = 3 AND event_id // 6 BETWEEN 0 AND 9)")
def offset_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_range(_records(spark, sf_dir), {0: (100, 150), 3: (0, 10)})


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll an event: a total that is flat for a quarter of them, then grows, and is flat again from the middle on."""
    events, n = table(spark, sf_dir), F.col("event_id")
    half = F.broadcast(events.agg(F.floor(F.max("event_id") / 2).alias("half")))
    total = F.greatest(F.least(n, F.col("half")), F.floor(F.col("half") / 2)) * 100
    return events.join(half, F.lit(True)).select(n.alias("poll"), total.cast("long").alias("total"), (F.lit(1_704_067_200_000) + n * 5000).alias("at_ms"))


_POLLS = "p AS (SELECT event_id AS poll, CAST(greatest(least(event_id, half), half // 2) * 100 AS BIGINT) AS total, 1704067200000 + event_id * 5000 AS at_ms FROM events, (SELECT max(event_id) // 2 AS half FROM events))"


@query(f"WITH {_POLLS} SELECT max(total) - min(total) AS delta, (max(total) - min(total)) / ((max(at_ms) - min(at_ms)) / CAST(1000 AS DOUBLE)) AS per_second FROM p")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.throughput(_polls(spark, sf_dir), "at_ms", "total")


@query(f"WITH {_POLLS}, q AS (SELECT * FROM p WHERE total > (SELECT min(total) FROM p)) SELECT poll, total, at_ms FROM (SELECT *, lag(total, 1) OVER (ORDER BY poll) AS a, lag(total, 2) OVER (ORDER BY poll) AS b FROM q) WHERE total = a AND total = b ORDER BY poll LIMIT 1")
def drain_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the first growth."""
    polls = _polls(spark, sf_dir)
    least = F.broadcast(polls.agg(F.min("total").alias("least")))
    return quality.drained(polls.join(least, F.col("total") > F.col("least")).drop("least"), "total")


@query(f"WITH {_POLLS} SELECT * FROM (SELECT *, total - lag(total) OVER (ORDER BY poll) AS growth FROM p) WHERE growth > 0 ORDER BY poll LIMIT 1")
def first_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_growth(_polls(spark, sf_dir), "total")


# sinks


@query(f"WITH {_TX} SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN amount + 1 ELSE amount END AS amount, ts_ms AS received_ms FROM tx")
def upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of one key: payload of the last, time of the first."""
    rows = transactions(spark, sf_dir).select("event_id", "user_id", "amount", F.col("ts_ms").alias("received_ms"))
    stored = KeyedTable(spark, scratch(spark, "upsert"), ["event_id"], keep=["received_ms"])
    stored.upsert(rows, 0)
    again = rows.where("event_id % 5 = 0").withColumns({"amount": F.col("amount") + 1, "received_ms": F.col("received_ms") + 99})
    for _ in range(2):  # a batch that is repeated changes nothing
        stored.upsert(again, 1)
    return stored.read()


@query(f"WITH {_SO} {_AGG.format('so')}")
def upsert_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows first of half the events, then of all: the last write holds."""
    so = _stressed(spark, sf_dir, False)
    stored = KeyedTable(spark, scratch(spark, "upsert"), ["user_id", "window_start_ms"])
    stored.upsert(windows.aggregates(so.where("event_id % 2 = 0")), 0)
    stored.upsert(windows.aggregates(so), 1)
    return stored.read()


# streaming


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir).schema
    return as_transactions(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _drain(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str) -> None:
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {_TX} {_AGG.format('tx')}")
def stream_user_window_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "stream")
    stored = KeyedTable(spark, f"{folder}/windows", ["user_id", "window_start_ms"])
    events = _stream(spark, sf_dir).withColumn("event_time", F.timestamp_millis("ts_ms"))
    _drain(job.window_updates(events), stored.upsert, folder, "update")
    return stored.read()


@query(f"WITH {_TX} SELECT event_id, user_id, amount, ts_ms FROM tx")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "stream")
    events = _stream(spark, sf_dir).withColumn("event_time", F.timestamp_millis("ts_ms"))
    doubled = events.withColumn("copy", F.explode(F.when(F.col("event_id") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    _drain(dedup.within_watermark(doubled), lambda rows, batch: append_batch(rows, f"{folder}/events", batch), folder, "append")
    return read_appended(spark, f"{folder}/events").select("event_id", "user_id", "amount", "ts_ms")


@query(f"WITH {_SO} SELECT anomaly_type, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, transaction_count, velocity_window_seconds, velocity_threshold, amount, rolling_99th_percentile, history_size FROM ({_ANOMALIES})")
def stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "stream")
    _drain(stateful.anomalies(stressed(_stream(spark, sf_dir), False)), lambda rows, batch: append_batch(rows, f"{folder}/anomalies", batch), folder, "append")
    return read_appended(spark, f"{folder}/anomalies").drop("batch_id")


from . import catalog_io  # noqa: E402, F401  its queries join these
