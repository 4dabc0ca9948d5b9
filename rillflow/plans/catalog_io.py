"""Queries of sources, sinks, generator, read interface and the whole dataflow, each with its DuckDB twin; registered with those of ``catalog``."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..folders import scratch
from ..functions.expressions import epoch_ms, iso_ms, last_match, padded_id
from ..operators import anomaly, dedup, eventtime, quality, windows
from ..sinks.tables import KeyedTable, TopicWriter, append_batch, bootstrap, kafka_rows, lines_of, publish, read_appended, with_ids
from ..sources.events import json_lines, kafka_records, offset_totals, offsets_table, spread, stressed, table, transactions, with_partition
from ..sources.generator import BAD_CURRENCIES, BAD_TYPES, CURRENCIES, TYPES, Profile, generate, generate_stream
from ..sources.topics import manifest_topics
from ..streaming import metrics
from ..streaming.job import StreamJob, window_finals
from . import batch
from .catalog import _AGG, _ANOMALIES, _CL, _RAW, _RAWS, _SO, _ST, _STORED, _TX, _drain, _raws, _reader, _shown, _stored, _stream, _stressed, _twice, query
from .http_api import respond
from .reader import AnalyticsReader

_ID = "concat('00000000-0000-4000-a000-', lpad(CAST({0} AS VARCHAR), 12, '0'))"

# sources


@query("SELECT CAST(CAST(concat('0x', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 6 AS INTEGER) AS partition, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def topic_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_partition(table(spark, sf_dir)).groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {_RAWS} SELECT seq, raw FROM raws")
def kafka_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as Kafka has them, as the engine takes them in."""
    rows = _raws(spark, sf_dir).select(F.col("raw").cast("binary").alias("value"), F.lit(3).alias("partition"), F.col("seq").alias("offset"))
    return kafka_records(rows).select(F.col("offset").alias("seq"), "raw")


@query(f"WITH {_RAWS} SELECT json_extract_string(raw, '$.event_id') AS event_id, count(*) AS n FROM raws WHERE json_valid(raw) GROUP BY 1")
def tolerant_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written out and read back; what is no JSON is skipped."""
    path = scratch(spark, "lines")
    _raws(spark, sf_dir).where("raw not like '% x'").select("raw").unionByName(_raws(spark, sf_dir).where("raw like '% x'").select(F.lit("no json").alias("raw"))).write.text(path)
    found = json_lines(spark, path).select(F.try_variant_get("record", "$.event_id", "string").alias("event_id"))
    return found.groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT 'raw' AS topic, CAST(event_id % 6 AS INTEGER) AS partition, event_id AS \"offset\" FROM events")
def delimited_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "offsets")
    table(spark, sf_dir).select(F.concat_ws(":", F.lit("raw"), F.col("event_id") % 6, "event_id")).write.text(path)
    return offsets_table(spark.read.text(path))


@query("SELECT concat('t', event_id % 4) AS topic, count(*) AS partitions, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def topic_offset_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir).select(F.concat(F.lit("t"), F.col("event_id") % 4, F.lit(":"), F.col("event_id") % 6, F.lit(":"), "event_id").alias("value"))
    return offset_totals(offsets_table(lines))


@query("SELECT count(*) AS partitions, CAST(sum(event_id) AS BIGINT) AS end_total, CAST(sum(event_id * 7 % 1000) AS BIGINT) AS lag_total FROM events")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir).select(F.col("event_id").alias("end_offset"), (F.col("event_id") + F.col("event_id") * 7 % 1000).alias("latest_offset"))
    return metrics.total_lag(rows)


@query("""SELECT user_id, concat('u', user_id, '.', event_type) AS name, CAST(1 + count(*) % 12 AS INTEGER) AS partitions, 3 AS replication_factor,
  concat('cleanup.policy=delete,retention.ms=', 1000 * count(DISTINCT json_extract_string(props, '$.k'))) AS configs FROM events GROUP BY user_id, event_type""")
def topic_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each user, a topic for each type of the user's events, written as text and read back."""
    entry = "  - name: u{0}.{1}\n    partitions: {2}  # by load\n    replication_factor: 3\n    configs:\n      retention.ms: {3}\n\n      cleanup.policy: delete\n"
    kinds = table(spark, sf_dir).groupBy("user_id", "event_type").agg((1 + F.count("*") % 12).alias("n"), (1000 * F.count_distinct(F.get_json_object("props", "$.k"))).alias("kept"))
    text = F.format_string(entry.replace("{0}", "%1$d").replace("{1}", "%2$s").replace("{2}", "%3$d").replace("{3}", "%4$d"), "user_id", "event_type", "n", "kept")
    manifests = kinds.groupBy("user_id").agg(F.concat(F.lit("# topics\ntopics:\n"), F.concat_ws("", F.collect_list(text))).alias("manifest"))  # a line a type of event
    found = manifest_topics(manifests).where("problem is null").drop("problem")
    return found.withColumn("configs", F.array_join(F.transform(F.array_sort(F.map_entries("configs")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("SELECT count(*) AS rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a query's progress reports add up to."""
    folder = scratch(spark, "progress")
    stream = _stream(spark, sf_dir)
    started = stream.writeStream.foreachBatch(lambda rows, n: append_batch(rows, f"{folder}/out", n)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return metrics.progress(started, spark).agg(F.sum("rows").alias("rows"))


# generator

_PROFILE = Profile(records=0, users=50, merchants=20, rate_per_second=200.0, duplicate=0.1, late=0.1, out_of_order=0.3, malformed=0.2, workers=2, seed=7)
_U = "((CAST(concat('0x', substr(md5(concat('7:{0}:', CAST(n AS VARCHAR))), 1, 10)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 1099511627776)"
_u = _U.format


def _one_of(values: tuple[str, ...], salt: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(floor({_u(salt)} * {len(values)}) AS INTEGER) + 1]"


def _generated(semantic: bool) -> str:
    bad, wrong = f"({_u('bad?')} < 0.2)", _u("wrong")
    which = f"CASE WHEN {bad} AND {not semantic} THEN CASE WHEN {wrong} < 0.5 THEN CAST(floor({wrong} * 2 * 4) AS INTEGER) ELSE 4 END END"
    third = f"CASE WHEN {bad} AND {semantic} THEN CAST(floor({wrong} * 3) AS INTEGER) END"
    at = "(1704067200000 + CAST(floor(n * CAST(2.5 AS DOUBLE)) AS BIGINT))"
    back = f"CASE WHEN {_u('late?')} < 0.1 THEN CAST(floor((1 + {_u('lag')} * 119) * 1000) AS BIGINT) ELSE 0 END"
    normal = f"sqrt(-2 * ln({_u('a1')})) * cos(2 * pi() * {_u('a2')})"
    iso = "concat(strftime(make_timestamp(({0}) * 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(({0}) % 1000 AS VARCHAR), 3, '0'), 'Z')"
    return f"""p AS (SELECT event_id AS n, n > 0 AND {_u('swap')} < 0.3 AS swaps, (SELECT count(*) FROM events) AS records FROM events),
      steps AS (SELECT n, CASE WHEN swaps THEN n ELSE coalesce(min(CASE WHEN n > 0 AND NOT swaps THEN n END) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), records) END AS step FROM p),
      again AS (SELECT n * 2 + 1 AS seq, n - CAST(floor({_u('gap')} * least(n, 10000)) AS BIGINT) AS step FROM p WHERE n > 0 AND {_u('again?')} < 0.1),
      sent AS (SELECT n, step * 2 AS seq FROM steps UNION ALL SELECT n, seq FROM again JOIN steps USING (step)),
      judged AS (SELECT *, {which} AS lacks, {third} AS odd, CAST(floor(least(greatest(exp(10.5 + 0.9 * {normal}), 100), 5000000)) AS BIGINT) AS amount, md5(concat('7:', CAST(n AS VARCHAR))) AS h FROM sent)
      SELECT seq, concat_ws('-', h[1:8], h[9:12], concat('4', h[14:16]), concat('a', h[18:20]), h[21:32]) AS event_id, concat('usr_', lpad(CAST(CAST(floor({_u('user')} * 50) AS BIGINT) + 1 AS VARCHAR), 5, '0')) AS user_id,
      CASE WHEN lacks IS DISTINCT FROM 0 THEN concat('merchant_', lpad(CAST(CAST(floor({_u('merchant')} * 20) AS BIGINT) + 1 AS VARCHAR), 4, '0')) END AS merchant_id,
      CASE WHEN lacks IS DISTINCT FROM 1 THEN CASE WHEN odd = 0 THEN -amount ELSE amount END END AS amount, coalesce(lacks = 4, false) AS amount_is_text,
      CASE WHEN lacks IS DISTINCT FROM 2 THEN CASE WHEN odd = 1 THEN {_one_of(BAD_CURRENCIES, 'c')} ELSE {_one_of(CURRENCIES, 'c')} END END AS currency,
      CASE WHEN odd = 2 THEN {_one_of(BAD_TYPES, 't')} ELSE {_one_of(TYPES, 't')} END AS transaction_type,
      CASE WHEN lacks IS DISTINCT FROM 3 THEN {iso.format(f'{at} - {back}')} END AS event_time, {iso.format(at)} AS ingest_time FROM judged"""


def _numbers(spark: SparkSession, sf_dir: str, **changed) -> tuple[Profile, DataFrame]:
    """A profile of one record for each event, whose id is the record's number."""
    events = table(spark, sf_dir)
    return replace(_PROFILE, records=events.count(), **changed), events.select(F.col("event_id").alias("n"))


def _records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _fields(generate(spark, *_numbers(spark, sf_dir, malformed_kind=kind)))


def _fields(raw: DataFrame) -> DataFrame:
    get = lambda f: F.get_json_object("raw", f"$.{f}")
    return raw.select("seq", *[get(f).alias(f) for f in ("event_id", "user_id", "merchant_id")], get("amount").cast("long").alias("amount"), F.col("raw").contains('"amount":"').alias("amount_is_text"), *[get(f).alias(f) for f in ("currency", "transaction_type", "event_time", "ingest_time")])


@query("WITH " + _generated(False))
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, times, amounts, late and repeated records, swaps, fields that lack or have the wrong type."""
    return _records(spark, sf_dir, "structural")


@query("WITH " + _generated(True))
def generated_semantic_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "semantic")


@query("WITH " + _generated(False))
def stream_generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, some thousand steps a micro-batch, or a twentieth of all where that is more: their number doesn't grow with the records."""
    folder, profile = scratch(spark, "generated"), _numbers(spark, sf_dir, malformed_kind="structural")[0]
    query_ = generate_stream(spark, profile, most=max(4_000, -(-profile.records // 20))).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").start()
    query_.processAllAvailable()
    query_.stop()
    return _fields(spark.read.parquet(f"{folder}/out"))


@query(f"""WITH e AS (SELECT i, sum(1 / pow(i, CAST(1.2 AS DOUBLE))) OVER (ORDER BY i) AS s FROM (SELECT range + 1 AS i FROM range(50))), c AS (SELECT i, s / max(s) OVER () AS high FROM e),
  d AS (SELECT {_u('user')} AS u FROM (SELECT event_id AS n FROM events)) SELECT concat('usr_', lpad(CAST(usr + 1 AS VARCHAR), 5, '0')) AS user_id, count(*) AS n FROM (SELECT (SELECT count(*) FROM c WHERE high < u) AS usr FROM d) GROUP BY 1""")
def generated_zipf_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = generate(spark, *_numbers(spark, sf_dir, zipf=True, duplicate=0.0, malformed=0.0))
    return raw.select(F.get_json_object("raw", "$.user_id").alias("user_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT event_id AS n, CASE WHEN {_u('burst?').replace('n AS VARCHAR', 'event_id AS VARCHAR')} < 0.5 THEN 1 ELSE 0 END AS burst FROM events),
  t AS (SELECT n, coalesce(sum(burst) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bursts FROM w)
  SELECT 1704067200000 + CAST(floor((n - bursts + bursts / CAST(4 AS DOUBLE)) * 2.5) AS BIGINT) AS ingest_ms, count(*) AS n FROM t GROUP BY 1""")
def generated_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = generate(spark, *_numbers(spark, sf_dir, burst=0.5, burst_multiplier=4.0, duplicate=0.0, malformed=0.0))
    return raw.select(epoch_ms(F.get_json_object("raw", "$.ingest_time")).alias("ingest_ms")).groupBy("ingest_ms").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS sent, count(*) FILTER (event_id % 17 = 0) AS duplicate, count(*) FILTER (event_id % 41 = 7) AS late, count(*) FILTER (event_id % 37 = 5) AS out_of_order, count(*) FILTER (event_id % 23 < 11 AND event_id % 23 > 0) AS malformed FROM events")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kinds = {"duplicate": n % 17 == 0, "late": n % 41 == 7, "out_of_order": n % 37 == 5, "malformed": (n % 23 < 11) & (n % 23 > 0)}
    return quality.sent_counts(table(spark, sf_dir).withColumns(kinds), list(kinds))


# expressions and text


@query("SELECT event_id, epoch_us(ts) // 1000 - 7200000 AS east_ms, epoch_us(ts) // 1000 AS utc_ms, CAST(NULL AS BIGINT) AS none FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text with Z and with an offset, written and parsed back; text that is no time."""
    shown = iso_ms(F.timestamp_millis("ts_ms"))
    return transactions(spark, sf_dir).select("event_id", epoch_ms(F.regexp_replace(shown, "Z", "+02:00")).alias("east_ms"), epoch_ms(shown).alias("utc_ms"), epoch_ms(F.lit("no time")).alias("none"))


@query("SELECT event_id, concat(strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z') AS iso, concat('usr_', lpad(CAST(user_id AS VARCHAR), 12, '0')) AS padded FROM events")
def iso_text_and_padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("event_id", iso_ms(F.timestamp_millis("ts_ms")).alias("iso"), padded_id("usr_", F.col("user_id"), 12).alias("padded"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + 3 END AS VARCHAR) AS last, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS first FROM events")
def counter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last and the first of several counters in a line, null without one."""
    n = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 5 == 0, "idle").otherwise(F.concat(F.lit("t=1 sent="), n, F.lit(" t=2 sent="), (F.col("event_id") + 3).cast("string"), F.lit(" end")))
    first = F.regexp_extract(line, r"sent=(\d+)", 1)
    return table(spark, sf_dir).select("event_id", last_match(line, r"sent=(\d+)").alias("last"), F.when(first != "", first).alias("first"))


@query("SELECT event_type || CASE WHEN event_id % 3 = 0 THEN '.records-LAG-max' WHEN event_id % 3 = 1 THEN '.heap' ELSE '.currentEmitTime' END AS id, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1")
def metric_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, ".records-LAG-max").when(F.col("event_id") % 3 == 1, ".heap").otherwise(".currentEmitTime")
    return quality.matching_metrics(table(spark, sf_dir).select(F.concat("event_type", name).alias("id"))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_RAWS} SELECT DISTINCT json_extract_string(raw, '$.event_id') AS event_id FROM raws WHERE json_valid(raw) AND json_type(raw, '$.event_id') = 'VARCHAR'")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_ids(_raws(spark, sf_dir).where("raw not like '% x'"))


@query("SELECT DISTINCT event_id % 5000 AS event_id FROM events ORDER BY event_id")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.listing(table(spark, sf_dir).select((F.col("event_id") % 5000).alias("event_id")))


@query(f"WITH {_SO}, w AS ({_AGG.format('so')}) SELECT CAST(user_id AS VARCHAR) AS key, concat('{{\"user_id\":', user_id, ',\"window_start_ms\":', window_start_ms, ',\"transaction_count\":', transaction_count, ',\"total_volume\":', total_volume, '}}') AS value FROM w")
def aggregates_topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and compact JSON of each window, as a topic gets them."""
    sums = windows.aggregates(_stressed(spark, sf_dir, False))
    return kafka_rows(sums.select("user_id", "window_start_ms", "transaction_count", "total_volume"), "user_id")


@query(f"WITH {_CL} SELECT concat('late: {{\"event_id\":', event_id, ',\"ts_ms\":', ts_ms, '}}') AS line FROM cl WHERE lateness = 'late'")
def inspection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(eventtime.classified(_stressed(spark, sf_dir)).where("lateness = 'late'").select("event_id", "ts_ms"), "late")


@query("SELECT concat('{\"latency\":{\"p50_ms\":', CAST(quantile_cont(ms, 0.5) AS BIGINT), ',\"p95_ms\":', CAST(quantile_cont(ms, 0.95) AS BIGINT), ',\"p99_ms\":', CAST(quantile_cont(ms, 0.99) AS BIGINT), '},\"n\":', count(*), '}') AS report FROM (SELECT CAST(event_id * 7919 % 5000 // 1000 * 1000 AS DOUBLE) AS ms FROM events)")
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir).select(F.floor(F.col("event_id") * 7919 % 5000 / 1000).cast("double").alias("s")).select((F.col("s") * 1000).alias("ms"))
    found = quality.percentiles(rows, "ms")
    latency = F.struct(*[F.round(c).cast("long").alias(c) for c in found.columns])
    return found.select(latency.alias("latency")).join(F.broadcast(rows.agg(F.count("*").alias("n"))), F.lit(True)).select(F.to_json(F.struct("latency", "n")).alias("report"))


# quality


@query("WITH a AS (SELECT DISTINCT event_id % 700 AS requested_rate FROM events), b AS (SELECT event_id % 1100 AS requested_rate, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT a.requested_rate, a.requested_rate * 2 AS achieved, b.n AS fresh_n FROM a LEFT JOIN b USING (requested_rate)")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir)
    prior = events.select((F.col("event_id") % 700).alias("requested_rate")).distinct().withColumn("achieved", F.col("requested_rate") * 2)
    fresh = events.where("event_id % 3 = 0").groupBy((F.col("event_id") % 1100).alias("requested_rate")).agg(F.count("*").alias("n"))
    return quality.compare_runs(prior, fresh)


@query("SELECT event_id AS poll, event_id * 3 + event_id % 7 AS sent, event_id * 500 AS at_ms, CASE WHEN event_id > (SELECT min(event_id) FROM events) THEN (sent - lag(sent) OVER (ORDER BY event_id)) / CAST(0.5 AS DOUBLE) END AS per_second FROM (SELECT event_id, event_id * 3 + event_id % 7 AS sent FROM events)")
def summary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return quality.rates(table(spark, sf_dir).select(n.alias("poll"), (n * 3 + n % 7).alias("sent"), (n * 500).alias("at_ms")), "sent", "at_ms")


@query("SELECT event_id, event_id AS seq, user_id FROM events WHERE event_id % 3 <> 0")
def dedup_against_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir).select("event_id", F.col("event_id").alias("seq"), "user_id")
    again = rows.unionByName(rows.withColumn("seq", F.col("seq") + 10**9).withColumn("user_id", F.lit(-1).cast(rows.schema["user_id"].dataType)))
    return dedup.new_arrivals(again, rows.where("event_id % 3 = 0"))


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) + 41 AS serial FROM events")
def serial_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir).select("event_id", "user_id"), "serial", ["user_id", "event_id"], first=42).select("event_id", "serial")


# read interface


@query(f"WITH {_TX}, {_STORED} SELECT * FROM stored WHERE user_id = 7 AND ts_ms BETWEEN (SELECT min(ts_ms) FROM tx) + 3600000 AND (SELECT max(ts_ms) FROM tx) - 3600000 ORDER BY ts_ms DESC, event_id DESC LIMIT 200")
def user_transactions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import UTC, datetime

    lo, hi = transactions(spark, sf_dir).agg(F.min("ts_ms"), F.max("ts_ms")).first()
    at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC)
    return _shown(_reader(spark, sf_dir).user_transactions_query(7, 200, start_time=at(lo + 3_600_000), end_time=at(hi - 3_600_000)))


@query(f"WITH {_SO} SELECT window_start_ms, window_end_ms, user_id, transaction_count, total_volume, average_transaction_value FROM ({_AGG.format('so')}) WHERE user_id = 3 ORDER BY window_start_ms DESC LIMIT 20 OFFSET 20")
def user_aggregates_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return reader.user_aggregates_query(3, 20, reader.user_aggregates(3, 20).next_cursor).drop("window_start", "window_end")


_CURSOR = "translate(rtrim(translate(to_base64(encode(concat(strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'), '000Z'{1}))), '=', ' ')), '+/', '-_')"
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS place FROM stored)"


@query(f"WITH {_TX}, {_STORED}, {_PLACED}, ends AS (SELECT user_id, max(CASE WHEN place = 5 THEN {_CURSOR.format('ts_ms', ', chr(44), event_id')} END) AS full_page, max(CASE WHEN place = 200 THEN {_CURSOR.format('ts_ms', ', chr(44), event_id')} END) AS long_page FROM placed GROUP BY user_id) SELECT * FROM ends UNION ALL SELECT -1, NULL, NULL")
def next_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full page of any user has a cursor for the next; a short or empty one has none."""
    reader = _reader(spark, sf_dir)
    users = table(spark, sf_dir).select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"))).withColumn("request_id", F.col("user_id"))
    five, many = (reader.user_transactions_pages(users, n).select("user_id", F.col("next_cursor").alias(name)) for n, name in ((5, "full_page"), (200, "long_page")))
    return five.join(many, "user_id")


@query(f"WITH {_TX}, {_STORED}, {_PLACED} SELECT user_id, event_id, amount, place - 5 AS place, CASE WHEN last >= 10 THEN {_CURSOR.format('ms', ', chr(44), id')} END AS next_cursor FROM (SELECT *, max(place) OVER (PARTITION BY user_id) AS last, max(CASE WHEN place = 10 THEN ts_ms END) OVER (PARTITION BY user_id) AS ms, max(CASE WHEN place = 10 THEN event_id END) OVER (PARTITION BY user_id) AS id FROM placed) WHERE place BETWEEN 6 AND 10")
def second_pages_of_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every user's events, asked for by the first one's cursor."""
    reader = _reader(spark, sf_dir)
    users = table(spark, sf_dir).select("user_id").distinct().withColumn("request_id", F.col("user_id"))
    first = reader.user_transactions_pages(users, 5).where("next_cursor is not null").select("request_id", "user_id", F.col("next_cursor").alias("cursor"))
    found = reader.user_transactions_pages(first, 5).select("user_id", "next_cursor", F.posexplode("items").alias("nth", "item"))
    return found.select("user_id", "item.event_id", "item.amount", (F.col("nth") + 1).cast("long").alias("place"), "next_cursor")


@query(f"""WITH {_SO}, sums AS ({_AGG.format('so')}), bounds AS (SELECT user_id, min(window_start_ms) + 20000 AS least, max(window_start_ms) - 20000 AS most FROM sums GROUP BY user_id),
  fit AS (SELECT sums.*, row_number() OVER (PARTITION BY sums.user_id ORDER BY window_start_ms DESC) AS place FROM sums JOIN bounds USING (user_id) WHERE window_start_ms BETWEEN least AND most)
  SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(transaction_count) AS BIGINT) AS transactions, CASE WHEN count(*) = 50 THEN {_CURSOR.format('min(window_start_ms)', '')} END AS next_cursor FROM fit WHERE place <= 50 GROUP BY user_id""")
def aggregate_pages_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's first page of windows inside times of their own."""
    reader = _reader(spark, sf_dir)
    span = F.expr("interval 20 seconds")
    asked = reader.aggregates.groupBy("user_id").agg((F.min("window_start") + span).alias("start_time"), (F.max("window_start") - span).alias("end_time")).withColumn("request_id", F.col("user_id"))
    found = reader.user_aggregates_pages(asked).where(F.size("items") > 0)
    return found.select("user_id", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["transaction_count"]).alias("transactions"), "next_cursor")


_CASES = (
    "/health", "/nothing", "/users/7/transactions", "/users/7/transactions?limit=0", "/users/7/transactions?limit=201", "/users/7/transactions?limit=many", "/users/7/transactions?cursor=a$", "/users/7/transactions?cursor=", "/users/7/transactions?start_time=2024-01-01T00:00:00", "/users/7/transactions?end_time=then", "/users/7/aggregates?cursor=bm90aGluZw", "/users/7/anomalies?anomaly_type=ANOMALY_OTHER", "/anomalies?anomaly_type=ANOMALY_AMOUNT", "/anomalies?cursor=MjAyNC0wMS0wMVQwMDowMDowMFoseA",
)
# rules on the request itself: its path, then each parameter, a limit and times that don't parse first
_STATUS = """WITH c(path) AS (VALUES {cases}), p AS (SELECT path, split_part(path, '?', 1) AS place, regexp_extract(path, '[?&]limit=([^&]*)', 1) AS lim, regexp_extract(path, '[?&]cursor=([^&]*)', 1) AS cur, regexp_extract(path, '[?&](?:start|end)_time=([^&]*)', 1) AS moment,
  regexp_extract(path, '[?&]anomaly_type=([^&]*)', 1) AS kind, path LIKE '%limit=%' AS limited FROM c)
  SELECT path, CAST(CASE WHEN place = '/health' THEN 200 WHEN NOT regexp_full_match(place, '/anomalies|/users/[^/]+/(transactions|aggregates|anomalies)') THEN 404
  WHEN limited AND coalesce(TRY_CAST(lim AS INTEGER) NOT BETWEEN 1 AND 200, true) THEN 422 WHEN moment <> '' AND TRY_CAST(moment AS TIMESTAMP) IS NULL THEN 422 WHEN moment <> '' AND NOT regexp_matches(moment, '(Z|[+-][0-9:]+)$') THEN 400
  WHEN cur <> '' AND (NOT regexp_full_match(cur, '[A-Za-z0-9_-]+') OR NOT regexp_full_match(decode(from_base64(rpad(cur, CAST(ceil(length(cur) / 4.0) * 4 AS INTEGER), '='))), CASE WHEN place LIKE '%anomalies' THEN '[^,]+,[0-9]+' WHEN place LIKE '%aggregates' THEN '[0-9T:.Z+-]+' ELSE '[^,]+,[0-9a-f-]{{36}}' END)) THEN 400
  WHEN kind <> '' AND kind NOT IN ('ANOMALY_VELOCITY', 'ANOMALY_AMOUNT') THEN 400 ELSE 200 END AS INTEGER) AS status FROM p"""


@query(_STATUS.format(cases=", ".join(f"('{path}')" for path in _CASES)))
def api_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return spark.createDataFrame([(path, respond(reader, path)[0]) for path in _CASES], "path string, status int")


@query(f"WITH {_TX}, {_STORED} SELECT event_id, user_id, merchant_id, amount, transaction_type, true AS same FROM stored WHERE user_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 50")
def api_rows_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the interface answers, field by field against the table."""
    items = respond(_reader(spark, sf_dir), "/users/7/transactions")[1]["items"]
    stored = _stored(spark, sf_dir)
    plain = [c for c in stored.columns if c != "event_time"]
    answered = spark.createDataFrame([tuple(i[c] for c in stored.columns) for i in items], stored.schema)
    other = stored.select(F.col("event_id"), *[F.col(c).alias(f"_{c}") for c in stored.columns if c != "event_id"])
    same = F.lit(True)
    for c in stored.columns:
        if c != "event_id":
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return F.broadcast(answered).join(other, "event_id").select(*plain, same.alias("same"))


# sinks


@query(f"""WITH {_SO}, sums AS ({_AGG.format('so')}) SELECT 'events' AS name, 10 AS columns, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM so UNION ALL SELECT 'user_aggregates', 7, count(*), CAST(sum(total_volume) AS BIGINT) FROM sums
  UNION ALL SELECT 'anomalies', 11, count(*), CAST(sum(amount) AS BIGINT) FROM ({_ANOMALIES}) UNION ALL SELECT 'schema_migrations', 2, 1, NULL""")
def bootstrapped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made twice over an old shell, with all events, windows and anomalies put into them; columns, rows and sums of each."""
    name, reader = f"made_{uuid.uuid4().hex}", _reader(spark, sf_dir)
    now, null = F.current_timestamp(), lambda kind: F.lit(None).cast(kind)
    held = {
        "events": reader.events.withColumns({"currency": null("string"), "ingest_time": F.col("event_time"), "schema_version": F.lit(1), "received_at": now}),
        "user_aggregates": reader.aggregates.withColumn("updated_at", now), "anomalies": reader.anomalies,
    }
    sums = {"events": "amount", "user_aggregates": "total_volume", "anomalies": "amount"}
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(spark, 'db')}'")
    try:
        spark.sql(f"CREATE TABLE {name}.events (old INT) USING parquet")
        for _ in range(2):
            bootstrap(spark, name)
        for table_, rows in held.items():
            publish(rows, table_, name)
        bootstrap(spark, name)  # leaves what is there
        stored = [spark.table(f"{name}.{t.name}") for t in spark.catalog.listTables(name)]
        names = [t.name for t in spark.catalog.listTables(name)]
        found = [t.agg(F.lit(n).alias("name"), F.lit(len(t.columns)).alias("columns"), F.count("*").alias("n"), F.sum(sums[n] if n in sums else null("long")).cast("long").alias("total")) for n, t in zip(names, stored, strict=True)]
        path = scratch(spark, "bootstrapped")
        reduce(DataFrame.unionByName, found).write.parquet(path)  # the tables go, these rows stay
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.read.parquet(path)


@query(f"WITH {_RAWS} SELECT concat('{{\"reason_code\":\"', reason_code, '\",\"seq\":', seq, '}}') AS value FROM judged WHERE reason_code IS NOT NULL")
def dead_letter_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import validate

    topic = TopicWriter(scratch(spark, "topic"))
    rows = validate.with_reason(_raws(spark, sf_dir)).where("reason_code is not null").select("reason_code", "seq")
    for _ in range(2):  # a batch that comes twice is there once
        topic.write(rows, 0)
    return read_appended(spark, topic.location).select("value")


# watermarks of partitions, windows at their close, tables by key

_P = "CAST(concat('0x', substr(md5(CAST(events.user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 6"
_FED = _ST + f""", fed AS (SELECT st.event_id, st.seq, {_P} AS partition, st.ts_ms - CASE WHEN {_P} = 1 THEN 20000 ELSE 0 END AS ts_ms, 1704067200000 + st.event_id * 600 AS arrival_ms FROM st JOIN events USING (event_id)
  WHERE NOT ({_P} = 2 AND st.event_id BETWEEN (SELECT count(*) // 3 FROM events) AND (SELECT count(*) // 3 * 2 FROM events)))"""


def _clocks() -> str:
    """The watermark after each record: what the partitions that are active have reached, before and with the record."""
    own = "OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
    sides = {"b": own.format("1 PRECEDING"), "w": own.format("CURRENT ROW")}
    tops = [f"max(CASE WHEN partition = {p} THEN ts_ms END) {frame} AS t{side}{p}" for side, frame in sides.items() for p in range(6)]
    heard = [f"coalesce(max(CASE WHEN partition = {p} THEN arrival_ms END) {frame}, min(arrival_ms) OVER ()) AS a{side}{p}" for side, frame in sides.items() for p in range(6)]
    since = [f"least(arrival_ms - 30000, greatest({', '.join(f'a{side}{p}' for p in range(6))}) - 1) AS since{side}" for side in sides]
    low = {side: f"CASE WHEN {' OR '.join(f'(a{side}{p} > since{side} AND t{side}{p} IS NULL)' for p in range(6))} THEN NULL ELSE least({', '.join(f'CASE WHEN a{side}{p} > since{side} THEN t{side}{p} END' for p in range(6))}) END" for side in sides}
    return f"""{_FED}, r AS (SELECT *, {', '.join(tops + heard)} FROM fed), q AS (SELECT *, {', '.join(since)} FROM r), l AS (SELECT *, greatest({low['b']}, {low['w']}) AS low FROM q),
  wm AS (SELECT event_id, seq, partition, ts_ms, max(low) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - 51 AS watermark_ms FROM l)"""


@query(f"""WITH {_clocks()} SELECT event_id, CAST(partition AS INTEGER) AS partition, ts_ms, watermark_ms,
  CASE WHEN watermark_ms IS NULL THEN 'on_time' WHEN watermark_ms - ts_ms > 45000 THEN 'late' WHEN ts_ms // 10000 * 10000 + 9999 <= watermark_ms THEN 'dropped' ELSE 'on_time' END AS lateness FROM wm""")
def partition_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six partitions, of which one lags by 20 s and one is silent for the middle third."""
    events = table(spark, sf_dir)
    third = events.count() // 3
    placed = with_partition(events.select("event_id", "user_id")).select("event_id", "partition")
    fed = _stressed(spark, sf_dir).join(placed, "event_id").where(~((F.col("partition") == 2) & F.col("event_id").between(third, 2 * third)))
    fed = fed.withColumns({"ts_ms": F.col("ts_ms") - F.when(F.col("partition") == 1, 20_000).otherwise(0), "arrival_ms": F.lit(1_704_067_200_000) + F.col("event_id") * 600})
    marked = eventtime.classified_by_partition(fed, eventtime.PartitionClock(6))
    return marked.select("event_id", "partition", "ts_ms", "watermark_ms", "lateness")


@query(f"WITH {_CL}, ot AS (SELECT * FROM cl WHERE lateness = 'on_time') SELECT * FROM ({_AGG.format('ot')}) WHERE window_end_ms - 1 <= (SELECT max(watermark_ms) FROM cl)")
def windows_at_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.closed(eventtime.classified(_stressed(spark, sf_dir)))


@query(f"WITH {_SO} SELECT * FROM ({_AGG.format('so')}) WHERE window_end_ms <= (SELECT max(ts_ms) FROM so) - 50")
def stream_windows_at_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In append mode: what is over is emitted once, what is open isn't."""
    folder = scratch(spark, "stream")
    events = stressed(_stream(spark, sf_dir), False).withColumn("event_time", F.timestamp_millis("ts_ms"))
    _drain(window_finals(events), lambda rows, batch: append_batch(rows, f"{folder}/windows", batch), folder, "append")
    return read_appended(spark, f"{folder}/windows").drop("batch_id")


def _by_key(spark: SparkSession, sf_dir: str, batches: int = 10) -> KeyedTable:
    """The events as a table by user and time, upserted in parts, each with some of the one before again, and merged in between."""
    stored = KeyedTable(spark, scratch(spark, "keyed"), ["event_id"], keep=["batch"], stable=["user_id", "event_time"], buckets=8)
    rows = _stored(spark, sf_dir).withColumn("n", F.substring("event_id", 25, 12).cast("long"))
    for k in range(batches):
        part = rows.where((F.col("n") % batches == k) | ((F.col("n") % batches == k - 1) & (F.col("n") % 3 == 0)))
        stored.upsert(part.select("event_id", "user_id", "merchant_id", "amount", "transaction_type", "event_time", F.lit(k).alias("batch")), k)
        stored.compact()
    return stored


@query(f"WITH {_TX}, {_STORED} SELECT *, CAST(CAST(event_id[25:] AS BIGINT) % 10 AS INTEGER) AS batch FROM stored")
def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a table whose segments were merged between batches: each event once, with the batch that first brought it."""
    return _shown(_by_key(spark, sf_dir).read())


@query(f"WITH {_TX}, {_STORED} SELECT * FROM stored WHERE user_id = 7 AND ts_ms <= (SELECT max(ts_ms) FROM tx) - 3600000 ORDER BY ts_ms DESC, event_id DESC LIMIT 50")
def keyed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of such a table, as the read interface asks for it: one bucket's files, and of those what the time's range meets."""
    from datetime import UTC, datetime

    stored, last = _by_key(spark, sf_dir), transactions(spark, sf_dir).agg(F.max("ts_ms")).first()[0]

    def rows(user, start, end):
        return stored.read(at=user, between={"event_time": (None, None if end is None else int(end.timestamp() * 1000) * 1000)})

    page = AnalyticsReader(rows, rows, rows, spark).user_transactions_query(7, 50, end_time=datetime.fromtimestamp((last - 3_600_000) / 1000, UTC))
    return _shown(page.drop("batch"))


# the dataflow as a whole: records with faults, repeats, late ones

_DF_RAW = """CASE WHEN event_id % 23 = 1 THEN concat('{"event_id":"', event_id, '","user_id"') WHEN event_id % 23 = 2 THEN concat('[', event_id, ']')
  WHEN event_id % 23 = 3 THEN concat('{"event_id":"x', event_id, '","user_id":"u","merchant_id":"m","amount":1,"currency":"USD","transaction_type":"t","event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","schema_version":1}') END"""
_DF = _ST + """, ok AS (SELECT * FROM st WHERE event_id % 23 NOT IN (1, 2, 3)), wm AS (SELECT *, max(ts_ms) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - 51 AS watermark_ms FROM ok),
  cl AS (SELECT *, CASE WHEN watermark_ms - ts_ms > 45000 THEN 'late' WHEN ts_ms // 10000 * 10000 + 9999 <= watermark_ms THEN 'dropped' ELSE 'on_time' END AS lateness FROM wm),
  df AS (SELECT """ + _ID.format("event_id") + """ AS event_id, concat('u', user_id) AS user_id, merchant_id, amount, 'USD' AS currency, transaction_type, ts_ms, lateness FROM cl)"""
_DEAD = f"WITH r AS (SELECT event_id, {_DF_RAW} AS raw_record FROM events) SELECT CASE event_id % 23 WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'invalid_type:root' ELSE 'unparseable:event_id' END AS reason_code, raw_record FROM r WHERE raw_record IS NOT NULL"
_DF_EVENTS = f"WITH {_DF} SELECT event_id, user_id, merchant_id, amount, currency, transaction_type, ts_ms FROM df"
_DF_LATE = _DF_EVENTS + " WHERE lateness = 'late'"
_DF_AGG = f"WITH {_DF}, ot AS (SELECT * FROM df WHERE lateness = 'on_time') {_AGG.format('ot')}"
_DF_ANOMALIES = f"""WITH {_SO}, a AS (SELECT anomaly_type, {_ID.format('event_id')} AS event_id, concat('u', user_id) AS user_id, transaction_count, velocity_window_seconds, velocity_threshold, amount, rolling_99th_percentile, history_size FROM ({_ANOMALIES})) SELECT * FROM a"""


def _raw_records(tx: DataFrame, faulty: bool = True, doubled: bool = True) -> DataFrame:
    """seq and raw of transactions: one record in 23 faulty in each of three ways, one in 17 sent again later."""
    n, tx = F.col("event_id"), spread(tx, "seq")
    iso = iso_ms(F.timestamp_millis("ts_ms"))
    record = F.to_json(F.struct(
        F.expr(_ID.format("event_id").replace("VARCHAR", "STRING")).alias("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), "merchant_id", "amount", "currency", "transaction_type",
        iso.alias("event_time"), iso.alias("ingest_time"), "schema_version",
    ))
    sent = tx.select("seq", (F.coalesce(F.expr(_DF_RAW), record) if faulty else record).alias("raw"), n)
    again = sent.where("event_id % 17 = 0 and event_id % 23 not in (1, 2, 3)").withColumn("seq", F.col("seq") + 10**9)
    return (sent.unionByName(again) if doubled else sent).select("seq", "raw")


def _dataflow(spark: SparkSession, sf_dir: str) -> batch.Outputs:
    return batch.run(_raw_records(_stressed(spark, sf_dir)))


_EVENT_COLUMNS = ("event_id", "user_id", "merchant_id", "amount", "currency", "transaction_type", "ts_ms")


@query(_DEAD)
def dataflow_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataflow(spark, sf_dir).dead_letters


@query(_DF_EVENTS)
def dataflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataflow(spark, sf_dir).events.select(*_EVENT_COLUMNS)


@query(_DF_LATE)
def dataflow_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataflow(spark, sf_dir).late.select(*_EVENT_COLUMNS)


@query(_DF_AGG)
def dataflow_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataflow(spark, sf_dir).aggregates


@query(_DF_ANOMALIES)
def dataflow_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of time, so that SQL can tell them as well."""
    return batch.run(_raw_records(_stressed(spark, sf_dir, False), faulty=False)).anomalies


def _ran(spark: SparkSession, sf_dir: str, disorder: bool = True) -> StreamJob:
    """The streaming job over the records as a stream of one folder a micro-batch; the second batch brings the repeats."""
    folder = scratch(spark, "job")
    tx = _stressed(spark, sf_dir, disorder)
    raw = _raw_records(tx, faulty=disorder)
    for k in range(2):
        raw.where((F.col("seq") >= 10**9) == (k == 1)).write.json(f"{folder}/in/{k}")
        stream = spark.readStream.schema("seq long, raw string").json(f"{folder}/in/*")
        job = StreamJob(spark, f"{folder}/out", remember=None)  # a repeat is one, however long the first batch takes
        job.start(stream, f"{folder}/checkpoint").awaitTermination()
    if not disorder:
        job.start_anomalies(f"{folder}/checkpoint_anomalies").awaitTermination()
    return job


@query(_DEAD)
def stream_dataflow_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_appended(spark, f"{_ran(spark, sf_dir).out}/dead_letters").drop("batch_id")


@query(_DF_EVENTS)
def stream_dataflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, sf_dir).events.read().withColumn("ts_ms", F.unix_millis("event_time")).select(*_EVENT_COLUMNS)


@query(_DF_LATE)
def stream_dataflow_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_appended(spark, f"{_ran(spark, sf_dir).out}/late").select(*_EVENT_COLUMNS)


@query(_DF_AGG + "")
def stream_dataflow_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, sf_dir).aggregates().drop("window_start", "window_end", "updated_at")


@query(f"WITH {_DF}, ot AS (SELECT * FROM df WHERE lateness = 'on_time') SELECT * FROM ({_AGG.format('ot')}) WHERE window_end_ms - 1 <= (SELECT max(watermark_ms) FROM cl)")
def stream_dataflow_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the job emitted at their close."""
    return _ran(spark, sf_dir).closed().drop("closed_at_ms")


@query(f"SELECT *, row_number() OVER (ORDER BY event_id, anomaly_type) AS anomaly_id FROM ({_DF_ANOMALIES})")
def stream_dataflow_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, sf_dir, disorder=False).anomalies().drop("detected_at")


@query(f"""WITH {_DF}, ot AS (SELECT * FROM df WHERE lateness = 'on_time') SELECT window_start_ms, transaction_count, total_volume, average_transaction_value FROM ({_AGG.format('ot')}) WHERE user_id = 'u3' ORDER BY window_start_ms DESC LIMIT 200""")
def stream_dataflow_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that the read interface serves from the streaming job's tables."""
    page = _ran(spark, sf_dir).reader().user_aggregates_query("u3", 200)
    return page.select(F.unix_millis("window_start").alias("window_start_ms"), "transaction_count", "total_volume", "average_transaction_value")


@query("SELECT count(DISTINCT event_id) AS raw_unique, count(DISTINCT event_id) FILTER (event_id % 23 <> 3) AS landed_unique, count(DISTINCT event_id) FILTER (event_id % 23 = 3) AS dead_unique, CAST(0 AS BIGINT) AS unaccounted, CAST(0 AS BIGINT) AS landed_duplicates FROM events WHERE event_id % 23 NOT IN (1, 2)")
def stream_dataflow_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that came in against ids that landed or died."""
    job = _ran(spark, sf_dir)
    raw = quality.text_ids(_raw_records(_stressed(spark, sf_dir)))
    dead = quality.text_ids(read_appended(spark, f"{job.out}/dead_letters"), "raw_record")
    return quality.reconcile(raw, job.events.read(), dead)
