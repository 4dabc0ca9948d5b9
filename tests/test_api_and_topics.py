import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from rillflow.operators import quality
from rillflow.plans.http_api import respond, serve
from rillflow.plans.reader import AnalyticsReader
from rillflow.sinks.tables import bootstrap
from rillflow.sources.generator import Profile, generate
from rillflow.sources.topics import Topic, manifest_topics, range_options, read_manifest


@pytest.fixture(scope="module")
def reader(spark):
    n = spark.range(5)
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 1000)
    ids = F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    events = n.select(ids.alias("event_id"), F.lit("u 1").alias("user_id"), at.alias("event_time"))
    sums = n.select(F.lit("u 1").alias("user_id"), at.alias("window_start"))
    found = n.select(F.col("id").alias("anomaly_id"), F.lit("ANOMALY_AMOUNT").alias("anomaly_type"), F.lit("u 1").alias("user_id"), at.alias("detected_at"))
    return AnalyticsReader(events, sums, found)


@pytest.mark.parametrize("path, status", [
    ("/health", 200), ("/nothing", 404), ("/users/u%201/transactions?limit=3", 200), ("/users/u%201/aggregates?start_time=2023-11-14T22:13:21Z", 200), ("/users/u%201/anomalies?anomaly_type=ANOMALY_AMOUNT", 200),
    ("/anomalies?limit=0", 422), ("/anomalies?limit=x", 422), ("/anomalies?cursor=a$", 400), ("/anomalies?anomaly_type=X", 400), ("/users/u/transactions?start_time=2024-01-01T00:00:00", 400), ("/users/u/transactions?end_time=x", 422),
])
def test_status(reader, path, status):
    assert respond(reader, path)[0] == status


def test_over_the_wire(reader):
    server = serve(reader, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        one = json.load(urllib.request.urlopen(f"{base}/users/u%201/transactions?limit=3"))
        two = json.load(urllib.request.urlopen(f"{base}/users/u%201/transactions?limit=3&cursor={one['next_cursor']}"))
        assert len(one["items"]) == 3 and len(two["items"]) == 2 and two["next_cursor"] is None
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/x")
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        serve(reader, port=-1)


def test_engine_failures_are_503(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("x")).cast("string").alias("user_id"), F.lit("e").alias("event_id"), F.current_timestamp().alias("event_time"))
    assert respond(AnalyticsReader(broken, broken, broken), "/users/u/transactions")[0] == 503


def test_manifest():
    text = "# topics\ntopics:\n  - name: raw\n    partitions: 6\n    replication_factor: 1\n    configs:\n      retention.ms: 5 # note\n      cleanup.policy: delete\n\n  - name: late\n    partitions: 2\n"
    assert read_manifest(text) == [Topic("raw", 6, 1, {"retention.ms": "5", "cleanup.policy": "delete"}), Topic("late", 2)]
    for bad in ("topics:\n  - name: x\n    partitions: 0\n", "topics:\n  nonsense\n", "topics:\n  - name: x\n    partitions: many\n"):
        with pytest.raises(ValueError):
            read_manifest(bad)
    assert json.loads(range_options("raw", {1: (5, 9), 0: (0, 3)})["endingOffsets"]) == {"raw": {"0": 3, "1": 9}}


def test_many_manifests(spark):
    texts = [(1, "topics:\n  - name: a\n    configs:\n      x.y: 1\n  - name: b\n    partitions: 3\n"), (2, None), (3, "topics:\n  - name: a\n    partitions: 0\n"), (4, "topics:\n  - name: a\n    colour: red\n"), (5, "")]
    found = manifest_topics(spark.createDataFrame(texts, "name long, manifest string").withColumnRenamed("name", "id")).collect()
    assert sorted((r["id"], r["name"], r["partitions"], r["replication_factor"], r["configs"]) for r in found if r["problem"] is None) == [(1, "a", 1, 1, {"x.y": "1"}), (1, "b", 3, 1, {})]
    assert sorted(r["id"] for r in found if r["problem"]) == [3, 4] and all(r["name"] is None for r in found if r["problem"])


def test_recovery_and_report(spark):
    polls = spark.createDataFrame([(0, 1, 0), (1, 1, 10), (2, 1, 20), (3, 5, 30), (4, 5, 40), (5, 5, 50)], "poll int, v long, at long")
    assert tuple(quality.recovery(polls, "v", "at", 20).first()) == (20, 50, 30)
    assert quality.recovery(polls, "v", "at", 45).first()["recovery_time_ms"] is None
    events = spark.range(3).select(F.timestamp_millis("id").alias("event_time"), F.timestamp_millis(F.col("id") + 7).alias("received_at"))
    ids = spark.range(3).select(F.col("id").cast("string").alias("event_id"))
    report = quality.level_report(polls.select(F.col("at").alias("at_ms"), F.col("v").alias("total")), spark.range(4).select(F.col("id").alias("ms")), events, quality.reconcile(ids, ids, ids.limit(0))).first()
    assert report["latency"]["p50_ms"] == 7.0 and report["reconciliation"]["unaccounted"] == 0 and report["checkpoints"]["n"] == 4 and report["throughput"]["delta"] == 4
    counts = quality.sent_counts(spark.createDataFrame([(True, False), (True, True)], "late boolean, malformed boolean"), ["late", "malformed"]).first()
    assert tuple(counts) == (2, 2, 1)


def test_bursts_shorten_the_stream(spark):
    last = lambda p: generate(spark, p).select(F.max(F.get_json_object("raw", "$.ingest_time"))).first()[0]
    assert last(Profile(records=400, burst=0.5, seed=1)) < last(Profile(records=400, seed=1))
    with pytest.raises(ValueError):
        Profile(records=1, burst_multiplier=0.5)


def test_bootstrap_may_run_again(spark, tmp_path):
    spark.sql(f"CREATE DATABASE again LOCATION '{tmp_path}'")
    spark.sql("CREATE TABLE again.events (old INT) USING parquet")
    for _ in range(2):
        bootstrap(spark, "again")
    assert "event_id" in spark.table("again.events").columns and spark.table("again.schema_migrations").count() == 1
    spark.sql("DROP DATABASE again CASCADE")
