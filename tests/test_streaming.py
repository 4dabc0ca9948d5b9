import json
import re
import time
from dataclasses import replace
from datetime import UTC, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rillflow import folders
from rillflow.operators import anomaly, dedup, eventtime, quality, validate, windows
from rillflow.plans import batch, catalog_io
from rillflow.plans.http_api import respond
from rillflow.sources.events import json_lines, kafka_records, offset_range, offset_totals, offsets_table, raw_stream, with_partition
from rillflow.sources import generator
from rillflow.sources.generator import FAULTY, Profile, generate
from rillflow.sinks import tables
from rillflow.sinks.tables import TopicWriter, bootstrap, read_appended
from rillflow.streaming import job as streaming_job, metrics, stateful
from rillflow.streaming.job import StreamJob, supervised, window_updates, with_seq

PROFILE = Profile(records=900, users=5, duplicate=0.1, late=0.1, out_of_order=0.1, malformed=0.1, seed=4)


@pytest.fixture(scope="module")
def records(spark):
    return generate(spark, PROFILE).persist()


def rows(df, *names):
    return sorted(map(str, df.select(*names).collect()))


def test_generator_is_seeded_and_faulty(spark, records):
    again = generate(spark.newSession(), PROFILE).repartition(3)
    assert sorted(r["raw"] for r in again.collect()) == sorted(r["raw"] for r in records.collect())
    assert FAULTY.users == 5 and 900 < records.count() < 1100 and records.select("seq").distinct().count() == records.count()
    with pytest.raises(ValueError):
        Profile(records=1, late=0.1, late_max_s=0)
    with pytest.raises(ValueError):
        Profile(records=1, late=2)
    semantic = generate(spark, Profile(records=300, malformed=1.0, malformed_kind="semantic", zipf=True))
    assert batch.run(semantic).dead_letters.count() == 0


def one_by_one(p):
    """(seq, n) as a sender with one slot sends them."""
    drawn = lambda salt, n: generator._drawn(p.seed, salt, n)
    sent, held, out = {}, 0, []
    for step in range(1, p.records + 1):
        if step < p.records and drawn("swap", step) < p.out_of_order:
            sent[step] = step
        else:
            sent[step], held = held, step
        out.append((2 * step, sent[step]))
        if step < p.records and drawn("again?", step) < p.duplicate:
            out.append((2 * step + 1, sent[step - int(drawn("gap", step) * min(step, generator.RESENT_FROM))]))
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_the_slot_holds_one_back(spark, rate, monkeypatch):
    monkeypatch.setattr(generator, "CHUNK", 37)
    p = Profile(records=400, users=9, out_of_order=rate, duplicate=0.2, burst=0.3, burst_multiplier=4.0, seed=8)
    want = one_by_one(p)
    ids = {r["n"]: r["event_id"] for r in spark.range(400).select(F.col("id").alias("n"), F.md5(F.concat_ws(":", F.lit("8"), F.col("id").cast("string"))).alias("event_id")).collect()}
    got = [(r["seq"], json.loads(r["raw"])["event_id"].replace("-", "")) for r in generate(spark, p).orderBy("seq").collect()]
    shape = lambda h: h[:12] + "4" + h[13:16] + "a" + h[17:]
    assert got == [(seq, shape(ids[n])) for seq, n in want] and len({s for s, _ in got}) == len(got)
    assert [(s, n) for s, n, _ in generator.Sender(p).steps(0, 401, 0)] == want


def test_a_stream_of_records_stopped_and_started_equals_the_batch(spark, tmp_path):
    p = Profile(records=700, users=9, out_of_order=0.3, duplicate=0.1, late=0.1, malformed=0.1, burst=0.4, burst_multiplier=4.0, seed=6)
    for rounds in range(2):  # the second one finds nothing more
        query = generator.generate_stream(spark, p, most=150).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").start()
        query.processAllAvailable()
        if rounds == 0:
            assert query.lastProgress["batchId"] >= 4
        query.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "raw") == rows(generate(spark, p), "seq", "raw")
    middle = generator.TickReader({"profile": json.dumps(p.__dict__)})
    whole = list(middle.read(generator.Steps(0, 701, 0)))
    assert [x for part in middle.partitions({"step": 0, "bursts": 0}, {"step": 701, "bursts": 0}) for x in middle.read(part)] == whole
    clocked = generator.TickReader({"profile": json.dumps({**p.__dict__, "rate_per_second": 10.0}), "clocked": "true"})
    assert clocked.latestOffset()["step"] <= 2


def test_a_task_of_the_sender_takes_time_by_its_steps():
    p = Profile(records=10**6, out_of_order=0.3, duplicate=0.1, burst=0.5, seed=7)
    sender, began = generator.Sender(p), time.process_time()
    got = list(sender.steps(50_000, 70_000, 11))
    assert time.process_time() - began < 8  # was 20 s: each record looked through all that were counted
    assert got[:500] == [x for x in sender.steps(50_000, 50_600, 11)][:500]
    waits = {n: b for _, n, b in got}
    some = sorted(waits)
    assert all(waits[b] - waits[a] == sum(map(sender.burst, range(a, b))) for a, b in zip(some, some[1:]))
    parts = generator.TickReader({"profile": json.dumps(Profile(records=10**7).__dict__)}).partitions({"step": 0, "bursts": 0}, {"step": 10**6, "bursts": 0})
    assert max(s.end - s.start for s in parts) <= generator.MOST_STEPS and sum(s.end - s.start for s in parts) == 10**6


def test_micro_batches_of_generated_records_dont_grow_in_number(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog_io, "generate_stream", lambda spark, p, most: asked.append((p.records, most)) or spark.range(0))
    for n in (1000, 500_000):
        spark.range(n).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/{n}/events.parquet")
        with pytest.raises(Exception):  # noqa: B017  what is given here is no stream
            catalog_io.stream_generated_records(spark, f"{tmp_path}/{n}")
    assert [n / most <= 20 for n, most in asked] == [True, True] and asked[0][1] == 4_000


def test_no_code_of_the_generator_is_too_large(spark):
    plain = spark.newSession()
    plain.conf.set("spark.sql.adaptive.enabled", "false")  # shows all stages before they run
    plan = quality.text_ids(generate(plain, FAULTY))._jdf.queryExecution().executedPlan()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))
    assert sizes and all(0 < int(n) < 60_000 for n in sizes)


def test_outputs_of_the_dataflow_run_nothing_that_isnt_asked_for(spark, records):
    made, plan = len(folders._made), lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    found = batch.run(records)
    assert found.dead_letters.count() > 0 and found.events.count() > 0
    assert len(folders._made) == made  # anomalies had been computed for each
    found.late, found.aggregates
    assert len(folders._made) == made + 1
    assert "reason_code" in plan(found.events) and not any("reason_code" in plan(rows) for rows in (found.late, found.aggregates))  # parsed once, not for each side of the join


def test_runs_are_taken_from_rows_that_are_placed_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(anomaly, "stored", lambda rows, name: kept.append(name) or folders.stored(rows, name), raising=False)
    events = spark.range(500).select(F.col("id").alias("event_id"), F.col("id").alias("seq"), F.lit("u").alias("user_id"), (F.col("id") * 10_000).alias("ts_ms"), (F.col("id") % 97).alias("amount"))
    found = anomaly.in_arrival_order(events)
    assert kept == ["placed"] and "Range" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_raw_records_are_made_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_io, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    assert catalog_io._raw_records(catalog_io._stressed(spark, f"{tmp_path}/sf")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert catalog_io.stream_dataflow_dead_letters(spark, f"{tmp_path}/sf").count() == sum(n % 23 in (1, 2, 3) for n in range(3000))
    assert all(len(list((tmp_path / "job/in" / k).glob("part-*.json"))) >= 4 for k in "01")  # was one task's file


def stream(spark, folder):
    """One file a micro-batch."""
    return spark.readStream.schema("raw string, seq long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{folder}/in/*")


def test_a_batch_is_kept_on_disk_without_the_texts_of_valid_records(spark, records, tmp_path, monkeypatch):
    want, kept, held, texts = batch.run(records), [], [], []
    records.count()
    stored = lambda: {i.id(): (i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    persist, remember, before = type(records).persist, StreamJob._remember, set(stored())
    monkeypatch.setattr(type(records), "persist", lambda self, *level: kept.append(persist(self, *level)) or kept[-1])

    def looked_at(self, rows_, number):
        held.extend(sizes for i, sizes in stored().items() if i not in before)
        texts.append(kept[0].where("reason_code is null and raw_record is not null").count())
        remember(self, rows_, number)

    monkeypatch.setattr(StreamJob, "_remember", looked_at)
    job = StreamJob(spark, f"{tmp_path}/out")
    job.process(records, 0)
    assert held and all(disk and not memory for memory, disk in held) and texts == [0]  # was in memory, with all texts
    assert rows(job.events.read(), "event_id", "amount") == rows(want.events, "event_id", "amount")
    assert rows(spark.read.parquet(f"{tmp_path}/out/dead_letters"), "reason_code", "raw_record") == rows(want.dead_letters, "reason_code", "raw_record")


def test_a_large_batch_is_written_by_more_tasks(spark, records, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BATCH_ROWS", 100)
    want = batch.run(records)
    job = StreamJob(spark, f"{tmp_path}/out")
    job.process(records, 0)
    for table, least in (("events", 4), ("aggregates", 1.1)):  # was one file a bucket, so five users were five tasks at most
        buckets = list((tmp_path / "out" / table / "data/v=0").glob("_bucket=*"))
        assert buckets and sum(len(list(b.glob("part-*"))) for b in buckets) >= least * len(buckets)
    columns = ("user_id", "window_start_ms", "transaction_count", "total_volume", "average_transaction_value")
    assert rows(job.events.read(), "event_id", "amount") == rows(want.events, "event_id", "amount") and rows(job.aggregates(), *columns) == rows(want.aggregates, *columns)
    user = "usr_00001"
    assert rows(job.aggregates(user), *columns) == rows(want.aggregates.where(F.col("user_id") == user), *columns)


def test_repeats_that_come_after_a_long_batch_count_once(spark, tmp_path, monkeypatch):
    source = "/root/testdata/sf0.001"
    columns = ("user_id", "window_start_ms", "transaction_count", "total_volume")
    want, now = rows(catalog_io.dataflow_aggregates(spark, source), *columns), iter(range(2_000_000_000, 2_100_000_000, 700))
    monkeypatch.setattr(streaming_job, "time", SimpleNamespace(time=lambda: next(now)))  # each batch over ten minutes after the one before
    assert rows(catalog_io.stream_dataflow_aggregates(spark, source), *columns) == want


def test_stream_equals_batch_and_survives_a_restart(spark, records, tmp_path):
    folder, parts = str(tmp_path), 3
    want = batch.run(records)
    job = StreamJob(spark, f"{folder}/out")
    failed = []

    def begin():
        real = job.process

        def process(rows_, number):
            real(rows_, number)
            if number == 1 and not failed:
                failed.append(number)
                raise RuntimeError("lost after the writes, before the commit")

        runner = StreamJob(spark, f"{folder}/out")
        runner.process = process
        return runner.start(stream(spark, folder), f"{folder}/checkpoint")

    for k in range(parts):  # files come one by one, so each is a batch of its own
        size = 1 + 2 * PROFILE.records // parts
        records.where(F.floor(F.col("seq") / size) == k).coalesce(1).write.json(f"{folder}/in/{k:03d}")
        supervised(begin, attempts=2, pause_s=0)
    assert failed
    assert rows(job.events.read(), "event_id", "amount") == rows(want.events, "event_id", "amount")
    assert rows(spark.read.parquet(f"{folder}/out/dead_letters"), "reason_code", "raw_record") == rows(want.dead_letters, "reason_code", "raw_record")
    assert rows(spark.read.parquet(f"{folder}/out/late"), "event_id") == rows(want.late, "event_id")
    columns = ("user_id", "window_start_ms", "transaction_count", "total_volume", "average_transaction_value")
    assert rows(job.aggregates(), *columns) == rows(want.aggregates, *columns)
    log = metrics.ProgressLog()
    spark.streams.addListener(log)
    query = job.start_anomalies(f"{folder}/checkpoint_anomalies")
    query.awaitTermination()
    assert metrics.progress(query, spark).where("rows > 0 and checkpoint_ms >= 0").count() >= 1
    spark.streams.removeListener(log)
    found = job.anomalies()
    assert sorted(r[0] for r in found.select("anomaly_id").collect()) == list(range(1, found.count() + 1)) and found.where("detected_at is null").count() == 0
    assert rows(found, "anomaly_type", "event_id", "transaction_count", "rolling_99th_percentile") == rows(want.anomalies, "anomaly_type", "event_id", "transaction_count", "rolling_99th_percentile")

    # conservation: what came in is landed or dead
    raw_ids = records.select(F.get_json_object("raw", "$.event_id").alias("event_id"))
    dead_ids = want.dead_letters.select(F.get_json_object("raw_record", "$.event_id").alias("event_id"))
    found = quality.reconcile(raw_ids, job.events.read(), dead_ids).first()
    assert found["unaccounted"] == 0 and found["landed_duplicates"] == 0 and found["dead_unique"] > 0

    # the reader serves the job's tables
    reader, user = job.reader(), "usr_00001"
    page = reader.user_transactions(user, 3)
    theirs = {r["event_id"]: r for r in job.events.read().where(F.col("user_id") == user).collect()}
    assert len(page.items) == 3 and all(r.asDict() == {k: theirs[r["event_id"]][k] for k in r.asDict()} for r in page.items)
    again = reader.user_transactions(user, 3, cursor=page.next_cursor)
    assert not {r["event_id"] for r in page.items} & {r["event_id"] for r in again.items}
    assert reader.user_aggregates(user, 2).items[0]["updated_at"] is not None and reader.all_anomalies(1).items[0]["anomaly_id"] > 0
    assert respond(reader, f"/users/{user}/aggregates")[0] == 200 == respond(reader, "/anomalies")[0]
    spark.sql(f"CREATE DATABASE job LOCATION '{folder}/db'")
    bootstrap(spark, "job")
    for _ in range(2):
        job.publish("job")
    assert spark.table("job.events").count() == len(rows(want.events, "event_id")) and spark.table("job.user_aggregates").count() == want.aggregates.count()
    spark.sql("DROP DATABASE job CASCADE")

    # a cold start over the same input leaves the keyed table as it was
    before = rows(job.events.read(), "event_id", "received_at")
    StreamJob(spark, f"{folder}/out").process(records.where("seq < 600"), 99)
    assert rows(job.events.read(), "event_id", "received_at") == before


def test_kafka_records_and_topics(spark, records, tmp_path, capsys):
    """Records with partition and offset, as Kafka has them; topics get what the tables get; nothing is read of older batches but remembered ids."""
    folder = str(tmp_path)
    parts = records.select(F.col("raw").alias("value"), (F.col("seq") % 3).cast("int").alias("partition"), F.floor(F.col("seq") / 3).alias("offset"))
    writers = {n: TopicWriter(f"{folder}/topics/{n}") for n in ("dead_letters", "late", "aggregates")}
    job = StreamJob(spark, f"{folder}/out", topics=writers, console=True)
    query = job.start_anomalies(f"{folder}/c")  # before the first batch
    query.awaitTermination()
    for batch in (0, 0, 1):
        job.process(kafka_records(parts).where((F.col("offset") < 150) == (batch == 0)), batch)
    assert "dead_letters: {" in capsys.readouterr().out
    got = {n: read_appended(spark, w.location) for n, w in writers.items()}
    assert got["dead_letters"].count() == spark.read.parquet(f"{folder}/out/dead_letters").count() > 0
    assert got["late"].count() == spark.read.parquet(f"{folder}/out/late").count()
    last = got["aggregates"].where("batch_id = 1").select(F.from_json("value", "user_id string, window_start_ms long, transaction_count long").alias("v")).select("v.*")
    assert last.exceptAll(job.aggregates().select(*last.columns)).count() == 0 < last.count()
    assert job.events.read().count() == job.events.read().select("event_id").distinct().count() == spark.read.parquet(f"{folder}/out/accepted").count()
    assert job.remember_s == 600 and job._seen(2, 10**9).count() > 0 and job._seen(2, 10**11) is None
    with pytest.raises(ValueError):
        StreamJob(spark, folder, topics={"anomalies": writers["late"]})


def test_late_revisions_update_windows(spark, tmp_path):
    """Up to the delay behind, an event changes a window that was shown before."""
    schema, n = "event_id string, user_id string, event_time timestamp, amount long", [0]
    shown = []

    def arrive(*events):
        n[0] += 1
        at = F.timestamp_millis(F.col("ms"))
        spark.createDataFrame(events, "event_id string, user_id string, ms long, amount long").select("event_id", "user_id", at.alias("event_time"), "amount").coalesce(1).write.parquet(f"{tmp_path}/in/{n[0]:03d}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = window_updates(stream).writeStream.foreachBatch(lambda df, _: shown.extend(tuple(r) for r in df.select("window_start_ms", "transaction_count", "total_volume").collect()))
        query.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    arrive(("a", "u", 5_000, 1), ("b", "u", 41_000, 2))
    arrive(("c", "u", 6_000, 10))  # 35 s behind: the window is shown anew
    arrive(("d", "u", 200_000, 1))
    arrive(("e", "u", 7_000, 100))  # 193 s behind: not counted
    assert shown == [*sorted(shown[:2]), (0, 2, 11), (200_000, 1, 1)] and sorted(shown[:2]) == [(0, 1, 1), (40_000, 1, 2)]


def test_metrics_of_reports(spark):
    report = {"id": "q", "batchId": 4, "numInputRows": 7, "durationMs": {"triggerExecution": 50, "walCommit": 5, "commitOffsets": 6}, "processedRowsPerSecond": 1.5,
              "sources": [{"endOffset": '{"raw": {"0": 10, "1": 7}}', "latestOffset": '{"raw": {"0": 12, "1": 7}}'}, {"endOffset": {"logOffset": 3}, "latestOffset": None}]}
    assert metrics.batch_rows(report) == [("q", 4, None, 7, 50, 11, 1.5)]
    offsets = spark.createDataFrame(metrics.lag_rows(report), metrics.LAGS)
    assert [tuple(r) for r in metrics.lag(offsets).orderBy("partition").collect()] == [("raw", 0, 10, 12, 2), ("raw", 1, 7, 7, 0)]
    assert tuple(metrics.total_lag(offsets).first()) == (2, 17, 2) and tuple(metrics.total_lag(offsets.limit(0)).first()) == (0, 0, 0)


def test_sources(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert json_lines(spark, str(path)).count() == 2
    offsets = tmp_path / "offsets.txt"
    offsets.write_text("raw:0:17\nraw:1:x\n")
    assert [tuple(r) for r in offsets_table(spark.read.text(str(offsets))).collect()] == [("raw", 0, 17), ("raw", 1, None)]
    assert [tuple(r) for r in offset_totals(offsets_table(spark.read.text(str(offsets)))).collect()] == [("raw", 1, 17)]
    nulls = kafka_records(spark.createDataFrame([(None, 0, 5)], "value binary, partition int, offset long"))
    assert nulls.first()["raw"] == "" and with_seq(nulls).first()["seq"] == 5
    assert with_seq(nulls.select("raw")).columns == ["raw", "seq"]
    parted = with_partition(spark.range(100).withColumn("user_id", F.col("id") % 7)).withColumn("offset", F.col("id"))
    assert parted.select("partition").distinct().count() <= 6
    assert offset_range(parted.withColumn("partition", F.lit(0)), {0: (5, 9)}).count() == 4
    assert offset_range(parted, {}).count() == 0
    assert raw_stream(spark, str(tmp_path)).isStreaming
    assert json.loads(generate(spark, Profile(records=1)).first()["raw"])["schema_version"] == 1


def test_windows_are_emitted_once_at_their_close(spark, tmp_path):
    """The job's closed windows are those of the batch form, each once, also where a batch comes twice; open ones aren't among them."""
    records = generate(spark, replace(PROFILE, rate_per_second=10.0, records=400)).persist()
    job, top = StreamJob(spark, f"{tmp_path}/out"), records.agg(F.max("seq")).first()[0]
    for batch in (0, 1, 1, 2, 3):
        job.process(records.where((F.col("seq") * 4 > top * batch) & (F.col("seq") * 4 <= top * (batch + 1)) if batch else F.col("seq") * 4 <= top), batch)
    valid, _ = validate.split(validate.judged(records, strict=True))
    classes = eventtime.classified(dedup.first_arrivals(valid).withColumn("ts_ms", F.unix_millis("event_time")))
    columns = ("user_id", "window_start_ms", "transaction_count", "total_volume", "average_transaction_value")
    want, shown = rows(windows.closed(classes), *columns), job.closed()
    assert rows(shown, *columns) == want and 0 < len(want) < windows.aggregates(classes.where("lateness = 'on_time'")).count()
    assert shown.where("closed_at_ms < window_end_ms - 1").count() == 0
    per_batch = read_appended(spark, f"{tmp_path}/out/closed").groupBy("batch_id").count().collect()
    assert sum(r["count"] > 0 for r in per_batch) >= 3
    records.unpersist()


def test_partitions_that_lag_hold_windows_open(spark, tmp_path):
    """Partition 1 is 30 s behind in event time, then silent; its events are on time until it is idle."""
    def record(k, p, at):
        iso = datetime.fromtimestamp(at / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        event = {"event_id": f"00000000-0000-4000-a000-{k:012d}", "user_id": f"u{p}", "merchant_id": "m", "amount": 1, "currency": "USD", "transaction_type": "t", "event_time": iso, "ingest_time": iso, "schema_version": 1}
        return json.dumps(event), p, k, datetime.fromtimestamp(k, UTC)

    fed = [record(k, k % 2, 1_000_000_000 + k * 2000 - 30_000 * (k % 2)) for k in range(40)] + [record(k, 0, 1_000_000_000 + k * 2000) for k in range(40, 100)]
    kafka = spark.createDataFrame(fed, "value string, partition int, offset long, timestamp timestamp")
    job = StreamJob(spark, f"{tmp_path}/out")
    for batch in range(4):
        job.process(kafka_records(kafka).where(F.col("offset").between(25 * batch, 25 * batch + 24)), batch)
    accepted = spark.read.parquet(f"{tmp_path}/out/accepted")
    assert accepted.where("lateness <> 'on_time'").count() == 0
    marks = {r["arrival_ms"] // 1000: r["watermark_ms"] - 1_000_000_000 + 51 for r in accepted.where("watermark_ms is not null").collect()}
    assert marks[39] == 39 * 2000 - 30_000 == marks[68] and marks[69] == 69 * 2000 and marks[99] == 99 * 2000  # idle 30 s after its last record
    assert json.loads(job.ledger.get())["clock"]["tops"] == {"0": 1_000_198_000, "1": 1_000_048_000}


def test_requests_are_answered_from_the_tables_as_they_stand(spark, tmp_path, monkeypatch):
    """Twenty batches, with merges in between that delete what they merged; asked by one reader that was made before the first."""
    monkeypatch.setattr(tables, "FAN", 3)
    job = StreamJob(spark, f"{tmp_path}/out")
    for t in job.tables():
        t.grace_s = 0
    reader, at = job.reader(), lambda ms: F.timestamp_millis(F.lit(1_700_000_000_000) + ms)
    assert respond(reader, "/users/u1/transactions") == (200, {"items": [], "next_cursor": None}) and respond(reader, "/anomalies")[0] == 200
    for batch in range(20):
        n = spark.range(batch * 12, batch * 12 + 12).withColumn("user_id", F.concat(F.lit("u"), F.col("id") % 3))
        ids = F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
        job.events.upsert(n.select(ids.alias("event_id"), "user_id", F.lit(5).alias("amount"), at(F.col("id") * 1000).alias("event_time"), at(F.col("id") * 1000).alias("received_at")), batch)
        job.windows.upsert(n.groupBy("user_id").agg(F.lit(1_700_000_000_000 + 10_000 * (batch // 2)).alias("window_start_ms"), F.count("*").alias("transaction_count"), F.lit(20).cast("long").alias("total_volume"), F.current_timestamp().alias("updated_at")), batch)
        if batch % 4 == 1:
            job.found.upsert(n.limit(2).select(F.col("id").alias("anomaly_id"), F.lit("ANOMALY_AMOUNT").alias("anomaly_type"), ids.alias("event_id"), "user_id", at(F.col("id") * 1000).alias("detected_at")), batch)
        for t in job.tables():
            while t.compact():
                pass
        if batch % 5 == 4:
            body = respond(reader, "/users/u2/transactions?limit=200")[1]["items"]
            assert len(body) == 4 * (batch + 1) and [i["event_id"] for i in body] == sorted((i["event_id"] for i in body), reverse=True)
            body = respond(reader, "/users/u2/aggregates?limit=200")[1]["items"]
            assert sum(i["transaction_count"] for i in body) == 4 * (batch + 1) and len(body) == batch // 2 + 1
            body = respond(reader, "/anomalies?limit=200")[1]["items"]
            assert len(body) == 2 * (1 + (batch - 1) // 4)
    assert len(job.events.read(at="u2").inputFiles()) <= 3 * 3
    page = respond(reader, "/users/u2/transactions?limit=5")[1]
    after = respond(reader, f"/users/u2/transactions?limit=5&cursor={page['next_cursor']}")[1]["items"]
    assert max(i["event_id"] for i in after) < min(i["event_id"] for i in page["items"])


def test_idle_users_leave_the_store_and_others_stay(spark, tmp_path):
    """State lasts over a restart, and goes a day after the user's last event."""
    day = 86_400_000
    n = [0]

    def arrive(*events):
        n[0] += 1
        spark.createDataFrame([(f"e{n[0]}-{k}", u, at, 100 + k, k) for k, (u, at) in enumerate(events)], "event_id string, user_id string, ts_ms long, amount long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{n[0]:03d}")
        stream = spark.readStream.schema("event_id string, user_id string, ts_ms long, amount long, seq long").parquet(f"{tmp_path}/in/*")
        stateful.anomalies(stream, idle="1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "user").load()
        return {r["key"]["user_id"] for r in found.collect()}

    assert arrive(*[("a", 1000 + k) for k in range(8)], ("b", 2000)) == {"a", "b"}
    assert arrive(*[("a", 5000 + k) for k in range(4)]) == {"a", "b"}  # the eighth and more of a minute are found from both batches
    found = spark.read.parquet(f"{tmp_path}/out").where("anomaly_type = 'ANOMALY_VELOCITY'")
    assert sorted(r["transaction_count"] for r in found.collect()) == [11, 12]
    assert arrive(("a", day - 1000)) == {"a", "b"}
    assert arrive(("a", day + 3 * 60_000)) == {"a"}
    assert arrive(("c", 3 * day)) == {"c"}
