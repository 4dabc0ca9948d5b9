"""Runs the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables' folder (default sf0.1), BENCH_CPUS the local
cores.  Each query's result is written in full to Spark's noop sink; the value
is the sum of the seconds.  ``events_per_second`` are of the batch dataflow
over the event table and of its streaming window form.  ``stream_job`` is the
whole job over generated records with every fault at 10 %, in micro-batches,
ended once by a failure and started again: its rate, micro-batch and
checkpoint times, the time from the failure to the end of the next
micro-batch, and the ids unaccounted for and doubled.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rillflow.folders import scratch  # noqa: E402
from rillflow.operators import quality  # noqa: E402
from rillflow.plans import catalog  # noqa: E402
from rillflow.sources.generator import Profile, generate  # noqa: E402
from rillflow.streaming.job import StreamJob, supervised  # noqa: E402
from rillflow.streaming.metrics import ProgressLog  # noqa: E402

HEADLINE = (
    "user_window_10s", "on_time_window_aggregates", "late_events", "dedup_events", "validation_reason_counts", "velocity_anomalies", "amount_anomalies",
    "anomalies_in_arrival_order", "reconcile", "user_transactions_page", "latency_percentiles", "upsert_events", "stream_user_window_10s", "stream_anomalies",
)


RECORDS, FILES = 40_000, 5


def stream_job(spark: SparkSession) -> dict:
    """Figures of the job as a whole."""
    folder = scratch(spark, "bench")
    records = generate(spark, Profile(records=RECORDS, users=200, duplicate=0.1, late=0.1, out_of_order=0.1, malformed=0.1, seed=3))
    records.repartitionByRange(FILES, "seq").sortWithinPartitions("seq").write.json(f"{folder}/in")
    stream = spark.readStream.schema("seq long, raw string").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    log, failed = ProgressLog(), []
    spark.streams.addListener(log)

    def begin():
        job = StreamJob(spark, f"{folder}/out")
        process = job.process

        def once_failing(rows, batch):
            process(rows, batch)
            if batch == FILES // 2 and not failed:
                failed.append(time.perf_counter())
                raise RuntimeError("lost before the commit")
            if failed and len(failed) == 1:
                failed.append(time.perf_counter())

        job.process = once_failing
        return job.start(stream, f"{folder}/checkpoint")

    began = time.perf_counter()
    supervised(begin, attempts=2, pause_s=0)
    seconds = time.perf_counter() - began
    job = StreamJob(spark, f"{folder}/out")
    found = quality.reconcile(quality.text_ids(records), job.events.read(), quality.text_ids(spark.read.parquet(f"{folder}/out/dead_letters"), "raw_record")).first()
    time.sleep(1)  # the listener's last reports
    spark.streams.removeListener(log)
    ran = log.batches(spark).where("rows > 0")
    took, wrote = quality.percentiles(ran, "duration_ms", (50, 95)).first(), quality.duration_stats(ran, "checkpoint_ms").first()
    return {
        "records_per_second": round(records.count() / seconds), "batch_p50_ms": took[0], "batch_p95_ms": took[1], "checkpoint_p95_ms": wrote["p95_ms"], "recovery_s": round(failed[1] - failed[0], 3),
        "unaccounted": found["unaccounted"], "duplicates": found["landed_duplicates"],
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    catalog.QUERIES["events_projection"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    rates = {"batch_windows": events / seconds["user_window_10s"], "batch_anomalies": events / seconds["anomalies_in_arrival_order"], "stream_windows": events / seconds["stream_user_window_10s"], "stream_anomalies": events / seconds["stream_anomalies"]}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": events, "events_per_second": {k: round(v) for k, v in rates.items()}, "stream_job": stream_job(spark), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
