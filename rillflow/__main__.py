"""``python -m rillflow stream`` runs the job, ``python -m rillflow serve`` answers requests from its tables.  Options are those of ``settings``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import SparkSession

from .plans.http_api import serve
from .settings import Settings
from .sinks.tables import maintained
from .sources.events import raw_stream
from .streaming.job import StreamJob, supervised


def parsed(arguments: Sequence[str]) -> tuple[str, Settings]:
    parser = argparse.ArgumentParser(prog="rillflow", description=__doc__)
    parser.add_argument("command", choices=("stream", "serve"))
    for name in Settings.__dataclass_fields__:
        parser.add_argument(f"--{name.replace('_', '-')}")
    given = vars(parser.parse_args(arguments))
    command, settings = given.pop("command"), Settings.of(given)
    if command == "stream" and not settings.source:
        raise ValueError("source names the topic or folder of raw records")
    return command, settings


def stream(spark: SparkSession, settings: Settings) -> int:
    """Runs both queries, each again after a failure, and beside them the merging of segments; returns the restarts of both."""
    job = StreamJob(spark, settings.out, settings.strict, settings.remember or None)
    checkpoint = settings.checkpoint or f"{settings.out}/_checkpoint"
    trigger = {"processingTime": f"{settings.every_s} seconds"} if settings.every_s else {"availableNow": True}
    kafka = settings.kind == "kafka"
    options = {"kafka.bootstrap.servers": settings.brokers} if kafka else {}
    source = lambda: raw_stream(spark, settings.source, settings.kind, settings.most_records if kafka else settings.most_files, **options)
    events = lambda: supervised(lambda: job.start(source(), f"{checkpoint}/events", **trigger), settings.restarts, settings.pause_s)
    anomalies = lambda: supervised(lambda: job.start_anomalies(f"{checkpoint}/anomalies", **trigger), settings.restarts, settings.pause_s)
    end = maintained(job.tables(), settings.merge_s)
    try:
        if not settings.every_s:
            return events() + anomalies()
        with ThreadPoolExecutor(2) as both:
            running = [both.submit(events), both.submit(anomalies)]
            try:
                for done in as_completed(running):
                    done.result()  # one that is given up ends the other
            except BaseException:
                for query in spark.streams.active:
                    query.stop()
                raise
            return sum(r.result() for r in running)
    finally:
        end()


def main(arguments: Sequence[str] | None = None) -> None:
    import sys

    command, settings = parsed(sys.argv[1:] if arguments is None else arguments)
    spark = SparkSession.builder.appName(f"rillflow {command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command == "stream":
        stream(spark, settings)
    else:
        serve(StreamJob(spark, settings.out).reader(), settings.host, settings.port, settings.places, settings.wait_s).serve_forever()


if __name__ == "__main__":
    main()
