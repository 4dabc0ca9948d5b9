import pytest

from rillflow.__main__ import parsed, stream
from rillflow.settings import Settings
from rillflow.sources.generator import Profile, generate
from rillflow.streaming.job import StreamJob


def test_arguments_hold_before_variables():
    got = Settings.of({"out": "a", "port": None}, {"RILLFLOW_OUT": "b", "RILLFLOW_PORT": "81", "RILLFLOW_STRICT": "no"})
    assert (got.out, got.port, got.strict, got.restarts) == ("a", 81, False, 10)


@pytest.mark.parametrize("given", [{}, {"out": "a", "port": "x"}, {"out": "a", "port": "70000"}, {"out": "a", "kind": "queue"}, {"out": "a", "kind": "kafka"}, {"out": "a", "strict": "maybe"}, {"out": "a", "every_s": "-1"}, {"out": "a", "places": "0"}])
def test_wrong_settings(given):
    with pytest.raises(ValueError):
        Settings.of(given, {})


def test_the_job_from_its_arguments(spark, tmp_path):
    generate(spark, Profile(records=200, users=3, malformed=0.1, seed=2)).select("raw").coalesce(1).write.text(f"{tmp_path}/in")
    command, settings = parsed(["stream", "--source", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--restarts", "0"])
    assert command == "stream" and stream(spark, settings) == 0
    job = StreamJob(spark, f"{tmp_path}/out")
    assert job.events.read().count() + spark.read.parquet(f"{tmp_path}/out/dead_letters").count() == 200
    assert job.anomalies().count() > 0 and job.reader().all_anomalies(1).next_cursor is not None
    with pytest.raises(ValueError):
        parsed(["stream", "--out", "x"])
