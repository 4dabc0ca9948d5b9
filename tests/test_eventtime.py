import json
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import dedup, eventtime, windows
from rillflow.sources.events import stressed, transactions


def test_running_max_over_chunks(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000)) for i in range(500)]
    got = [r["m"] for r in eventtime.running_max(spark.createDataFrame(rows, "seq long, v long"), "v", "seq", "m", chunk=7, carry=100).orderBy("seq").collect()]
    top, want = 100, []
    for _, v in rows:
        top = max(top, v)
        want.append(top)
    assert got == want


def test_lateness_edges(spark):
    top = 1_000_000
    wm = top - 51
    rows = [(0, top), (1, wm - 45_000), (2, wm - 45_001), (3, wm - 20_000), (4, wm)]
    got = [r["lateness"] for r in eventtime.classified(spark.createDataFrame(rows, "seq long, ts_ms long")).orderBy("seq").collect()]
    assert got == ["on_time", "dropped", "late", "dropped", "on_time"]


def test_known_counts(spark):
    classes = eventtime.classified(stressed(transactions(spark, "/root/testdata/sf0.001")))
    assert {r["lateness"]: r["count"] for r in classes.groupBy("lateness").count().collect()} == {"late": 24, "dropped": 27, "on_time": 949}


def test_windows_are_half_open_and_merge(spark):
    rows = spark.createDataFrame([("u", 9_999, 1), ("u", 10_000, 3), ("u", 19_999, 4), ("v", 10_000, None)], "user_id string, ts_ms long, amount long")
    whole = windows.aggregates(rows)
    got = {(r["user_id"], r["window_start_ms"]): (r["transaction_count"], r["total_volume"], r["average_transaction_value"]) for r in whole.collect()}
    assert got == {("u", 0): (1, 1, 1.0), ("u", 10_000): (2, 7, 3.5), ("v", 10_000): (1, None, None)}
    halves = windows.aggregates(rows.where("amount <> 4")).unionByName(windows.aggregates(rows.where("amount = 4")))
    again = {(r["user_id"], r["window_start_ms"]): r["total_volume"] for r in windows.merge(halves).collect()}
    assert again == {("u", 0): 1, ("u", 10_000): 7}


def test_first_arrival_wins(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, None)], "event_id string, seq long, v string")
    assert sorted(map(tuple, dedup.first_arrivals(rows).collect())) == [("a", 1, "first"), ("b", 3, None)]
    assert dedup.new_arrivals(rows, rows.where("event_id = 'a'")).select("event_id").collect()[0][0] == "b"


def test_no_single_partition_window_holds_all_rows(spark):
    plan = eventtime.classified(stressed(transactions(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SinglePartition") :]
    assert "HashAggregate" in scan[:2000]  # only the chunks' maxima meet in one task


def clocked(rows, partitions, idle, start=None):
    """What a sequential engine does: partitions fall idle as time passes, the least of the active ones counts, and it never goes back."""
    tops, last, mark, found = dict.fromkeys(range(partitions)), {}, None, []
    for _, p, ts, now in rows:
        for q in range(partitions):
            last.setdefault(q, now if start is None else start)
        moments = sorted({t + idle for t in last.values() if t + idle <= now})
        for moment in [*moments, now]:
            active = [q for q in tops if moment - last[q] < idle]
            if active and all(tops[q] is not None for q in active):
                mark = max(min(tops[q] for q in active), mark if mark is not None else -(10**18))
        tops[p], last[p] = ts if tops[p] is None else max(tops[p], ts), now
        active = [q for q in tops if now - last[q] < idle]
        if all(tops[q] is not None for q in active):
            low = min(tops[q] for q in active)
            mark = low if mark is None else max(mark, low)
        found.append(None if mark is None else mark - 51)
    return found


CLOCKED = "seq long, partition int, ts_ms long, arrival_ms long"


def some_partitions(n, seed, partitions=4):
    rng, now, rows = random.Random(seed), 0, []
    for k in range(n):
        now += rng.choice([0, 1, 5, 20, 200]) if rng.random() < 0.97 else 4000
        live = [p for p in range(partitions) if not (p == 1 and n // 4 < k < n // 2) and not (p == 3 and k < n // 2)]
        p = rng.choice(live)
        rows.append((k, p, now * 10 - 500 * (p == 2) - rng.randrange(300), now))
    return rows


def test_watermark_of_partitions_that_lag_and_fall_silent(spark):
    for seed in (1, 2, 3):
        rows = some_partitions(400, seed)
        for idle in (100, 1500):
            marked = eventtime.with_partition_watermark_ms(spark.createDataFrame(rows, CLOCKED), eventtime.PartitionClock(4), idle_ms=idle, chunk=23)
            assert [r["watermark_ms"] for r in marked.orderBy("seq").collect()] == clocked(rows, 4, idle)


def test_the_clock_is_carried_from_batch_to_batch(spark):
    rows = some_partitions(300, 5)
    clock, got = eventtime.PartitionClock(4), []
    for k in range(0, 300, 60):
        part = [(n - k, *r) for n, *r in rows[k : k + 60]]
        marked = eventtime.with_partition_watermark_ms(spark.createDataFrame(part, CLOCKED), clock, idle_ms=1500, chunk=7)
        got += [r["watermark_ms"] for r in marked.orderBy("seq").collect()]
        clock = eventtime.PartitionClock.of(json.loads(json.dumps(eventtime.advanced(clock, marked).as_dict())))
    assert got == clocked(rows, 4, 1500) and clock.watermark_ms == got[-1]
    assert eventtime.PartitionClock.of(None).partitions == 0


def test_one_partition_is_the_running_maximum(spark):
    rows = [(k, 0, random.Random(k).randrange(10**6), k) for k in range(200)]
    df = spark.createDataFrame(rows, CLOCKED)
    both = eventtime.classified_by_partition(df, eventtime.PartitionClock(1)), eventtime.classified(df)
    assert sorted(map(str, both[0].select("seq", "watermark_ms", "lateness").collect())) == sorted(map(str, both[1].select("seq", "watermark_ms", "lateness").collect()))


def test_windows_are_closed_by_the_watermark(spark):
    rows = [(0, 1_000, 5), (1, 12_000, 6), (2, 2_000, 7), (3, 20_049, 1), (4, 20_050, 1)]  # the third comes after its window was closed
    df = spark.createDataFrame(rows, "seq long, ts_ms long, amount long").withColumn("user_id", F.lit("u"))
    for upto, want in ((3, [(0, 1)]), (4, [(0, 1)]), (5, [(0, 1), (10_000, 1)])):
        shut = windows.closed(eventtime.classified(df.where(F.col("seq") < upto)))
        assert sorted((r["window_start_ms"], r["transaction_count"]) for r in shut.collect()) == want


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_maxima_of_chunks_ahead(spark, span):
    rows = [(c, None if c % 4 == 3 else (c * 37) % 101, c * 2) for c in range(0, 90, 2)]
    got = {r["_chunk"]: (r["a"], r["b"]) for r in eventtime.before_chunks(spark.createDataFrame(rows, "_chunk long, x long, y long"), {"a": "x", "b": "y"}, span).collect()}
    most = lambda values: max((v for v in values if v is not None), default=None)
    assert got == {c: (most(x for k, x, _ in rows if k < c), most(y for k, _, y in rows if k < c)) for c, _, _ in rows}
