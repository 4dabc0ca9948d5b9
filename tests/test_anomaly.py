import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import anomaly


def sequential(rows):
    """One event after the other, with plain lists and nothing of the library: kept times, kept amounts, a percentile by fractions."""
    times, amounts, out = {}, {}, []
    for event_id, user, ts, amount in rows:
        kept = times[user] = [t for t in times.get(user, []) if ts - t <= 60_000] + [ts]
        if len(kept) > 10:
            out.append(("ANOMALY_VELOCITY", str(event_id), str(user), len(kept), 60, 10, None, None, None))
        past = sorted(amounts.get(user, []))
        if len(past) >= 20:
            at = Fraction(99 * (len(past) - 1), 100)
            limit = past[int(at)] + (past[min(int(at) + 1, len(past) - 1)] - past[int(at)]) * (at - int(at))
            if amount > limit:
                out.append(("ANOMALY_AMOUNT", str(event_id), str(user), None, None, None, amount, round(float(limit), 6), len(past)))
        amounts[user] = (amounts.get(user, []) + [amount])[-256:]
    return out


def made(n, users, seed, disorder):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 500, 2000, 9000])
        user = 0 if rng.random() < 0.4 else rng.randrange(users)
        rows.append((i, user, t - (rng.randrange(100_000) if disorder and rng.random() < 0.2 else 0), rng.randrange(1000) ** 2))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts_ms long, amount long").withColumn("seq", F.col("event_id"))


def shown(df):
    names = [F.round(c, 6) if c == "rolling_99th_percentile" else F.col(c) for c in anomaly.COLUMNS[3:]]
    return sorted((tuple(r) for r in df.select(F.col("anomaly_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), *names).collect()), key=str)


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("run", [300, 2048])
def test_batch_forms_equal_a_sequential_run(spark, monkeypatch, run):
    monkeypatch.setattr(anomaly, "RUN", run)
    monkeypatch.setattr(anomaly, "CHUNK", 333)
    rows = made(3000, 4, 1, disorder=False)
    events = frame(spark, rows)
    got = shown(anomaly.union_of(anomaly.velocity(events), anomaly.amounts(events)).withColumn("event_id", F.col("event_id")))
    assert sorted(map(key, got)) == sorted(map(key, sequential(rows)))


@pytest.mark.parametrize("run", [300, 2048])
def test_arrival_order(spark, monkeypatch, run):
    monkeypatch.setattr(anomaly, "RUN", run)
    rows = made(3000, 4, 2, disorder=True)
    got = shown(anomaly.in_arrival_order(frame(spark, rows)))
    assert sorted(map(key, got)) == sorted(map(key, sequential(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_state_equals_plain_lists(seed):
    rows = made(1500, 3, seed, disorder=True)
    states, got = {}, []
    for event_id, user, ts, amount in rows:
        got += states.setdefault(user, anomaly.UserState()).arrive(str(event_id), str(user), ts, amount)
    assert [(*r[:7], r[7] if r[7] is None else round(r[7], 6), r[8]) for r in got] == sequential(rows)


def test_no_task_takes_a_hot_user_whole(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "RUN", 100)
    rows = [(k, 1, k * 10, k % 7) for k in range(5000)]
    plan = anomaly.in_arrival_order(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    exchanges = re.findall(r"RepartitionByExpression \[([^\]]*)\]", plan)
    assert exchanges and all("_run" in e or "_group" in e for e in exchanges)
    assert anomaly.in_arrival_order(frame(spark, rows).limit(0)).count() == 0 == anomaly.amounts(frame(spark, rows).limit(0)).count()


def test_velocity_edges():
    state = anomaly.RecentTimes()
    assert [state.add(ts) for ts in [0, *range(50_000, 50_009)]] == list(range(1, 11))
    assert state.add(60_000) == 11  # one of exactly 60 s ago still counts
    assert state.add(60_001) == 11


def test_amount_edges():
    arrive = lambda amounts, amount: [r[6:] for r in anomaly.UserState((), amounts).arrive("e", "u", 0, amount)]
    assert arrive([5] * 19, 99) == [] and arrive([5] * 20, 99) == [(99, 5.0, 20)] and arrive([5] * 20, 5) == []
    state = anomaly.RecentAmounts(range(256))
    state.add(7)
    assert len(state.arrived) == len(state.ordered) == 256 and state.ordered[0] == 1


def test_windows_of_amounts_equal_the_sorted_list():
    rng = np.random.default_rng(2)
    for n in (1, 19, 20, 21, 100, 101, 102, 256, 257, 700):
        values = rng.integers(0, 50 if n % 2 else 10**9, n)
        recent, want = anomaly.RecentAmounts(), []
        for x in values.tolist():
            want.append(recent.quantile())
            recent.add(x)
        size = np.minimum(np.arange(n), 256)
        got = anomaly._rolling_at(values.astype(float), np.arange(n), size)
        assert [None if np.isnan(x) else x for x in got] == want


def test_runs_of_a_user_are_put_together_in_a_tree(spark, monkeypatch):
    """Nine of ten events are one user's; no task goes through more than a few of their runs' ends."""
    monkeypatch.setattr(anomaly, "RUN", 300)
    monkeypatch.setattr(anomaly, "STRETCH", 2)
    rng = random.Random(11)
    rows = [(f"e{k}", "hot" if rng.random() < 0.9 else rng.choice(["a", "b"]), k * 3000 - rng.choice([0, 0, 5000, 200_000]), rng.randrange(1000), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "event_id string, user_id string, ts_ms long, amount long, seq long")
    want, users = [], {}
    for event_id, user, ts, amount, _ in rows:
        want += users.setdefault(user, anomaly.UserState()).arrive(event_id, user, ts, amount)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in anomaly.in_arrival_order(df).collect())


def test_stretches_may_be_put_together_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        ends = [(max(t), sorted(x for x in t if x >= max(t) - 60_000), [rng.randrange(9) for _ in range(rng.randrange(200))]) for t in ([rng.randrange(300_000) for _ in range(rng.randrange(1, 6))] for _ in range(3))]
        a, b, c = ends
        assert anomaly._after(anomaly._after(a, b), c) == anomaly._after(a, anomaly._after(b, c))
