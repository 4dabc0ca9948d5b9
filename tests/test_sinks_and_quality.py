import pytest
from pyspark.sql import functions as F

from rillflow.operators import quality
from rillflow.sinks import files, tables
from rillflow.sinks.tables import KeyedTable, TopicWriter, append_batch, append_once, inspect, kafka_rows, read_appended, require, with_ids


def test_upsert_keeps_first_times_and_repeats_safely(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], keep=["at"])
    assert t.read() is None
    t.upsert(spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 10, 1), ("b", 1, 10, 0)], "k string, v int, at int, o int"), 0, order="o")
    for _ in range(2):
        t.upsert(spark.createDataFrame([("a", 9, 99, 0), ("c", 3, 99, 0), (None, 4, 99, 0)], "k string, v int, at int, o int"), 1)
    assert sorted(((r["k"], r["v"], r["at"]) for r in t.read().collect()), key=str) == sorted([("a", 9, 10), ("b", 1, 10), ("c", 3, 99), (None, 4, 99)], key=str)


def test_what_a_batch_writes_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 3)
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], keep=["at"], add=["n"], grace_s=0)
    want, size = {}, {}
    for batch in range(12):
        rows = [(k, batch, 10 + batch, 1) for k in range(batch % 3, 40, 3 + batch % 2)]
        for _ in range(1 + (batch % 5 == 2)):  # some batches come twice, also those that merge segments
            t.upsert(spark.createDataFrame(rows, "k long, v int, at int, n long").coalesce(1), batch)
            while t.compact():
                pass
        for k, v, at, n in rows:
            want[k] = (v, want[k][1] if k in want else at, want[k][2] + 1 if k in want else n)
        assert {r["k"]: (r["v"], r["at"], r["n"]) for r in t.read().collect()} == want
        size[batch] = sum(f.stat().st_size for f in (tmp_path / "t" / "data").glob(f"v={batch}/*.parquet"))
    for low in (0, 5, 11):  # a condition holds for what rows are, not for what they were
        assert {r["k"] for r in t.read(F.col("v") == low).collect()} == {k for k, (v, _, _) in want.items() if v == low}
    assert len(files.children(spark, f"{tmp_path}/t/data")) <= 9 and len(files.children(spark, f"{tmp_path}/t/_manifest")) <= 4
    assert size[11] <= 1.1 * size[2] or not size[2]


def _page_files(table, user):
    """Files that a lookup of one user opens."""
    return len(table.read(at=user).inputFiles())


def test_lookups_open_one_bucket_and_outlive_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 3)
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], keep=["first"], stable=["user", "at"], buckets=8, grace_s=0)
    want, files_of = {}, []
    for batch in range(14):
        rows = [(k, f"u{k % 20}", k * 1000, batch, batch) for k in range(batch * 40, batch * 40 + 60)]  # a third comes again in the next batch
        t.upsert(spark.createDataFrame(rows, "id long, user string, at long, first int, v int"), batch)
        for k, user, at, first, v in rows:
            want[k] = (user, at, want[k][2] if k in want else first, v)
        lease = t.lease() if batch == 4 else lease if batch > 4 else None
        while t.compact():
            pass
        files_of.append(_page_files(t, "u7"))
        got = {r["id"]: (r["user"], r["at"], r["first"], r["v"]) for r in t.read().collect()}
        assert got == want
        page = t.read(at="u7", between={"at": (100_000, 400_000)})
        assert {r["id"] for r in page.collect()} == {k for k, (u, at, _, _) in want.items() if u == "u7" and 100_000 <= at <= 400_000}
    assert max(files_of) <= 3 * 3 and files_of[13] <= max(files_of[:6])
    assert all("_bucket=" in f for f in t.read(at="u7").inputFiles()) and len({f.split("_bucket=")[1].split("/")[0] for f in t.read(at="u7").inputFiles()}) == 1
    early = t.read(at="u7", between={"at": (0, 30_000)})  # old segments' ranges leave out the newest ones
    assert len(early.inputFiles()) < files_of[13] and early.count() == 2
    plan = t.read(at="u7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user,u7)" in plan
    held = {r["id"] for r in lease.read().collect()}  # the table of batch 4, merged away since
    assert held == set(range(220)) and len(files.children(spark, f"{tmp_path}/t/data")) > len(t._manifest()["segments"])
    lease.release()
    t.upsert(spark.createDataFrame([], "id long, user string, at long, first int, v int"), 14)
    t.compact(), t.compact()
    assert len(files.children(spark, f"{tmp_path}/t/data")) <= len(t._manifest()["segments"]) + 4 and t.read().count() == len(want)
    assert t.read(at="nobody").count() == 0
    with pytest.raises(ValueError):
        t.read(between={"v": (1, 2)})
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "x"), ["id"], buckets=0)


def test_batches_write_while_segments_are_merged(spark, tmp_path, monkeypatch):
    """A merge that ends between a batch's reading of the ledger and its writing isn't lost, nor is the batch."""
    monkeypatch.setattr(tables, "FAN", 2)
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], add=["n"], stable=["k"], grace_s=0)
    for batch in range(4):
        t.upsert(spark.createDataFrame([(batch % 2, 1)], "k long, n long"), batch)
    write = t._write

    def slow(*given):
        if given[1] == "v=4":
            monkeypatch.setattr(t, "_write", write)
            assert t.compact()
        return write(*given)

    monkeypatch.setattr(t, "_write", slow)
    t.upsert(spark.createDataFrame([(0, 1)], "k long, n long"), 4)
    assert {r["k"]: r["n"] for r in t.read().collect()} == {0: 3, 1: 2} and len(t._manifest()["segments"]) < 5
    t.upsert(spark.createDataFrame([(0, 1)], "k long, n long"), 4)  # the batch comes again
    assert {r["k"]: r["n"] for r in t.read().collect()} == {0: 3, 1: 2}
    end = tables.maintained([t], every_s=0.05)
    for batch in range(5, 8):
        t.upsert(spark.createDataFrame([(9, 1)], "k long, n long"), batch)
        assert t.read(at=9).first()["n"] == batch - 4
    end()
    assert {r["k"]: r["n"] for r in t.read().collect()} == {0: 3, 1: 2, 9: 3}


def test_published_batches_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    assert append_once(spark.range(3), path, 0) and not append_once(spark.range(9), path, 0)
    assert read_appended(spark, path).count() == 3 and not [n for n in files.children(spark, path) if n.startswith("_staged")]
    topic = TopicWriter(f"{path}/topic", key="id")
    for _ in range(2):
        topic.write(spark.range(2), 5)
    assert sorted(r["value"] for r in read_appended(spark, f"{path}/topic").collect()) == ['{"id":0}', '{"id":1}']
    assert inspect(spark.range(1), "late") == ['late: {"id":0}']
    with pytest.raises(ValueError):
        TopicWriter("x", "pigeon")


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from rillflow import folders

    assert folders.scratch(spark) != folders.scratch(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077", raising=False)
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            with pytest.raises(RuntimeError):
                folders.shared(spark)


def test_appends_by_batch(spark, tmp_path):
    path = str(tmp_path / "a")
    assert read_appended(spark, path) is None
    for _ in range(2):
        append_batch(spark.range(3), path, 0)
    append_batch(spark.range(2), path, 1)
    assert read_appended(spark, path).count() == 5


def test_constraints_and_ids(spark):
    rows = spark.createDataFrame([("x", "ANOMALY_AMOUNT"), ("y", "other")], "k string, t string")
    with pytest.raises(Exception, match="t is other"):
        require(rows, one_of={"t": ["ANOMALY_AMOUNT"]}).collect()
    with pytest.raises(Exception, match="k is null"):
        require(rows.withColumn("k", F.lit(None).cast("string")), not_null=["k"]).collect()
    got = [(r["id"], r["n"]) for r in with_ids(spark.range(50), "n", ["id"], first=7, parts=5).orderBy("id").collect()]
    assert got == [(i, i + 7) for i in range(50)]
    many = spark.range(20_000, numPartitions=7).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("s"))  # more than a range's sample holds
    numbered = [(r["k"], r["n"]) for r in with_ids(many, "n", ["k", "s"], parts=8).collect()]
    assert [n for _, n in sorted(numbered)] == list(range(1, 20_001))
    assert kafka_rows(spark.range(1), "id").first() == ("0", '{"id":0}')


def test_reconcile(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "event_id string")
    raw, landed, dead = ids("a", "a", "b", "c", "d", None), ids("a", "a", "b"), ids("c")
    assert quality.reconcile(raw, landed, dead).first().asDict() == {"raw_unique": 4, "landed_unique": 2, "dead_unique": 1, "unaccounted": 1, "landed_duplicates": 1}
    assert [r[0] for r in quality.unaccounted(raw, landed, dead).collect()] == ["d"]
    assert quality.reconcile(ids(), ids(), ids()).first()["unaccounted"] == 0


def test_stats(spark):
    rows = spark.createDataFrame([(v,) for v in range(1, 21)], "ms long")
    assert tuple(quality.duration_stats(rows, "ms").first()) == (20, 1, 10.5, 20, 19)
    assert tuple(quality.duration_stats(rows.limit(0), "ms").first()) == (0, None, None, None, None)
    polls = spark.createDataFrame([(0, 5, 0), (1, 7, 10), (2, 7, 20), (3, 7, 30), (4, 7, 40)], "poll int, v long, at long")
    assert quality.drained(polls, "v").first()["poll"] == 3
    assert quality.first_growth(polls, "v").first()["growth"] == 2
    assert quality.throughput(polls, "at", "v").first()["per_second"] == 50.0
    assert quality.throughput(polls.limit(1), "at", "v").first()["per_second"] == 0.0
    assert [r["per_second"] for r in quality.rates(polls, "v", "at").orderBy("poll").collect()] == [None, 200.0, 0.0, 0.0, 0.0]
    both = quality.compare_runs(spark.createDataFrame([(1, 2), (5, 6)], "requested_rate int, x int"), spark.createDataFrame([(1, 3)], "requested_rate int, x int"))
    assert sorted((r["requested_rate"], r["fresh_x"]) for r in both.collect()) == [(1, 3), (5, None)]
    assert quality.matching_metrics(spark.createDataFrame([("records-lag-max",), ("heap",)], "id string")).count() == 1


def test_whole_tables_of_durations_and_polls(spark):
    n = 20_000
    polls = spark.range(n, numPartitions=7).select(F.col("id").alias("poll"), F.when(F.col("id") < 12_345, 2 * F.floor(F.col("id") / 2)).otherwise(12_345).alias("v"), (F.col("id") * 7919 % 4001).alias("ms"))
    ms = sorted(k * 7919 % 4001 for k in range(n))
    assert tuple(quality.duration_stats(polls, "ms").first()) == (n, ms[0], sum(ms) / n, ms[-1], ms[int(n * 0.95) - 1])
    assert tuple(quality.drained(polls, "v").first()) == (12_347, 12_345, 12_347 * 7919 % 4001)
    assert quality.drained(polls.where("poll < 12345"), "v").count() == 0
    assert tuple(quality.first_growth(polls.where("poll >= 12344"), "v").first())[:2] == (12_345, 12_345)
    assert quality.first_growth(polls.where("poll >= 12345"), "v").count() == 0
    values = [None if k % 11 == 0 else k // 3 for k in range(1000)]
    rows = spark.createDataFrame(list(enumerate(values)), "poll int, v int").repartition(5)
    got = {r["poll"]: (r["_earlier_1"], r["_earlier_2"], r["_earlier_3"]) for r in quality._with_earlier(rows, "v", "poll", 3).collect()}
    assert got == {k: tuple(values[k - j] if k >= j else None for j in (1, 2, 3)) for k in range(1000)}
    few = rows.where("poll < 3")
    assert {r["poll"]: r["_earlier_2"] for r in quality._with_earlier(few, "v", "poll", 2).collect()} == {0: None, 1: None, 2: values[0]}


def test_no_task_holds_all_durations_or_polls(spark):
    polls = spark.range(5000).select(F.col("id").alias("poll"), F.floor(F.col("id") / 3).alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan(quality.duration_stats(polls, "v"))
    for found in (quality.drained(polls, "v"), quality.first_growth(polls, "v")):
        windows = [line for line in plan(found).splitlines() if "Window [" in line and "lag(" in line]
        assert windows and all(line.count("[_chunk#") for line in windows)
