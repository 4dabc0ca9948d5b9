from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rillflow.functions import cursors
from rillflow.functions.expressions import cursor_of
from rillflow.plans.reader import AnalyticsReader, BadRequest

UTC = timezone.utc


@pytest.fixture(scope="module")
def reader(spark):
    n = spark.range(25)
    ids = F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.floor(F.col("id") / 2) * 1000)  # two events share each time
    events = n.select(ids.alias("event_id"), F.lit("u").alias("user_id"), at.alias("event_time"), (F.col("id") * 10).alias("amount"))
    sums = n.select(F.lit("u").alias("user_id"), F.timestamp_millis(F.col("id") * 10_000).alias("window_start"), F.col("id").alias("transaction_count"))
    found = n.select(F.col("id").alias("anomaly_id"), F.when(F.col("id") % 2 == 0, "ANOMALY_VELOCITY").otherwise("ANOMALY_AMOUNT").alias("anomaly_type"), F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"), at.alias("detected_at"))
    return AnalyticsReader(events, sums, found)


def walk(fetch):
    seen, cursor = [], None
    while True:
        page = fetch(cursor=cursor)
        seen += page.items
        if page.next_cursor is None:
            return seen
        cursor = page.next_cursor


def test_pages_cover_all_rows_once(reader):
    got = [r["event_id"] for r in walk(lambda cursor: reader.user_transactions("u", 5, cursor=cursor))]
    assert len(got) == 25 and got == sorted(got, reverse=True)
    assert [r["transaction_count"] for r in walk(lambda cursor: reader.user_aggregates("u", 4, cursor=cursor))] == list(range(24, -1, -1))
    assert [r["anomaly_id"] for r in walk(lambda cursor: reader.all_anomalies(7, cursor=cursor))] == list(range(24, -1, -1))
    assert [r["anomaly_id"] for r in walk(lambda cursor: reader.user_anomalies("u0", 3, cursor=cursor, anomaly_type="ANOMALY_AMOUNT"))] == [21, 15, 9, 3]


def test_full_last_page_still_has_a_cursor(reader):
    assert reader.user_transactions("u", 25).next_cursor is not None
    page = reader.user_transactions("nobody")
    assert page.items == [] and page.next_cursor is None


def test_times_are_inclusive(reader):
    at = datetime.fromtimestamp(1_700_000_003, UTC)
    assert len(reader.user_transactions("u", start_time=at, end_time=at).items) == 2


@pytest.mark.parametrize("given", [{"limit": 0}, {"limit": 201}, {"limit": True}, {"cursor": "not-base64!"}, {"cursor": "a" * 513}, {"start_time": datetime(2024, 1, 1)}, {"cursor": cursors.encode("x")}, {"cursor": cursors.encode("x", "y")}])
def test_bad_requests(reader, given):
    with pytest.raises(BadRequest):
        reader.user_transactions("u", **given)


def test_bad_anomaly_type_and_empty_cursor(reader):
    with pytest.raises(BadRequest):
        reader.all_anomalies(anomaly_type="NOT_A_RULE")
    with pytest.raises(BadRequest):
        reader.all_anomalies(cursor=cursors.encode(datetime.now(UTC), "x"))
    assert len(reader.user_transactions("u", 3, cursor="").items) == 3
    assert reader.health()


def test_codec(spark):
    now = datetime(2024, 1, 2, 3, 4, 5, 6000, UTC)
    assert cursors.decode(cursors.encode(now, 7, "x"), ["time", "int", "text"]) == (now, 7, "x")
    got = spark.range(1).select(cursor_of(F.lit("user/1+é"), F.lit(12345678))).first()[0]
    assert got == cursors.encode("user/1+é", 12345678)


def test_filters_reach_the_scan(spark, tmp_path, reader):
    reader.events.write.parquet(str(tmp_path / "e"))
    stored = AnalyticsReader(spark.read.parquet(str(tmp_path / "e")), reader.aggregates, reader.anomalies)
    query = stored.user_transactions_query("u", 5, cursor=reader.user_transactions("u", 5).next_cursor)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(user_id,u)" in plan and "LessThan(event_time" in plan


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_iso_text_in_any_zone(spark, zone):
    from rillflow.functions.expressions import epoch_ms, iso_ms

    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    times = [-1, 0, 1_710_054_000_123, 1_730_611_799_999]
    got = other.createDataFrame([(t,) for t in times], "ms long").select("ms", iso_ms(F.timestamp_millis("ms")).alias("iso")).withColumn("back", epoch_ms(F.col("iso"))).collect()
    assert all(r["back"] == r["ms"] for r in got) and got[0]["iso"] == "1969-12-31T23:59:59.999Z" and got[2]["iso"] == "2024-03-10T07:00:00.123Z"


def test_pages_of_many_requests_are_those_of_single_ones(spark, reader):
    first = reader.user_transactions("u", 7)
    asked = [
        (1, "u", None, None, None), (2, "u", first.next_cursor, None, None), (3, "v", None, None, None), (4, "u", "", datetime.fromtimestamp(1_700_000_003, UTC), datetime.fromtimestamp(1_700_000_009, UTC)),
        (5, "u", "a$", None, None), (6, "u", cursors.encode("then", "x"), None, None), (7, "u", cursors.encode(datetime(2024, 1, 1), "00000000-0000-4000-a000-000000000001"), None, None), (8, None, None, None, None),
        (9, "u", "A" * 513, None, None), (10, "u", cursors.encode(datetime(2024, 1, 1, tzinfo=UTC)), None, None),
    ]
    got = {r["request_id"]: r for r in reader.user_transactions_pages(spark.createDataFrame(asked, "request_id long, user_id string, cursor string, start_time timestamp, end_time timestamp"), 7).collect()}
    assert set(got) == set(range(1, 11))
    for n, user, cursor, start, end in asked:
        try:
            want = reader.user_transactions(user, 7, cursor=cursor, start_time=start, end_time=end)
        except BadRequest:
            assert got[n]["problem"] == "cursor" and got[n]["items"] is None and got[n]["next_cursor"] is None, n
            continue
        assert got[n]["problem"] is None and [r["event_id"] for r in got[n]["items"]] == [r["event_id"] for r in want.items] and got[n]["next_cursor"] == want.next_cursor, n


def test_pages_of_aggregates_and_anomalies(spark, reader):
    users = spark.createDataFrame([(k, u) for k, u in enumerate(("u", "u0", "u1", "nobody"))], "request_id long, user_id string")
    for many, one in ((reader.user_aggregates_pages, reader.user_aggregates), (reader.user_anomalies_pages, reader.user_anomalies)):
        asked, seen = users, {u: [] for u in ("u", "u0", "u1", "nobody")}
        while asked is not None:
            rows = many(asked, 4).collect()
            for r in rows:
                seen[r["user_id"]] += [i.asDict() for i in r["items"]]
            more = [(r["request_id"], r["user_id"], r["next_cursor"]) for r in rows if r["next_cursor"]]
            asked = spark.createDataFrame(more, "request_id long, user_id string, cursor string") if more else None
        assert {u: len(v) for u, v in seen.items()} == {u: len(walk(lambda cursor, u=u: one(u, 4, cursor=cursor))) for u in seen}
        assert seen["u" if many == reader.user_aggregates_pages else "u0"] == [r.asDict() for r in walk(lambda cursor: one("u" if many == reader.user_aggregates_pages else "u0", 4, cursor=cursor))]


def test_only_about_a_page_of_rows_is_ranked(spark):
    from rillflow.plans.reader import pages

    rows = spark.range(40_000).select((F.col("id") % 4).alias("user_id"), F.timestamp_seconds(F.floor(F.col("id") / 8)).alias("event_time"), F.col("id").alias("event_id"))
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "request_id long, user_id long")
    found = pages(rows, asked, "event_time", "event_id", "bigint", 5).persist()
    got = {r["request_id"]: [i["event_id"] for i in r["items"]] for r in found.collect()}
    assert got == {1: [39996, 39992, 39988, 39984, 39980], 2: [39997, 39993, 39989, 39985, 39981], 3: []}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_least" in plan and "SortMergeJoin [user_id" not in plan  # all rows were sorted to be joined and ranked
    few = pages(rows.where("event_id < 12"), asked, "event_time", "event_id", "bigint", 5).where("request_id = 1").first()  # fewer than a page
    assert [i["event_id"] for i in few["items"]] == [8, 4, 0] and few["next_cursor"] is None
