"""The read side: filtered, keyset-paged lookups over events, aggregates and anomalies.

Predicates for unset parameters are left out of the plan, and keysets are
written as comparisons that reach the scan, so a page is a pushed-down filter
and a TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from ..functions import cursors
from ..functions.expressions import cursor_of, cursor_parts, keyset_after
from ..schema import ANOMALY_TYPES

LEAST, MOST, USUAL = 1, 200, 50


class BadRequest(ValueError):
    """A parameter that no query is run for."""


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: str | None


def _limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not LEAST <= limit <= MOST:
        raise BadRequest(f"limit is {LEAST} to {MOST}")
    return limit


def _zoned(time: datetime | None, name: str) -> datetime | None:
    if time is not None and time.tzinfo is None:
        raise BadRequest(f"{name} needs a time zone")
    return time


def _decoded(cursor: str | None, *kinds: str) -> tuple | None:
    if not cursor:
        return None
    try:
        return cursors.decode(cursor, kinds)
    except cursors.InvalidCursor as e:
        raise BadRequest(str(e)) from e


def _earlier(end: datetime | None, at: tuple | None) -> datetime | None:
    """The latest time that a page can have."""
    return end if at is None else at[0] if end is None else min(end, at[0])


UUID_TEXT = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ASKED = {"cursor": "string", "start_time": "timestamp", "end_time": "timestamp"}


def pages(rows: DataFrame, requests: DataFrame, time: str, id_: str | None, id_kind: str, limit: int) -> DataFrame:
    """The pages of many requests in one job: the columns of ``requests``, items, next_cursor, problem.

    ``requests`` has request_id, which is unique, user_id, and any of cursor,
    start_time and end_time; null or empty ones are not given.  items are the
    rows of the page in order, null where the cursor is none of this kind.  A
    row goes no further than the requests that it fits, and ranks are limited
    before the exchange, so a user may hold any share of the rows.  What is
    ranked is first held to about the page: a request's rows fall into parts,
    and as many parts as the page has rows bring a latest time each, so at
    least so many rows are no earlier than the least of those times.
    """
    own = [c for c in requests.columns if c not in ASKED]
    asked = requests.withColumns({c: F.lit(None).cast(kind) for c, kind in ASKED.items() if c not in requests.columns})
    given = F.coalesce("cursor", F.lit("")) != ""
    parts = cursor_parts(F.col("cursor"), cursors.LONGEST)
    wanted = 1 if id_ is None else 2
    at, at_id = F.try_to_timestamp(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    told = (F.size(parts) == wanted) & at.isNotNull() & F.get(parts, F.lit(0)).rlike("(Z|[+-][0-9:]+)$")
    if id_ is not None:
        told = told & (at_id.rlike(UUID_TEXT) if id_kind == "string" else at_id.try_cast(id_kind).isNotNull())
    asked = asked.withColumn("problem", F.when(given & ~F.coalesce(told, F.lit(False)), "cursor")).withColumn("_at", F.when(given, at))
    asked = asked.withColumn("_at_id", F.when(given, at_id.try_cast(id_kind))) if id_ is not None else asked
    fits = (F.col("q.user_id") == F.col("r.user_id")) & (F.col("q.start_time").isNull() | (F.col(f"r.{time}") >= F.col("q.start_time"))) & (F.col("q.end_time").isNull() | (F.col(f"r.{time}") <= F.col("q.end_time")))
    earlier: Column = F.col(f"r.{time}") < F.col("q._at")
    if id_ is not None:
        earlier = earlier | ((F.col(f"r.{time}") == F.col("q._at")) & (F.col(f"r.{id_}") < F.col("q._at_id")))
    fits = fits & (F.col("q._at").isNull() | earlier)
    keys = [time] if id_ is None else [time, id_]
    # the requests are what is hashed, so that rows needn't be sorted to be joined
    hashed = lambda some: some.hint("shuffle_hash").alias("q")
    told = hashed(asked.where("problem is null")).join(rows.alias("r"), fits).select("q.request_id", F.col(f"r.{time}").alias("_time"), F.pmod(F.xxhash64(*[f"r.{k}" for k in keys]), F.lit(2 * limit)).alias("_part"))
    tops = told.groupBy("request_id", "_part").agg(F.max("_time").alias("_top")).groupBy("request_id").agg(F.get(F.sort_array(F.collect_list("_top"), asc=False), F.lit(limit - 1)).alias("_least"))  # 2 * limit tops a request
    fits = fits & (F.col("q._least").isNull() | (F.col(f"r.{time}") >= F.col("q._least")))
    found = hashed(asked.where("problem is null").join(tops, "request_id", "left")).join(rows.alias("r"), fits)
    found = found.select("q.request_id", F.struct(*[F.col(f"r.{c}").alias(c) for c in rows.columns]).alias("item"))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(*[F.desc(f"item.{k}") for k in keys]))
    listed = found.withColumn("_rank", rank).where(F.col("_rank") <= limit).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("_rank", "item"))).alias("_page"))  # a page a request
    page = F.transform("_page", lambda x: x["item"])
    last = F.element_at(page, -1)
    after = cursor_of(*[F.date_format(last[k], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if k == time else last[k] for k in keys])
    nothing = F.when(F.col("problem").isNull(), F.array().cast(f"array<{found.schema['item'].dataType.simpleString()}>"))
    answered = asked.join(listed, "request_id", "left")
    return answered.select(*own, F.coalesce(page, nothing).alias("items"), F.when(F.size("_page") == limit, after).alias("next_cursor"), "problem")


Rows = Callable[[object, datetime | None, datetime | None], DataFrame]


def _live(table: DataFrame | Rows) -> Rows:
    return (lambda user, start, end: table) if isinstance(table, DataFrame) else table


class AnalyticsReader:
    """Lookups over three tables with the columns of ``schema``.

    Each is a DataFrame, or a function of a user, an earliest and a latest
    time (None: any) that gives, as the table stands when it is asked, all rows
    of those and perhaps others.
    """

    def __init__(self, events: DataFrame | Rows, aggregates: DataFrame | Rows, anomalies: DataFrame | Rows, spark: SparkSession | None = None):
        self._events, self._aggregates, self._anomalies = _live(events), _live(aggregates), _live(anomalies)
        self.spark = spark or events.sparkSession

    @property
    def events(self) -> DataFrame:
        return self._events(None, None, None)

    @property
    def aggregates(self) -> DataFrame:
        return self._aggregates(None, None, None)

    @property
    def anomalies(self) -> DataFrame:
        return self._anomalies(None, None, None)

    def health(self) -> bool:
        return self.spark.sql("SELECT 1 AS ok").first()["ok"] == 1

    @staticmethod
    def _between(rows: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
        if _zoned(start, "start_time") is not None:
            rows = rows.where(F.col(column) >= F.lit(start))
        if _zoned(end, "end_time") is not None:
            rows = rows.where(F.col(column) <= F.lit(end))
        return rows

    def user_transactions_query(self, user_id, limit: int = USUAL, cursor: str | None = None, start_time: datetime | None = None, end_time: datetime | None = None) -> DataFrame:
        at = _decoded(cursor, "time", "uuid")
        _zoned(start_time, "start_time"), _zoned(end_time, "end_time")
        rows = self._events(user_id, start_time, _earlier(end_time, at)).where(F.col("user_id") == user_id)
        rows = self._between(rows, "event_time", start_time, end_time)
        if at is not None:
            rows = rows.where(keyset_after(F.col("event_time"), F.col("event_id"), at[0], str(at[1])))
        return rows.orderBy(F.desc("event_time"), F.desc("event_id")).limit(_limit(limit))

    def user_aggregates_query(self, user_id, limit: int = USUAL, cursor: str | None = None, start_time: datetime | None = None, end_time: datetime | None = None) -> DataFrame:
        at = _decoded(cursor, "time")
        _zoned(start_time, "start_time"), _zoned(end_time, "end_time")
        rows = self._aggregates(user_id, start_time, _earlier(end_time, at)).where(F.col("user_id") == user_id)
        rows = self._between(rows, "window_start", start_time, end_time)
        if at is not None:
            rows = rows.where(F.col("window_start") < F.lit(at[0]))
        return rows.orderBy(F.desc("window_start")).limit(_limit(limit))

    def anomalies_query(self, user_id=None, limit: int = USUAL, cursor: str | None = None, anomaly_type: str | None = None) -> DataFrame:
        if anomaly_type is not None and anomaly_type not in ANOMALY_TYPES:
            raise BadRequest(f"anomaly_type is one of {', '.join(ANOMALY_TYPES)}")
        at = _decoded(cursor, "time", "int")
        rows = self._anomalies(user_id, None, _earlier(None, at))
        if user_id is not None:
            rows = rows.where(F.col("user_id") == user_id)
        if anomaly_type is not None:
            rows = rows.where(F.col("anomaly_type") == anomaly_type)
        if at is not None:
            rows = rows.where(keyset_after(F.col("detected_at"), F.col("anomaly_id"), *at))
        return rows.orderBy(F.desc("detected_at"), F.desc("anomaly_id")).limit(_limit(limit))

    def user_transactions_pages(self, requests: DataFrame, limit: int = USUAL) -> DataFrame:
        """Pages of many users' events at once, see ``pages``."""
        return pages(self.events, requests, "event_time", "event_id", "string", _limit(limit))

    def user_aggregates_pages(self, requests: DataFrame, limit: int = USUAL) -> DataFrame:
        return pages(self.aggregates, requests, "window_start", None, "string", _limit(limit))

    def user_anomalies_pages(self, requests: DataFrame, limit: int = USUAL) -> DataFrame:
        return pages(self.anomalies, requests, "detected_at", "anomaly_id", "bigint", _limit(limit))

    @staticmethod
    def _page(query: DataFrame, limit: int, *keys: str) -> Page:
        # unix_micros keeps the instant whatever zone the driver's Python has
        items = query.withColumns({f"_{k}": F.date_format(k, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for k in keys if dict(query.dtypes)[k].startswith("timestamp")}).collect()
        after = cursors.encode(*[items[-1][f"_{k}"] if f"_{k}" in items[-1] else items[-1][k] for k in keys]) if len(items) == limit else None
        names = query.columns
        return Page([Row(**{n: r[n] for n in names}) for r in items], after)

    def user_transactions(self, user_id, limit: int = USUAL, **given) -> Page:
        return self._page(self.user_transactions_query(user_id, limit, **given), limit, "event_time", "event_id")

    def user_aggregates(self, user_id, limit: int = USUAL, **given) -> Page:
        return self._page(self.user_aggregates_query(user_id, limit, **given), limit, "window_start")

    def user_anomalies(self, user_id, limit: int = USUAL, **given) -> Page:
        return self._page(self.anomalies_query(user_id, limit, **given), limit, "detected_at", "anomaly_id")

    def all_anomalies(self, limit: int = USUAL, **given) -> Page:
        return self._page(self.anomalies_query(None, limit, **given), limit, "detected_at", "anomaly_id")
