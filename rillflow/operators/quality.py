"""Reconciliation and run metrics: id sets, duplicates, latency, throughput, drain and recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..folders import scratch
from ..functions.expressions import elapsed_ms

CHUNK_ROWS = 200_000  # about so many rows are numbered in one range
MOST_CHUNKS = 2_000  # edges that rows are compared with
FEW_VALUES = 500_000  # as many counts are summed up in one task


def ids(rows: DataFrame, id_: str = "event_id") -> DataFrame:
    """The distinct ids; nulls are left out."""
    return rows.select(F.col(id_).alias("event_id")).where("event_id is not null").distinct()


def text_ids(records: DataFrame, raw: str = "raw", id_: str = "event_id") -> DataFrame:
    """The distinct ids of JSON records whose id is text; numbers, nulls, other types and what is no object don't count."""
    value = F.try_variant_get(F.try_parse_json(raw), f"$.{id_}", "variant").alias("value")
    parsed = records.select(F.inline(F.array(F.struct(value))))  # a generator's column is computed once
    return ids(parsed.where(F.schema_of_variant("value") == "STRING").select(F.col("value").try_cast("string").alias("event_id")))


def listing(rows: DataFrame, id_: str = "event_id") -> DataFrame:
    """The distinct ids in ascending order."""
    return ids(rows, id_).orderBy("event_id")


def unaccounted(raw: DataFrame, landed: DataFrame, dead: DataFrame) -> DataFrame:
    """Ids that came in and are neither landed nor dead."""
    return ids(raw).join(landed.select("event_id"), "event_id", "left_anti").join(dead.select("event_id"), "event_id", "left_anti")


def reconcile(raw: DataFrame, landed: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: distinct raw, landed and dead ids, unaccounted ids, and rows landed beyond one an id.

    All of it in one pass of flags by id.
    """
    flag = lambda rows, name: rows.select("event_id", *[F.lit(int(n == name)).alias(n) for n in ("raw", "landed", "dead")])
    flags = flag(raw, "raw").unionByName(flag(landed, "landed")).unionByName(flag(dead, "dead")).where("event_id is not null")
    by_id = flags.groupBy("event_id").agg(*[F.sum(n).alias(n) for n in ("raw", "landed", "dead")])
    return by_id.agg(
        F.count_if(F.expr("raw > 0")).alias("raw_unique"), F.count_if(F.expr("landed > 0")).alias("landed_unique"), F.count_if(F.expr("dead > 0")).alias("dead_unique"),
        F.count_if(F.expr("raw > 0 and landed = 0 and dead = 0")).alias("unaccounted"), F.coalesce(F.sum(F.greatest(F.col("landed") - 1, F.lit(0))), F.lit(0)).cast("long").alias("landed_duplicates"),
    )


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def latency(rows: DataFrame, later: str, earlier: str, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """One row of interpolated percentiles of later - earlier in milliseconds."""
    return percentiles(rows.select(elapsed_ms(F.col(later), F.col(earlier)).alias("ms")), "ms", percents)


def _chunked(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``_chunk``, the number of the range of ``order`` that a row is in, as many as the rows need; equal rows are in one, nulls in the first."""
    chunks = max(2, min(MOST_CHUNKS, -(-rows.count() // CHUNK_ROWS)))
    edges = rows.agg(F.percentile_approx(order, [k / chunks for k in range(1, chunks)], 100 * chunks)).first()[0] or []
    above = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda edge: edge < F.col(order))) if edges else F.lit(0)
    return rows.withColumn("_chunk", F.when(F.col(order).isNotNull(), above).otherwise(0))


def _counted(rows: DataFrame, value: str) -> DataFrame:
    """Each value once, with ``_upto``, how many rows are at most as large, and ``_all``, how many there are.

    Rows are first counted by value; where there are more than ``FEW_VALUES``
    of those, counts are summed up inside ranges of values and over the ranges'
    sums, so no task has to hold all of them.
    """
    counted, path = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), scratch(rows.sparkSession, "counted")
    counted.write.parquet(path)
    counted = rows.sparkSession.read.schema(counted.schema).parquet(path)
    if counted.count() <= FEW_VALUES:
        return counted.withColumn("_upto", F.sum("_n").over(W.orderBy(value))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    counted = _chunked(counted, value)
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = counted.groupBy("_chunk").agg(F.sum("_n").alias("_sum"))  # one row a range
    sums = sums.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy("_chunk").orderBy(value))
    return counted.join(F.broadcast(sums), "_chunk").withColumn("_upto", upto)


def nearest_rank(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row, ``ranked``: the value at place max(1, floor(n * share)) of the n values in order; null if there are none."""
    place = F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    return _counted(rows, value).agg(F.min(F.when(F.col("_upto") >= place, F.col(value))).alias("ranked"))


def percentiles(rows: DataFrame, value: str, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """One row, a column ``p50_ms`` for each percent: exact percentiles, between neighbours by linear interpolation."""
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value).cast("double")))  # noqa: E731  counted from 0
    rank = lambda p: (F.col("_all") - 1) * F.lit(p / 100)
    found = _counted(rows, value).agg(*[x for p in percents for x in (at(F.floor(rank(p))).alias(f"low{p}"), at(F.least(F.floor(rank(p)) + 1, F.col("_all") - 1)).alias(f"high{p}"), F.max(rank(p) - F.floor(rank(p))).alias(f"part{p}"))])
    return found.select(*[(F.col(f"low{p}") + (F.col(f"high{p}") - F.col(f"low{p}")) * F.col(f"part{p}")).alias(f"p{p}_ms") for p in percents])


def duration_stats(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, minimum, mean, maximum and nearest-rank 95th percentile; nulls without rows."""
    stats = rows.agg(F.count(value).alias("n"), F.min(value).alias("min_ms"), F.avg(value).alias("avg_ms"), F.max(value).alias("max_ms"))
    return stats.join(F.broadcast(nearest_rank(rows, value, 0.95).withColumnRenamed("ranked", "p95_ms")), F.lit(True))


def throughput(samples: DataFrame, at_ms: str, total: str) -> DataFrame:
    """One row: how far ``total`` rose between the first and last sample, a second (a millisecond at least)."""
    seconds = F.greatest((F.max(at_ms) - F.min(at_ms)) / 1000, F.lit(0.001))
    delta = F.max_by(total, at_ms) - F.min_by(total, at_ms)
    return samples.agg(delta.alias("delta"), (delta / seconds).alias("per_second"))


def _with_earlier(rows: DataFrame, value: str, order: str, most: int) -> DataFrame:
    """Adds ``_earlier_1`` to ``_earlier_most``: the value that many rows before in order of ``order``, null if there is none.

    Two levels: the rows before in ranges of ``order``, and for a range's first
    rows the last ones of the ranges before.
    """
    parts = _chunked(rows, order).withColumn("_nth", F.row_number().over(W.partitionBy("_chunk").orderBy(order)))
    size = F.count("*").over(W.partitionBy("_chunk"))
    ends = parts.withColumn("_left", size - F.col("_nth")).where(F.col("_left") < most)
    ends = ends.groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_nth", F.col(value).alias("v")))).alias("_ends"))  # ``most`` rows a range
    tails = ends.select("_chunk", F.flatten(F.collect_list("_ends").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))).alias("_tail"))
    found = parts.join(F.broadcast(tails), "_chunk")
    for k in range(1, most + 1):
        at = F.size("_tail") - (k - F.col("_nth"))  # counted from 1
        inside = F.lag(value, k).over(W.partitionBy("_chunk").orderBy(order))
        found = found.withColumn(f"_earlier_{k}", F.when(F.col("_nth") > k, inside).when(at >= 1, F.get("_tail", at - 1)["v"]))
    return found.drop("_chunk", "_nth", "_tail")


def drained(polls: DataFrame, value: str, order: str = "poll", equal: int = 3) -> DataFrame:
    """The first poll at which the last ``equal`` polls agree; none if they never do."""
    same = F.lit(True)
    for k in range(1, equal):
        same = same & (F.col(value) == F.col(f"_earlier_{k}"))
    return _with_earlier(polls, value, order, equal - 1).where(same).orderBy(order).limit(1).select(*polls.columns)


def first_growth(polls: DataFrame, value: str, order: str = "poll") -> DataFrame:
    """The first poll whose value is above the one before, with the difference."""
    found = _with_earlier(polls, value, order, 1).withColumn("growth", F.col(value) - F.col("_earlier_1"))
    return found.where("growth > 0").orderBy(order).limit(1).select(*polls.columns, "growth")


def rates(summaries: DataFrame, value: str, at_ms: str) -> DataFrame:
    """Each summary's rise since the one before, a second."""
    both = summaries.withColumn("_both", F.struct(F.col(value).alias("v"), F.col(at_ms).alias("at")))
    found = _with_earlier(both, "_both", at_ms, 1)
    rise, ms = F.col(value) - F.col("_earlier_1")["v"], F.col(at_ms) - F.col("_earlier_1")["at"]
    return found.select(*summaries.columns, (rise / F.greatest(ms / 1000, F.lit(0.001))).alias("per_second"))


def compare_runs(prior: DataFrame, fresh: DataFrame, key: str = "requested_rate") -> DataFrame:
    """Both runs' columns side by side for each rate of the prior one."""
    other = fresh.select(F.col(key), *[F.col(c).alias(f"fresh_{c}") for c in fresh.columns if c != key])
    return prior.join(other, key, "left")


def matching_metrics(metrics: DataFrame, id_: str = "id") -> DataFrame:
    """Metrics of lag, pending work, backlog or emission."""
    return metrics.where(F.lower(id_).rlike("lag|pending|backlog|emit"))


def recovery(polls: DataFrame, value: str, at_ms: str, killed_ms: int, order: str = "poll", equal: int = 3) -> DataFrame:
    """One row: when the value was first stable after a kill, and how long that took; nulls if it never was."""
    after = drained(polls.where(F.col(at_ms) >= killed_ms), value, order, equal)
    stable = F.max(at_ms)
    return after.agg(F.lit(killed_ms).alias("kill_at_ms"), stable.alias("stabilized_at_ms"), (stable - killed_ms).alias("recovery_time_ms"))


def level_report(samples: DataFrame, checkpoints: DataFrame, events: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row with one struct a part: throughput, checkpoint durations, latency, reconciliation of a load level.

    ``samples`` has at_ms and total, ``checkpoints`` ms, ``events`` received_at and event_time.
    """
    parts = {"throughput": throughput(samples, "at_ms", "total"), "checkpoints": duration_stats(checkpoints, "ms"), "latency": latency(events, "received_at", "event_time"), "reconciliation": reconciled}
    rows = [df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    report = rows[0]
    for row in rows[1:]:  # each has one row
        report = report.join(F.broadcast(row), F.lit(True))
    return report


def sent_counts(records: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row: all records, and how many have each boolean column of ``kinds`` set."""
    return records.agg(F.count("*").alias("sent"), *[F.count_if(F.col(k)).alias(k) for k in kinds])
