"""Seeded fixture events with injected faults: late, malformed, duplicate and out-of-order records.

Every choice is a digest of the record's number and the seed, so any
partitioning, and any other engine that has MD5, gives the same records.

A sender makes record after record, one a step, and holds one back: at each
step it sends the new one if that is to overtake, else the one it holds, and
then it holds the new one; at the end it sends what is left.  A step may send
a record again that was sent before.  So each record but the repeats has a
step of its own, and ``seq`` tells all that is sent apart: twice the step, and
one more for a repeat.

``generate`` makes all of it at once; ``ticks`` is a stream source that says,
at the profile's rate, which records go out, and ``generate_stream`` gives the
same rows from it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.expressions import iso_ms, padded_id
from ..workers import importable

# fixed values: domains of the generated fields
CURRENCIES = ("NGN", "USD", "GBP", "EUR")
BAD_CURRENCIES = ("ZZZ", "INVALID")
TYPES = ("purchase", "transfer", "bill_payment", "cash_withdrawal")
BAD_TYPES = ("chargeback_test", "unknown_type")
CHUNK = 50_000
DROPPABLE = ("merchant_id", "amount", "currency", "event_time")
RESENT_FROM = 10_000  # a repeat is of one of so many records sent before
ZIPF_BUCKETS = 4096
MOST_BROADCAST_USERS = 100_000
MOST_STEPS = 100_000  # of a task of the stream source


@dataclass(frozen=True)
class Profile:
    """Rates are shares of records, 0 to 1."""

    records: int
    users: int = 1000
    merchants: int = 100
    rate_per_second: float = 100.0
    zipf: bool = False
    zipf_exponent: float = 1.2
    workers: int = 1
    burst: float = 0.0
    burst_multiplier: float = 5.0
    duplicate: float = 0.0
    late: float = 0.0
    late_max_s: float = 120.0
    out_of_order: float = 0.0
    malformed: float = 0.0
    malformed_kind: str = "structural"
    seed: int = 0
    start_ms: int = 1_704_067_200_000

    def __post_init__(self) -> None:
        if self.records < 0 or self.workers < 1 or self.users < 1 or self.merchants < 1 or self.rate_per_second <= 0 or self.late_max_s < 0 or self.zipf_exponent <= 0 or self.burst_multiplier < 1:
            raise ValueError("counts, pool sizes and the rate must be positive")
        if self.late > 0 and self.late_max_s <= 0:
            raise ValueError("late records need a delay")
        if any(not 0 <= x <= 1 for x in (self.burst, self.duplicate, self.late, self.out_of_order, self.malformed)):
            raise ValueError("rates lie between 0 and 1")
        if self.malformed_kind not in ("structural", "semantic"):
            raise ValueError("malformed_kind is structural or semantic")


FAULTY = Profile(records=6000, users=5, duplicate=0.1, late=0.1, out_of_order=0.1, malformed=0.1)


def _uniform(seed: int, salt: str, n: str = "n") -> Column:
    """A number above 0 and below 1, from the first 40 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(n).cast("string")))
    return (F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)


def _drawn(seed: int, salt: str, n: int) -> float:
    """The same in Python."""
    return (int(hashlib.md5(f"{seed}:{salt}:{n}".encode()).hexdigest()[:10], 16) + 0.5) / float(1 << 40)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _zipf_users(rows: DataFrame, p: Profile) -> DataFrame:
    """Adds ``user``: of weight 1 / rank ** exponent, by looking ``u`` up among the running shares, cut into buckets."""
    share = np.cumsum(1 / np.arange(1, p.users + 1) ** p.zipf_exponent)
    high = share / share[-1]
    low = np.concatenate([[0.0], high[:-1]])
    edges = rows.sparkSession.createDataFrame(pa.table({"user": pa.array(np.arange(p.users), pa.int64()), "low": low, "high": high}))
    bucket = lambda x: F.floor(x * ZIPF_BUCKETS)
    edges = edges.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    edges = F.broadcast(edges) if p.users <= MOST_BROADCAST_USERS else edges
    return rows.withColumn("bucket", bucket(F.col("u"))).join(edges, "bucket").where("u > low and u <= high").drop("bucket", "low", "high", "u")


def _pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def _texts(sent: DataFrame, p: Profile) -> DataFrame:
    """seq and raw of what is sent: seq, n (the record's number) and bursts (how many shorter waits were before it)."""
    salts = ("user", "late?", "lag", "a1", "a2", "bad?", "wrong", "merchant", "c", "t")
    rows = _once(sent, **{f"u{k}": _uniform(p.seed, salt) for k, salt in enumerate(salts)})
    u = lambda salt: F.col(f"u{salts.index(salt)}")
    rows = _zipf_users(rows.withColumn("u", u("user")), p) if p.zipf else rows.withColumn("user", F.floor(u("user") * p.users))
    turn = (F.col("n") - F.col("bursts")) + F.col("bursts") / F.lit(float(p.burst_multiplier))
    back = F.when(u("late?") < p.late, min(1.0, p.late_max_s) + u("lag") * max(p.late_max_s - 1, 0)).otherwise(0.0)
    normal = F.sqrt(-2 * F.log(u("a1"))) * F.cos(2 * np.pi * u("a2"))
    amount = F.floor(F.least(F.greatest(F.exp(10.5 + 0.9 * normal), F.lit(100.0)), F.lit(5_000_000.0))).cast("long")
    bad, wrong = u("bad?") < p.malformed, u("wrong")
    which = F.when(wrong < 0.5, F.floor(wrong * 2 * len(DROPPABLE))).otherwise(len(DROPPABLE))  # a field less, or an amount that is text
    rows = _once(
        rows, at=(F.lit(p.start_ms) + F.floor(turn * (1000 / (p.rate_per_second * p.workers)))).cast("long"), back=F.floor(back * 1000), amount=amount,
        semantic=bad & F.lit(p.malformed_kind == "semantic"), lacks=F.when(bad & F.lit(p.malformed_kind == "structural"), which), wrong=wrong, h=F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.col("n").cast("string"))),
    )
    keep = lambda field, value: F.when(F.col("lacks") == DROPPABLE.index(field), None).otherwise(value)
    odd = lambda third: F.col("semantic") & (F.floor(F.col("wrong") * 3) == third)
    h = F.col("h")
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("4"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12))
    record = F.struct(
        uuid.alias("event_id"), padded_id("usr_", F.col("user") + 1, 5).alias("user_id"),
        keep("merchant_id", padded_id("merchant_", F.floor(u("merchant") * p.merchants) + 1, 4)).alias("merchant_id"),
        keep("amount", F.when(odd(0), -F.col("amount")).otherwise(F.col("amount"))).alias("amount"),
        keep("currency", F.when(odd(1), _pick(BAD_CURRENCIES, u("c"))).otherwise(_pick(CURRENCIES, u("c")))).alias("currency"),
        F.when(odd(2), _pick(BAD_TYPES, u("t"))).otherwise(_pick(TYPES, u("t"))).alias("transaction_type"),
        keep("event_time", iso_ms(F.timestamp_millis((F.col("at") - F.col("back")).cast("long")))).alias("event_time"),
        iso_ms(F.timestamp_millis("at")).alias("ingest_time"), F.lit(1).alias("schema_version"),
    )
    texts = _once(rows.select("seq", "lacks", F.to_json(record).alias("text")), raw=F.when(F.col("lacks") == len(DROPPABLE), F.regexp_replace("text", r'"amount":(-?\d+)', '"amount":"$1"')).otherwise(F.col("text")))
    return texts.select("seq", "raw")  # to_json leaves null fields out


def generate(spark: SparkSession, profile: Profile, numbers: DataFrame | None = None) -> DataFrame:
    """seq (order of arrival) and raw (JSON text).

    ``numbers`` has the records' numbers 0 to ``records`` - 1 as n, where they
    are rows of another table.  The running counts of waits and the steps of
    records that were held back are taken in two levels.  Each of the
    profile's workers sends at the profile's rate, in turns.
    """
    p, u = profile, lambda salt: _uniform(profile.seed, salt)
    rows = (spark.range(p.records).withColumnRenamed("id", "n") if numbers is None else numbers).withColumn("chunk", F.floor(F.col("n") / CHUNK))
    first, step = F.col("n") == 0, F.col("n")
    rows = _once(rows, overtakes=~first & (u("swap") < p.out_of_order), burst=(u("burst?") < p.burst).cast("long"), again=~first & (u("again?") < p.duplicate))
    free = F.when(~first & ~F.col("overtakes"), step)  # a step that sends what is held
    chunks = rows.groupBy("chunk").agg(F.min(free).alias("free"), F.sum("burst").alias("bursts"))  # one row a chunk
    # frames that begin at the first row run on from row to row, those that end at the last are taken anew for each
    later, earlier = (W.orderBy(by).rowsBetween(W.unboundedPreceding, -1) for by in (F.desc("chunk"), "chunk"))
    chunks = chunks.select("chunk", F.min("free").over(later).alias("later"), F.coalesce(F.sum("bursts").over(earlier), F.lit(0)).alias("earlier"))
    behind, ahead = (W.partitionBy("chunk").orderBy(by).rowsBetween(W.unboundedPreceding, -1) for by in (F.desc("n"), "n"))
    held_until = F.coalesce(F.min(free).over(behind), F.col("later"), F.lit(p.records))
    bursts = F.col("earlier") + F.coalesce(F.sum("burst").over(ahead), F.lit(0))
    steps = rows.join(chunks, "chunk").select("n", bursts.alias("bursts"), F.when(F.col("overtakes"), step).otherwise(held_until).alias("step"))
    sent = steps.select((F.col("step") * 2).alias("seq"), "n", "bursts")
    if p.duplicate:
        back = F.floor(u("gap") * F.least(F.col("n"), F.lit(RESENT_FROM)))
        repeats = rows.where("again").select((step - back).alias("step"), (step * 2 + 1).alias("seq"))
        sent = sent.unionByName(repeats.join(steps, "step").select("seq", "n", "bursts"))
    return _texts(sent, p)


class Sender:
    """What the sender of a profile sends at each step, in Python."""

    def __init__(self, p: Profile):
        self.p = p

    def overtakes(self, n: int) -> bool:
        return n > 0 and _drawn(self.p.seed, "swap", n) < self.p.out_of_order

    def burst(self, n: int) -> int:
        return int(_drawn(self.p.seed, "burst?", n) < self.p.burst) if self.p.burst else 0

    def sent(self, step: int) -> int:
        """The record that goes out at a step from 1 to ``records``."""
        if step < self.p.records and self.overtakes(step):
            return step
        held = step - 1
        while self.overtakes(held):
            held -= 1
        return held

    def steps(self, start: int, end: int, bursts: int) -> Iterator[tuple[int, int, int]]:
        """seq, n, bursts of steps start to end - 1; ``bursts`` is of the waits before step ``start``."""
        p, known, low, high = self.p, {start: bursts}, start, start  # known without gaps from low to high

        def before(n: int) -> int:
            nonlocal low, high
            if not p.burst:
                return bursts
            while high < n:
                known[high + 1] = known[high] + self.burst(high)
                high += 1
            while low > n:
                known[low - 1] = known[low] - self.burst(low - 1)
                low -= 1
            return known[n]

        for step in range(max(start, 1), end):
            n = self.sent(step)
            yield 2 * step, n, before(n)
            if step < p.records and p.duplicate and _drawn(p.seed, "again?", step) < p.duplicate:
                n = self.sent(step - int(_drawn(p.seed, "gap", step) * min(step, RESENT_FROM)))
                yield 2 * step + 1, n, before(n)


class Steps(InputPartition):
    def __init__(self, start: int, end: int, bursts: int):
        self.start, self.end, self.bursts = start, end, bursts


class TickReader(DataSourceStreamReader):
    """Offsets are steps, with the bursts before them; steps become available as their waits pass, or at once without a clock."""

    def __init__(self, options: dict):
        self.p = Profile(**json.loads(options["profile"]))
        self.sender, self.most, self.parts = Sender(self.p), int(options.get("most", 100_000)), int(options.get("parts", 4))  # parts: at least, of a micro-batch
        self.clocked = options.get("clocked", "false").lower() == "true"
        self.began, self.at = None, {"step": 0, "bursts": 0}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"step": 0, "bursts": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        p, (step, bursts) = self.p, (self.at["step"], self.at["bursts"])
        now, self.began = time.monotonic(), time.monotonic() if self.began is None else self.began
        due = (now - self.began) * p.rate_per_second * p.workers
        last = min(p.records + 1, step + self.most)
        while step < last and not (self.clocked and step - bursts + bursts / p.burst_multiplier > due):
            bursts += self.sender.burst(step)
            step += 1
        self.at = {"step": step, "bursts": bursts}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end, key=lambda o: o["step"])  # after a restart it goes on from what was planned
        size = min(MOST_STEPS, max(1, -(-(end["step"] - start["step"]) // self.parts)))
        found, bursts = [], start["bursts"]
        for first in range(start["step"], end["step"], size):
            last = min(first + size, end["step"])
            found.append(Steps(first, last, bursts))
            bursts += sum(map(self.sender.burst, range(first, last))) if self.p.burst else 0
        return found

    def read(self, partition: Steps) -> Iterator[tuple]:
        yield from self.sender.steps(partition.start, partition.end, partition.bursts)


class Ticks(DataSource):
    """Which records go out: ``spark.readStream.format("rillflow_ticks")`` with a profile as JSON, ``most`` steps a micro-batch, ``clocked`` for the profile's rate."""

    @classmethod
    def name(cls) -> str:
        return "rillflow_ticks"

    def schema(self) -> str:
        return "seq long, n long, bursts long"

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return TickReader(self.options)


def ticks(spark: SparkSession, profile: Profile, most: int = 100_000, clocked: bool = False) -> DataFrame:
    """A stream of what goes out, replayable from any step."""
    importable(spark)
    spark.dataSource.register(Ticks)
    return spark.readStream.format("rillflow_ticks").options(profile=json.dumps(asdict(profile)), most=most, clocked=clocked, parts=max(4, spark.sparkContext.defaultParallelism)).load()


def generate_stream(spark: SparkSession, profile: Profile, most: int = 100_000, clocked: bool = False) -> DataFrame:
    """``generate`` as a stream."""
    return _texts(ticks(spark, profile, most, clocked), profile)
