"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents of equal text are linked, each with each, so the labels that a
document sees are its group's counts by shard; those are kept as one row a
group and shard, never as pairs.  Every document starts with the label of its
id's hash.  In each round the label that most neighbours have spreads to all
of a group whose quota admits it, in an order of group size; a group that no
quota admitted tries the next best label in the next round, with the room that
is left, until a round moves nothing.  A group that moved as a whole has no cut
link, so no move can better it.  Shards are set apart for groups above a shard's size, those that hold
most of them.  These, then groups that no quota admitted, then documents
without links fill what the quotas leave, group by group, so that row counts
differ by at most one (law ``rows``) and links are cut only where a shard is
full.  ``cut_links`` counts them.

Ranks and running sums are taken in two levels, inside parts of bounded size
and over the parts' totals, so no window holds a shard or a group as a whole.

Cases: a null text counts as empty (size 8) and such rows are linked with each
other; repeated rows are separate rows; a null or repeated doc_id is placed
like any other; rows of one doc_id and text are numbered and dealt out by those
numbers, so the table gives the same result however it is partitioned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

SHARDS, ROUNDS = 24, 48  # of rounds at most; few move anything
PIECES = 64  # rows of one doc_id and text are numbered in so many pieces
BIG_SHARE = 1536  # a group of at least rows / BIG_SHARE rows is big; there are at most BIG_SHARE of those
PART_ROWS, LEAST_PARTS = 20_000, 64


def _keyed(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("start"),
    )


def _told_apart(keyed: DataFrame) -> DataFrame:
    """Adds ``place``, a row's number among the rows of its doc_id and text, which don't differ in anything else."""
    row = ["doc_id", "key"]
    if keyed.groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return keyed.withColumn("place", F.lit(0).cast("long"))
    dealt = cut(keyed.withColumn("any", F.monotonically_increasing_id())).withColumn("piece", F.pmod(F.xxhash64("any"), F.lit(PIECES)))
    before = _before(dealt.groupBy(*row, "piece").agg(F.count("*").alias("n")), "n", row, ["piece"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("piece").alias("_piece"), "before")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("piece") == F.col("_piece"))
    inside = F.row_number().over(W.partitionBy(*row, "piece").orderBy("any"))
    return dealt.withColumn("_nth", inside).join(before, same).select(*keyed.columns, (F.col("before") + F.col("_nth") - 1).alias("place"))


def _before(parts: DataFrame, total: str, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``total`` over earlier parts of the same group."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(total).over(w), F.lit(0)))


def _set_apart(state: DataFrame, capacity: int, shards: int) -> list[int]:
    """As many shards as the groups above a shard's size fill, those with most of their rows first."""
    rows = state.where(F.col("total") > capacity).groupBy("shard").agg(F.sum("n").alias("n")).collect() if capacity else []  # one row a shard
    held = {r["shard"]: r["n"] for r in rows}
    wanted = -(-sum(held.values()) // max(capacity, 1))
    return sorted(range(shards), key=lambda k: (-held.get(k, 0), k))[:wanted]


def _propagate(state: DataFrame, capacity: int, big: int, parts: int, shards: int, rounds: int, apart: list[int]) -> tuple[DataFrame | None, list[int]]:
    """Groups (key, shard, total) that moved as a whole within the quotas, none into shards set apart, and the rows each shard then holds."""
    spark, used, settled = state.sparkSession, [0] * shards, []
    waiting = state.where(F.col("total") <= capacity)
    for _ in range(rounds):
        room = F.broadcast(spark.createDataFrame([(k, 0 if k in apart else capacity - used[k]) for k in range(shards)], "shard int, room long"))  # one row a shard
        wanted = (
            waiting.join(room, "shard").where("total <= room").groupBy("key")
            .agg(F.max_by(F.struct("shard", "room"), F.struct("n", "room", "shard")).alias("to"), F.max("total").alias("total"))
            .select("key", "total", "to.shard", "to.room", F.when(F.col("total") >= big, 0).otherwise(1 + F.pmod(F.xxhash64("key"), F.lit(parts))).cast("int").alias("part"))
        )
        sums = _before(wanted.groupBy("shard", "part").agg(F.sum("total").alias("rows")), "rows", ["shard"], ["part"])
        inside = W.partitionBy("shard", "part").orderBy(F.desc("total"), "key").rowsBetween(W.unboundedPreceding, 0)
        moved = cut(
            wanted.withColumn("so_far", F.sum("total").over(inside)).join(sums.select("shard", "part", "before"), ["shard", "part"])
            .where("before + so_far <= room").select("key", "shard", "total"), few=True
        )
        settled.append(moved)
        new = {r["shard"]: r["rows"] for r in moved.groupBy("shard").agg(F.sum("total").alias("rows")).collect()}  # one row a shard
        used = [u + new.get(k, 0) for k, u in enumerate(used)]
        waiting = waiting.join(moved.select("key"), "key", "left_anti")
        if not new:
            break
    return reduce(DataFrame.unionByName, settled) if settled else None, used


def _above(position: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` the position has reached."""
    return reduce(lambda a, b: a + (position >= F.lit(b)).cast("int"), bounds, F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    keyed = cut(_told_apart(cut(_keyed(docs, shards))), few=True)
    rows = keyed.count()
    capacity, extra = divmod(rows, shards)
    big, parts = max(2, -(-rows // BIG_SHARE)), max(LEAST_PARTS, -(-rows // PART_ROWS))

    counts = keyed.groupBy("key", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    whole = W.partitionBy("key")  # at most one row a shard and key
    state = cut(counts.withColumn("total", F.sum("n").over(whole)).where("total > 1"), few=True)
    apart = _set_apart(state, capacity, shards)
    settled, used = _propagate(state, capacity, big, parts, shards, rounds, apart)

    groups = state.groupBy("key").agg(F.max("total").alias("total"))
    groups = groups.join(settled.select("key", F.col("shard").alias("home")), "key", "left") if settled is not None else groups.withColumn("home", F.lit(None).cast("int"))
    groups = cut(groups, few=True)
    large, small = groups.where(F.col("total") >= big), groups.where(F.col("total") < big)
    hot = keyed.join(F.broadcast(large), "key", "left")  # at most BIG_SHARE rows
    placed = hot.where("total is not null").unionByName(hot.where("total is null").drop("total", "home").join(small, "key", "left"))

    # a group above a part's rows is a run of parts of its own
    draw, is_big, linked, home = F.xxhash64("doc_id", "key", "place"), F.col("total") >= min(big, PART_ROWS), F.col("total").isNotNull(), F.col("home").isNotNull()
    split = F.greatest(F.lit(1), F.ceil(F.col("total") * parts / F.lit(max(rows, 1))))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "key", "place",
        F.coalesce("home", F.lit(-1)).alias("home"),
        F.when(home, 0).when(is_big, 1).when(linked, 2).otherwise(3).alias("kind"),
        F.when(~home & is_big, -F.col("total")).otherwise(F.lit(0)).alias("rank"),
        F.when(~home & is_big, F.xxhash64("key")).otherwise(F.lit(0)).alias("group"),
        F.when(~home & is_big, F.pmod(draw, split)).when(~home & linked, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.pmod(draw, F.lit(parts))).cast("int").alias("part"),
    )
    part = ["home", "kind", "rank", "group", "part"]
    # "home" alone would put all rows of one shard's parts together; the totals have one row a part
    before = _before(placed.groupBy(*part).agg(F.count("*").alias("n")), "n", ["home"], part[1:])
    inside = W.partitionBy(*part).orderBy("key", "doc_id", "place")
    position = F.col("before") + F.row_number().over(inside) - 1
    ranked = placed.join(before.select(*part, "before"), part).withColumn("position", position)

    room = [capacity + (k < extra) - used[k] for k in range(shards)]
    filled = apart + sorted((k for k in range(shards) if k not in apart), key=lambda k: (-room[k], k))  # shards in the order in which they fill up
    begins = [sum(room[k] for k in filled[:n]) for n in range(shards)]
    at = _above(F.col("position"), begins[1:]) + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    offset = pick([used[k] - b for k, b in zip(filled, begins, strict=True)]).cast("long")
    return ranked.withColumn("shard", F.when(F.col("home") >= 0, F.col("home")).otherwise(pick(filled)).cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.when(F.col("home") >= 0, F.col("position")).otherwise(F.col("position") + offset).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: links between rows of equal text (told by size and checksum), and how many of them join different shards."""
    pairs = lambda n: n * (n - 1) / 2
    cells = sharded.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("size", "text_crc32").agg(pairs(F.sum("n")).cast("long").alias("links"), F.sum(pairs(F.col("n"))).cast("long").alias("whole"))
    return groups.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("links") - F.col("whole")), F.lit(0)).alias("cut"))
