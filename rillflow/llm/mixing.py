"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words, source by source.  A source
whose target is T of its S words gives every document floor(T / S) times; the
rest of its budget is fitted by choosing how many documents of each length to
take once more: first in proportion to the counts, then by a bounded-knapsack
dynamic programme over what remains.  Which documents of a length are taken is
decided by a seeded hash, so reruns agree.

Cases: a null text has size 0 and takes nothing; a null source is a source of
its own, after all others; repeated rows are separate documents; a source of
no words has target 0; an empty table gives an empty result.  The catalogue of
sources (one row each) is the only thing the driver gathers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Rows, cut, map_texts
from .wordtable import WordTable

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_REPEATS = 1.5, 2
SEED = 11
KNAPSACK_WORDS = 200_000  # what the dynamic programme fits; larger budgets are first filled in proportion
MOST_BROADCAST = 100_000  # sources; more are joined by exchange
PART_ROWS, LEAST_PARTS = 200_000, 256  # the documents of one length and source are ranked in as many parts as the table has of these


def targets(sizes: list[int], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> list[float]:
    """Targets of the sources in order: shares by weight, none above ``most`` times its size, the excess reshared."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, left, active = [0.0] * len(sizes), share * sum(sizes), [k for k, s in enumerate(sizes) if s > 0]
    while active:
        unit = left / sum(weight[k] for k in active)
        over = [k for k in active if unit * weight[k] > most * sizes[k]]
        if not over:
            for k in active:
                target[k] = unit * weight[k]
            break
        for k in over:
            target[k] = float(most * sizes[k])
            left -= target[k]
        active = [k for k in active if k not in set(over)]
    return target


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is nearest to ``budget`` (bounded counts).

    Lengths and sums are taken in units of the lengths' common divisor.  Of
    each sum the step that first reached it is kept, one number for each of at
    most twice the budget; the sum before that step was reached earlier, so
    going back from the best sum takes no step twice.
    """
    taken = [0] * len(lengths)
    unit = math.gcd(*lengths) or 1
    low, rest = divmod(budget, unit)
    ideal = low + (2 * rest > unit)  # the sum that nothing can better
    if budget <= 0 or ideal == 0:
        return taken
    limit = 2 * ideal
    by, steps = np.full(limit + 1, -1, np.int32), []
    reached = np.zeros(limit + 1, bool)
    reached[0] = True
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if reached[ideal]:
            break
        size = length // unit
        if not 0 < size <= limit:
            continue
        count, pack = min(count, limit // size), 1
        while count > 0 and not reached[ideal]:  # packs of 1, 2, 4, ... make every number up to the count
            pack = min(pack, count)
            shift = size * pack
            new = shift + np.flatnonzero(reached[: limit + 1 - shift] & ~reached[shift:])
            if len(new):
                by[new] = len(steps)
                steps.append((k, pack, shift))
                reached[new] = True
            count -= pack
            pack *= 2
    sums = np.flatnonzero(reached)
    best = int(sums[np.argmin(np.abs(sums * unit - budget))])  # the lower one of two that are as near
    while best:
        k, pack, shift = steps[by[best]]
        taken[k] += pack
        best -= shift
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take for a sum near ``budget``."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    moved = True
    while left > KNAPSACK_WORDS and moved:
        moved = False
        for k in order:
            if left <= KNAPSACK_WORDS:
                break
            if taken[k] < counts[k] and 0 < lengths[k] <= left:
                taken[k] += 1
                left -= int(lengths[k])
                moved = True
    if left <= KNAPSACK_WORDS:
        taken[order] += np.array(knapsack([int(x) for x in lengths[order]], [int(x) for x in (counts - taken)[order]], left), np.int64)
    else:  # every document that is left is longer than the rest of the budget
        k = min((k for k in range(len(lengths)) if taken[k] < counts[k] and lengths[k] > 0), key=lambda k: lengths[k], default=None)
        if k is not None and lengths[k] - left < left:
            taken[k] += 1
    return taken


def _sized(docs: DataFrame) -> DataFrame:
    def run(texts: list, other: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*other, pa.array(np.diff(WordTable(texts).first))], ["doc_id", "source", "draw", "size"])

    # a row's id and text draw its lot, so rows without an id, or of the same, have lots of their own
    plain = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    drawn = plain.withColumn("draw", F.xxhash64("doc_id", F.lit(SEED), F.xxhash64("text")))
    return map_texts(drawn, run, "doc_id long, source string, draw long, size long")


def _budgets(sized: DataFrame) -> pd.DataFrame:
    """One row a source: its size, target, copies of every document, words beyond those."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    found["source"] = [s if isinstance(s, str) else None for s in found["source"].tolist()]
    found["order"] = [(s is None, (s or "").encode("utf-8", "surrogatepass")) for s in found["source"].tolist()]
    found = found.sort_values("order", ignore_index=True).drop(columns="order")
    found["target"] = np.array(targets([int(x) for x in found["source_size"]]), np.float64)
    size = found["source_size"].to_numpy(np.int64)
    found["copies"] = np.minimum(found["target"].to_numpy() // np.maximum(size, 1), MOST_REPEATS).astype(np.int64)
    found["budget"] = np.where(found["copies"] < MOST_REPEATS, np.rint(found["target"].to_numpy() - found["copies"].to_numpy() * size), 0).astype(np.int64)
    return found


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & a[name].eqNullSafe(b[name])
    return found


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    spark = docs.sparkSession
    sized = cut(_sized(docs))
    sized = sized.withColumn("part", F.pmod("draw", F.lit(max(LEAST_PARTS, -(-sized.count() // PART_ROWS)))).cast("int"))
    rows = [(s, int(n), float(t), int(c), int(b)) for s, n, t, c, b in _budgets(sized)[["source", "source_size", "target", "copies", "budget"]].astype(object).itertuples(index=False)]
    budgets = spark.createDataFrame(rows, "source string, source_size long, target double, copies long, budget long")
    parts = sized.where("size > 0").groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    counts = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    small = F.broadcast(budgets) if len(rows) <= MOST_BROADCAST else budgets  # one row a source

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        group["extra"] = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["budget"].iloc[0]))
        return group[["source", "size", "extra"]]

    # a group holds one row for each length of a source, however many documents it has
    extra = counts.join(small, counts["source"].eqNullSafe(budgets["source"])).select(counts["source"], "size", "n", "budget").groupBy("source").applyInPandas(chosen, "source string, size long, extra long")
    before = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begun = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = begun.join(extra, _same(begun, extra, "source", "size")).select(begun["source"], begun["size"], "part", (F.col("extra") - F.col("before")).alias("quota"))
    inside = W.partitionBy("source", "size", "part").orderBy("draw", "doc_id")
    ranked = sized.withColumn("rank", F.row_number().over(inside))
    joined = ranked.join(quota, _same(ranked, quota, "source", "size", "part"), "left")
    once_more = F.coalesce((F.col("rank") <= F.col("quota")).cast("long"), F.lit(0))
    return joined.join(small, ranked["source"].eqNullSafe(budgets["source"]), "left").select(
        "doc_id", ranked["size"], "source_size", "target", (ranked["size"] * (F.col("copies") + once_more)).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with all its columns.  Rows without words are left out."""
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    table = Rows(docs)
    taken = mix(table.documents("text", "source")).select(F.col("doc_id").alias("_row"), copies.alias("_copies")).where("_copies > 0")
    joined = table.rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return table.restored(joined)
