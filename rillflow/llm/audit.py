"""How filters interact: what each of five filters removes at each step of each order in which they can be applied.

Filters A to D are rules on one text, E is a text that a smaller doc_id has as
well.  Repeated texts are found by partition refinement: rows are split by
length in code points, then by the hash of one block of the text after the
other (blocks grow eightfold), and after each split the rows that are alone in
their class are dropped.  The texts of the classes that are left are compared
in full; a row fails E if its id isn't the least among the rows of its text.
Then nothing but counts by part, set of failed filters and labels is left, and
all 120 orders are read from those.

Rows are kept from the first pass on as ids, lengths and block hashes; texts
are read a second time for classes that are left, and of a text that is there
many times each task sends one copy.  Classes are joined by broadcast up to a
checked number, else the large ones (at most ``BIG_SHARE``) by broadcast and
the others by exchange.

Cases: a null text counts as empty, a null source as the part ''; repeated
rows count as often as they occur; rows of one id and text don't fail E for
each other, and a row without an id neither fails E nor makes others fail; an
id that is labelled more than once is good or toxic if any of its labels says
so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, importable

FILTERS = "ABCDE"
REPEATED = 16  # the bit of filter E
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
FIRST_BLOCK, GROWTH, BLOCKS = 64, 8, 10  # code points of the first block, and how many blocks the longest text has
MOST_BROADCAST, BIG_SHARE = 500_000, 1536
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _failed(text: Column, length: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    rules = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * length, text.rlike(r"[#$%&*|]"))
    return sum((rule.cast("int") * (1 << k) for k, rule in enumerate(rules)), F.lit(0))


def _blocks(text: Column, length: Column) -> Column:
    """Hashes of a text's blocks in order; a text of n code points has as many as any other of n."""
    begin = [FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS)]
    bounds = F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(min(FIRST_BLOCK * GROWTH**k, 2**31 - 1)).alias("size")) for k, b in enumerate(begin)])
    return F.transform(F.filter(bounds, lambda b: b["begin"] < length), lambda b: _hash(text.substr(b["begin"] + 1, b["size"])))


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return plain.withColumn("length", F.length("text")).withColumn("blocks", _blocks(F.col("text"), F.col("length")))


def _refined(rows: DataFrame) -> DataFrame:
    """at, doc_id, part, mask, class of the rows that share a class with others after all splits."""
    left = cut(rows.select("at", "doc_id", "part", "mask", "blocks", _hash(F.col("length")).alias("class")), few=True)
    k = 0
    while True:
        # a class of one row names it, so that rows are dropped by their own numbers and no class is in one task
        alone = left.groupBy("class").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n = 1").select("at")
        left = left.join(alone, "at", "left_anti")
        more = F.size("blocks") > k
        if k:
            left = cut(left, few=True)
            if left.where(more).isEmpty():
                return left.drop("blocks")
        left = left.withColumn("class", F.when(more, _hash(F.col("class"), F.get("blocks", F.lit(k)))).otherwise(F.col("class")))
        k += 1


def _in_classes(rows: DataFrame, classes: DataFrame, known: int, total: int) -> DataFrame:
    """Rows joined with the classes (class, n, and more) that they are in; ``known`` is how many classes there are."""
    if known <= MOST_BROADCAST:
        return rows.join(F.broadcast(classes), "class")
    big = F.col("n") * BIG_SHARE >= total
    large = F.broadcast(classes.where(big))  # at most BIG_SHARE
    return rows.join(large, "class").unionByName(rows.join(large.select("class"), "class", "left_anti").join(classes.where(~big), "class"))


def _repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, part, mask of the rows that fail E; ``rows`` are all rows, ``docs`` has their texts."""
    left = _refined(rows)
    total = left.count()
    classes = cut(left.groupBy("class").agg(F.count("*").alias("n")), few=True)
    known = classes.count()
    of = F.aggregate("blocks", _hash(F.col("length")), lambda c, block: _hash(c, block))
    texts = _in_classes(_read(docs).select("doc_id", "part", "text", "length", of.alias("class")), classes, known, total)
    compared = cut(texts.groupBy("class", "text").agg(F.min("doc_id").alias("first")))
    told = cut(compared.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")).join(classes, "class"), few=True)
    found = _in_classes(left, told.where("texts = 1"), known, total).where("doc_id > first").select("doc_id", "part", "mask")
    mixed = told.where("texts > 1").select("class", "n")
    if mixed.isEmpty():
        return found
    # hashes of different texts met: there the text itself decides
    again = _in_classes(texts.drop("n"), mixed, known, total).join(compared, ["class", "text"]).where("doc_id > first")
    return found.unionByName(again.select("doc_id", "part", _failed(F.col("text"), F.col("length")).alias("mask")))


def _rows(docs: DataFrame) -> DataFrame:
    """Each row once, without its text and with a number of its own."""
    read = _read(docs)
    return cut(read.select("doc_id", "part", "length", "blocks", _failed(F.col("text"), F.col("length")).alias("mask"), F.monotonically_increasing_id().alias("at")))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of every row whose text a smaller doc_id has as well."""
    return _repeats(docs, _rows(docs)).select("doc_id")


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (n), good and toxic ones by part and mask, the set of filters that they fail as bits in the order of ``FILTERS``."""
    rows = _rows(docs)
    plain = rows.select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    # a row that fails E as well is moved from one mask to another
    moved = _repeats(docs, rows).withColumn("move", F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.lit(-1).cast("long").alias("n")), F.struct(F.lit(REPEATED).alias("bit"), F.lit(1).cast("long").alias("n")))))
    every = plain.unionByName(moved.select("doc_id", "part", (F.col("mask") + F.col("move.bit")).alias("mask"), F.col("move.n").alias("n")))
    by_id = every.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    told = by_id.join(known, "doc_id", "left")
    also = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), also("quality"), also("toxic"))


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _steps() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each order and step its filter's number, and for each mask whether such rows are kept, removed and so on there."""
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    own, earlier = bits.reshape(-1, 1), (np.cumsum(bits, axis=1) - bits).reshape(-1, 1)
    mask = np.arange(1 << len(FILTERS))
    fails, gone = mask & own > 0, mask & earlier > 0
    return np.log2(own[:, 0]).astype(np.int64), {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of ``COUNTS``, from the counts by part and mask."""
    importable(counted.sparkSession)
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))  # at most 32 a part

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = _steps()
        held = {k: v.astype(np.int64) for k, v in held.items()}
        for batch in it:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = (np.zeros(1 << len(FILTERS), np.int64) for _ in range(3))
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["quality"], c["toxic"]
                found = {k: v @ n for k, v in held.items()}
                found |= {"good_lost": held["removed"] @ good, "toxic_lost": held["removed"] @ toxic}
                found["shapley"] = np.array([found["removed"][own == k].sum() for k in range(len(FILTERS))])[own]
                steps = len(FILTERS)
                columns = [[part] * len(own), np.repeat(ORDERS, steps).tolist(), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS)), *(found[c] for c in COUNTS)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *map(pa.array, columns[2:])], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(batches, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the filters on a table of documents."""
    return interactions(counts(docs, labels))
