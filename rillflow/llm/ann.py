"""Approximate nearest neighbours by multi-index hashing.

Unit vectors are centred, turned to their principal axes and rotated so that
signs lose least (iterative quantisation); several such rotations give a code
of 256 bits.  A code is split into substrings of about log2(vectors) bits,
each indexed by value.  Of two codes within Hamming radius R = parts * r + a,
one of the first a + 1 substrings is within r or one of the others within
r - 1, so probing those values finds every code of the ball; floats then
decide.  R is the distance that covers nearly all true neighbours, among all
vectors, of a sample of queries.

The index lies in one of two ways, which find the same rows.  By value, it is
a table of (part, value, vector), the probes one of (part, value, query), joined
on part and value; buckets of many vectors are dealt out by a salt and searched
as a whole, so that none gives pairs beyond the nearest few, and a query whose
ball holds too few is searched in full.  Where a query has so many probes that
their rows cost more than the vectors' own (vectors without clusters, whose
neighbours are almost as far as all others), it lies by shard: the vectors are
dealt into shards, each with tables of its substrings, of the width that costs
least there; a query is sent to every shard, probes its tables, and takes its
nearest from each.  A shard in whose part of the ball there are too few is
searched in full.  A task holds one shard and some queries.

Equal vectors are one entry with their smallest ids, as larger ones can't be
among the nearest.  Vectors of a length that the sample has too few of to
learn codes from are searched in full.

Cases: vectors that are null, zero or hold a null or non-finite component take
no part; components of any finite size do, as vectors are scaled by powers of
two; those of another length are never compared; a vec_id's repeated equal
rows count once; a vec_id with different vectors is one query and one
candidate, the score of two ids being the largest of their vectors'; a null
vec_id takes no part; with fewer candidates all are returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, importable, smallest

NEAREST, EVERY = 5, 50
BITS, AXES = 256, 64
WORDS = BITS // 64
SAMPLE_VECTORS, SAMPLE_QUERIES = 4096, 512  # on which codes and the radius are learned
COVERED = 0.98  # share of the sampled queries' true neighbours that the radius holds
BLOCK_VECTORS, BLOCK_QUERIES, BATCH = 8192, 1024, 128  # in one shard; worked on at once in a shard, in a bucket
SHARD_BITS = range(8, 15)  # widths of substrings in a shard
BUCKET_VECTORS = 4096  # in one salt of a bucket
PROBE_COST = 20  # vectors that one probe's row is worth


class RotatedCodes:
    """Learned binary codes of unit vectors."""

    def fit(self, vectors: np.ndarray, seed: int = 5, rounds: int = 25) -> RotatedCodes:
        rng = np.random.default_rng(seed)
        self.mean = vectors.mean(axis=0)
        x = vectors - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        d = min(AXES, x.shape[1])
        axes = axes[:, ::-1][:, :d]
        y, turns = x @ axes, []
        for _ in range(math.ceil(BITS / d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(y.T @ np.where(y @ r >= 0, 1.0, -1.0))
                r = u @ v
            turns.append(r)
        self.turn = (axes @ np.hstack(turns))[:, :BITS]
        return self

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, word] as 64-bit numbers."""
        return np.packbits((vectors - self.mean) @ self.turn >= 0, axis=1).view(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Substrings:
    """How codes are split for a number of vectors, and how far each part is probed for a radius."""

    def __init__(self, vectors: int, radius: int, bits: int | None = None):
        parts = max(1, round(BITS / (bits or min(max(math.log2(max(vectors, 2)), 8), 40))))
        self.edges = np.linspace(0, BITS, parts + 1).astype(int)
        r, a = divmod(radius, parts)
        self.radii = [r if j <= a else r - 1 for j in range(parts)]
        sizes = np.diff(self.edges).tolist()
        each = [sum(math.comb(n, k) for k in range(most + 1)) for n, most in zip(sizes, self.radii, strict=True)]
        self.probes = sum(each)
        self.visits = sum(vectors * p / 2**n for n, p in zip(sizes, each, strict=True))  # entries in the probed buckets, if values are even

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        """Each part's values of all codes."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1)
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(self.edges, self.edges[1:])]

    def masks(self) -> list[np.ndarray]:
        """Each part's changes of a value that are probed, nearest first."""
        found = []
        for a, b, most in zip(self.edges, self.edges[1:], self.radii):
            flips = [sum(1 << k for k in some) for n in range(most + 1) for some in itertools.combinations(range(b - a), n)]
            found.append(np.array(flips, np.int64))
        return found


def _scaled(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a power of two taken out, so that nothing over- or underflows, and their lengths; cosines stay as they are to the last bit."""
    raw = np.stack([np.frombuffer(v, "<f8") for v in packed])
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return raw, np.sqrt(np.einsum("ij,ij->i", raw, raw))


def _cosines(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (a_size * b_size)


def _arrow_rows(df: DataFrame, schema: str, run) -> DataFrame:
    importable(df.sparkSession)

    def batches(it):
        for batch in it:
            for k in range(0, batch.num_rows, 2000):
                yield from run(batch.slice(k, 2000))

    return df.mapInArrow(batches, schema)


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id, vec (64-bit floats as bytes) of the rows that take part."""

    def run(batch):
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        kept_ids, kept = [], []
        for k, i in enumerate(ids):
            value = column[k]
            if i is None or not value.is_valid or value.values.null_count or not len(value.values):
                continue
            v = value.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # one zero, not two
            if np.isfinite(v).all() and v.any():
                kept_ids.append(i)
                kept.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kept_ids, pa.int64()), pa.array(kept, pa.binary())], ["vec_id", "vec"])

    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return _arrow_rows(plain, "vec_id long, vec binary", run)


def _coded(rows: DataFrame, models: dict[int, RotatedCodes]) -> DataFrame:
    """Adds ``code`` to rows with ``vec``; null where its length has no model."""
    names = rows.columns

    def run(batch):
        packed = batch.column(names.index("vec")).to_pylist()
        codes: list[bytes | None] = [None] * len(packed)
        of: dict[int, list[int]] = {}
        for k, v in enumerate(packed):
            of.setdefault(len(v), []).append(k)
        for n, at in of.items():
            if n in models:
                raw, size = _scaled([packed[k] for k in at])
                for k, c in zip(at, models[n].encode(raw / size[:, None]), strict=True):
                    codes[k] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*names, "code"])

    return _arrow_rows(rows, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", code binary", run)


class Shard:
    """Entries of one length, with a table of each substring: what has which value lies together.

    Without a radius, for lengths that no code was learned for, all are in the ball.
    """

    def __init__(self, ids: list[list[int]], packed: list[bytes], codes: list[bytes], radius: int | None, nearest: int):
        self.ids, self.radius, self.nearest = ids, radius, nearest
        self.raw, self.size = _scaled(packed)
        if radius is None:
            return
        self.codes = np.frombuffer(b"".join(codes), np.uint64).reshape(-1, WORDS)
        self.split = min((Substrings(len(ids), radius, bits) for bits in SHARD_BITS), key=lambda s: s.probes + s.visits)
        self.masks, self.order, self.starts = self.split.masks(), [], []
        for values, bits in zip(self.split.values(self.codes), np.diff(self.split.edges).tolist(), strict=True):
            self.order.append(np.argsort(values, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << bits))]))

    def ball(self, code: np.ndarray, values: list[int]) -> np.ndarray:
        """Places of the entries within the radius of a code with these substrings, by way of the tables."""
        met = np.zeros(len(self.ids), bool)
        for value, flips, order, starts in zip(values, self.masks, self.order, self.starts, strict=True):
            begin, end = starts[value ^ flips], starts[(value ^ flips) + 1]
            size = end - begin
            met[order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        at = np.flatnonzero(met)
        return at[distance(self.codes[at], code) <= self.radius]

    def search(self, query_ids: list[int], packed: list[bytes], codes: list[bytes]) -> list[tuple[int, int, float]]:
        """query_id, vec_id, score of each query's nearest in its ball; of all where the ball holds too few."""
        q, q_size = _scaled(packed)
        every, out = np.arange(len(self.ids)), []
        if self.radius is not None:
            words = np.frombuffer(b"".join(codes), np.uint64).reshape(-1, WORDS)
            values = np.stack(self.split.values(words), axis=1).tolist()
        for k, query_id in enumerate(query_ids):
            at = every if self.radius is None else self.ball(words[k], values[k])
            if len(at) < self.nearest + 1:
                at = every
            out += _top(query_id, q[k], q_size[k], at, self.raw, self.size, self.ids, self.nearest)
        return out


def _top(query_id: int, q: np.ndarray, q_size: float, at: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: list[list[int]], nearest: int) -> list[tuple[int, int, float]]:
    """query_id, vec_id, score of the nearest among the entries ``at``."""
    score = _cosines(raw[at], size[at], np.broadcast_to(q, (len(at), len(q))), q_size)
    best = np.argsort(-score, kind="stable")
    if len(best) > nearest + 1:  # and those that tie with the last of them
        best = best[: int(np.searchsorted(-score[best], -score[best[nearest]], side="right"))]
    near: dict[int, float] = {}
    for s, i in sorted((-score[b], i) for b in best for i in ids[at[b]] if i != query_id):
        if len(near) == nearest:
            break
        near.setdefault(i, -s)
    return [(query_id, i, s) for i, s in near.items()]


def _in_bucket(queries: pd.DataFrame, entries: pd.DataFrame, radii: dict[int, int], nearest: int) -> pd.DataFrame:
    """query_id, vec_id, score of each query's nearest among a bucket's entries in its ball."""
    out = []
    length = entries["vec"].map(len)
    for n, part in queries.groupby(queries["vec"].map(len)):
        own = entries[length == n]
        if not len(own):
            continue
        ids = own["ids"].tolist()
        raw, size = _scaled(own["vec"].tolist())
        codes = np.frombuffer(b"".join(own["code"]), np.uint64).reshape(-1, WORDS)
        for k in range(0, len(part), BATCH):
            some = part.iloc[k : k + BATCH]
            q, q_size = _scaled(some["vec"].tolist())
            q_codes = np.frombuffer(b"".join(some["code"]), np.uint64).reshape(-1, WORDS)
            apart = np.zeros((len(q), len(own)), np.int16)
            for w in range(WORDS):
                apart += np.bitwise_count(q_codes[:, w, None] ^ codes[None, :, w])
            for r, (query_id, rows) in enumerate(zip(some["query_id"], apart <= radii[n], strict=True)):
                out += _top(query_id, q[r], q_size[r], np.flatnonzero(rows), raw, size, ids, nearest)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _radii(entries: DataFrame, models: dict[int, RotatedCodes], sampled: dict[int, list[bytes]], nearest: int) -> dict[int, int]:
    """By length, the distance of codes that holds nearly all true neighbours of the sampled vectors, which all vectors are compared with.

    A task keeps each sampled vector's nearest so far, so what it hands on
    doesn't grow with what it reads.
    """
    units = {n: (lambda raw, size: raw / size[:, None])(*_scaled(packed)) for n, packed in sampled.items()}
    most = nearest + 1  # itself is among them

    def batches(it):
        best = {n: (np.full((len(u), most), -2.0), np.zeros((len(u), most, WORDS), np.uint64)) for n, u in units.items()}
        for batch in it:
            packed, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, unit in units.items():
                at = [k for k, v in enumerate(packed) if len(v) == n]
                for k in range(0, len(at), BLOCK_VECTORS // 4):
                    some = at[k : k + BLOCK_VECTORS // 4]
                    raw, size = _scaled([packed[i] for i in some])
                    score = np.hstack([best[n][0], unit @ (raw / size[:, None]).T])
                    own = np.frombuffer(b"".join(codes[i] for i in some), np.uint64).reshape(-1, WORDS)
                    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
                    code = np.where((top < most)[:, :, None], np.take_along_axis(best[n][1], np.minimum(top, most - 1)[:, :, None], axis=1), own[np.maximum(top - most, 0)])
                    best[n] = (np.take_along_axis(score, top, axis=1), code)
        for n, (score, code) in best.items():
            row, col = np.nonzero(score > -2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), n, np.int32)), pa.array(row), pa.array(score[row, col]), pa.array([c.tobytes() for c in code[row, col]], pa.binary())], ["len", "nth", "score", "code"])

    importable(entries.sparkSession)
    found = entries.where(F.octet_length("vec").isin(*units)).select("vec", "code").mapInArrow(batches, "len int, nth long, score double, code binary")
    rank = F.row_number().over(W.partitionBy("len", "nth").orderBy(F.desc("score"), "code"))
    near = found.withColumn("rank", rank).where((F.col("rank") > 1) & (F.col("rank") <= most)).select("len", "nth", "code").toPandas()  # a few for each sampled vector
    radii = {}
    for n, part in near.groupby("len"):
        own = models[n].encode(units[n][part["nth"].to_numpy()])
        radii[n] = int(np.quantile(distance(own, np.frombuffer(b"".join(part["code"]), np.uint64).reshape(-1, WORDS)), COVERED))
    return radii


FOUND = "query_id long, vec_id long, score double"


def _by_shards(queries: DataFrame, entries: DataFrame, radii: dict[int, int], nearest: int) -> DataFrame:
    """The nearest of each query in each shard of the entries.

    Entries are sent once and queries to every shard; a shard's entries come
    ahead of its queries, which pass by in batches.
    """
    spark = entries.sparkSession
    rows = entries.count()
    shards = max(1, math.ceil(rows / BLOCK_VECTORS), min(spark.sparkContext.defaultParallelism, math.ceil(rows * 8 / BLOCK_VECTORS)))
    left = entries.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query_id"), "vec", "code", "ids")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "vec", "code", F.lit(None).cast("array<long>").alias("ids"))
    dealt = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "query_id")  # nulls first

    def built(held: list[pa.RecordBatch]) -> dict[int, Shard]:
        of: dict[int, tuple[list, list, list]] = {}
        for batch in held:
            for vec, code, ids in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                for column, value in zip(of.setdefault(len(vec), ([], [], [])), (ids, vec, code), strict=True):
                    column.append(value)
        return {n: Shard(*columns, radii.get(n), nearest) for n, columns in of.items()}

    def batches(it):
        shard, held, index = None, [], None
        for batch in it:
            number = batch.column(0).to_numpy()
            asks = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in itertools.pairwise([0, *changes.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if number[i] != shard:
                    shard, held, index = number[i], [], None
                if not asks[i]:
                    held.append(batch.slice(i, j - i))
                    continue
                if index is None:
                    index, held = built(held), []
                for k in range(i, j, BLOCK_QUERIES):
                    some = batch.slice(k, min(BLOCK_QUERIES, j - k))
                    ids, packed, codes = (some.column(c).to_pylist() for c in (1, 2, 3))
                    out = []
                    for n in sorted({len(v) for v in packed} & set(index)):
                        at = [r for r, v in enumerate(packed) if len(v) == n]
                        out += index[n].search([ids[r] for r in at], [packed[r] for r in at], [codes[r] for r in at])
                    columns = zip(*out, strict=True) if out else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    importable(spark)
    return dealt.mapInArrow(batches, FOUND)


def _substrings(rows: DataFrame, number: str, splits: dict[int, Substrings], probes: bool) -> DataFrame:
    """len, part, value and number of each row's substrings, or of all values that are probed for it."""
    masks = {n: s.masks() for n, s in splits.items()} if probes else {}

    def run(batch):
        numbers, lengths, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for n in sorted(set(lengths.tolist())):
            at = np.flatnonzero(lengths == n)
            codes = np.frombuffer(b"".join(packed[k] for k in at), np.uint64).reshape(-1, WORDS)
            for part, values in enumerate(splits[n].values(codes)):
                flips = masks[n][part] if probes else np.zeros(1, np.int64)
                for k in range(0, len(at), max(1, 200_000 // max(len(flips), 1))):
                    some = slice(k, k + max(1, 200_000 // max(len(flips), 1)))
                    value = (values[some, None] ^ flips[None, :]).reshape(-1)
                    who = np.repeat(numbers[at[some]], len(flips))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), n, np.int32)), pa.array(np.full(len(value), part, np.int32)), pa.array(value), pa.array(who)], ["len", "part", "value", number])

    return _arrow_rows(rows.select(number, F.octet_length("vec").alias("len"), "code"), f"len int, part int, value long, {number} long", run)


def _words(rows: DataFrame, number: str, prefix: str) -> DataFrame:
    """number and the code's words as longs."""
    return rows.select(number, *[F.conv(F.hex(F.substring("code", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"{prefix}{k}") for k in range(WORDS)])


def _apart(a: str, b: str) -> Column:
    """Hamming distance of two codes given as words."""
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return total


def _by_value(queries: DataFrame, entries: DataFrame, radii: dict[int, int], splits: dict[int, Substrings], nearest: int) -> DataFrame:
    """The nearest among the codes of each query's ball, through the index of substrings."""
    key = ["len", "part", "value"]
    index, probes = _substrings(entries, "eno", splits, False), _substrings(queries, "qno", splits, True)
    sizes = index.groupBy(*key).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / BUCKET_VECTORS).cast("int")).drop("n")
    index, probes = cut(index.join(sizes, key)), cut(probes.join(sizes, key))  # a value that no vector has goes here
    radius = F.element_at(F.create_map(*[F.lit(x) for n, r in sorted(radii.items()) for x in (n, r)]), F.col("len"))

    # buckets of few vectors: pairs in the ball, then their floats
    few = index.where("salts = 1").join(probes.where("salts = 1"), key).select("len", "qno", "eno").distinct()
    near = few.join(_words(queries, "qno", "q"), "qno").join(_words(entries, "eno", "e"), "eno").where(_apart("q", "e") <= radius).select("qno", "eno")
    pairs = near.join(queries.select("qno", "query_id", F.col("vec").alias("q_vec")), "qno").join(entries.select("eno", "ids", "vec"), "eno").select("query_id", "q_vec", "vec", "ids")

    def scored(batch):
        if not batch.num_rows:
            return
        q_all, v_all = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        score = np.empty(batch.num_rows)
        for n in {len(v) for v in v_all}:
            at = [k for k, v in enumerate(v_all) if len(v) == n]
            score[at] = _cosines(*_scaled([v_all[k] for k in at]), *_scaled([q_all[k] for k in at]))
        ids = batch.column(3)
        flat, sizes_ = ids.flatten(), np.diff(ids.offsets.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes_)), flat, pa.array(np.repeat(score, sizes_))], ["query_id", "vec_id", "score"])

    cold = _arrow_rows(pairs, FOUND, scored).where("query_id <> vec_id")

    # buckets of many: as a whole, salt by salt
    left = probes.where("salts > 1").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).join(queries.select("qno", "query_id", "vec", "code"), "qno")
    right = index.where("salts > 1").withColumn("salt", F.pmod(F.xxhash64("eno"), F.col("salts")).cast("int")).join(entries.select("eno", "ids", "vec", "code"), "eno")

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _in_bucket(q, v, radii, nearest)

    hot = left.groupBy(*key, "salt").cogroup(right.groupBy(*key, "salt")).applyInPandas(run, FOUND)
    return cold.unionByName(hot)


def _best(found: DataFrame, nearest: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


def plans(radii: dict[int, int], counts: dict[int, int]) -> dict[int, Substrings]:
    """The splits of the lengths whose index lies by value."""
    splits = {n: Substrings(counts[n], r) for n, r in radii.items()}
    return {n: s for n, s in splits.items() if s.probes * PROBE_COST < counts[n]}


def search(table: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each row whose vec_id is divisible by ``every``."""
    rows = cut(_vectors(table).groupBy("vec", "vec_id").agg(F.lit(1).alias("one")).select("vec", "vec_id"))
    rank = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))  # limited before the exchange, see WindowGroupLimit
    distinct = cut(rows.withColumn("rank", rank).where(F.col("rank") <= nearest + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))

    models: dict[int, RotatedCodes] = {}
    sampled: dict[int, list[bytes]] = {}
    sample = smallest(distinct, SAMPLE_VECTORS, F.xxhash64("vec"), "vec").select("vec").toPandas()["vec"]
    lengths = sample.map(len)
    for n, seen in sorted(lengths.value_counts().items()):
        if seen > nearest + 1:  # rarer lengths are searched in full
            raw, size = _scaled(sample[lengths == n].tolist())
            models[n] = RotatedCodes().fit(raw / size[:, None])
            sampled[n] = sample[lengths == n].tolist()[:SAMPLE_QUERIES]

    entries = cut(_coded(distinct, models).withColumn("eno", F.monotonically_increasing_id()))
    queries = cut(_coded(rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), models).withColumn("qno", F.monotonically_increasing_id()))
    length = F.octet_length("vec")
    counts = {r["len"]: r["n"] for r in entries.where(length.isin(*models)).groupBy(length.alias("len")).agg(F.count("*").alias("n")).collect()} if models else {}  # at most a row a length of the sample
    radii = _radii(entries, models, sampled, nearest) if models else {}
    splits = plans(radii, counts)
    if not splits:
        return _best(_by_shards(queries, entries, radii, nearest), nearest).select("query_id", "rank", "vec_id", "score")
    probed = length.isin(*splits)
    found = cut(_best(_by_value(queries.where(probed), entries.where(probed), radii, splits, nearest), nearest))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= nearest).select("query_id")
    rest = cut(queries.join(full, "query_id", "left_anti").unionByName(queries.where(~probed)).dropDuplicates(["qno"]))
    more = _by_shards(rest, entries, {n: r for n, r in radii.items() if n not in splits}, nearest)  # in full where the ball holds too few
    return _best(found.select("query_id", "vec_id", "score").unionByName(more), nearest).select("query_id", "rank", "vec_id", "score")
