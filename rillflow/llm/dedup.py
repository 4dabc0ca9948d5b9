"""Near-duplicate groups by SetSketch registers over word shingles.

A document's set is its distinct 5-word shingles.  Each shingle draws rising
exponential values for the registers in an order of its own; a register keeps
the least, as a number of steps of an exponential scale (truncated to 16
bits).  Registers of a union are the larger of two, and equal registers are
as frequent as sets are alike.

Equal sets are one class.  Bands of registers put classes into buckets.  Each
bucket first meets its most typical member (one pair a member); what that
links is contracted.  Then only pairs of different components meet: all in
buckets of up to 16 members; in larger ones by an exact prefix filter, since
two sets alike enough share one of their rarest shingles.  Pairs of fitting
sizes whose registers' joint likelihood is greatest near the threshold are
confirmed on the full sets.

Cases: a text without words has an empty set and is linked with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows are
judged row by row; a null doc_id is in no component (component_id and kept are
null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Rows, cut, importable, map_texts, ordered_documents
from .wordtable import U64, WordTable, mix, sequence_hash, window_hashes

WIDTH = 5
LINK = 85  # percent of the union that two linked sets share
REGISTERS, BANDS, ROWS = 256, 24, 5
BASE, RATE, TOP = 1.001, 20.0, 65_535
MARGIN = 0.09  # below the threshold, four standard errors of the estimate
LINKS_PER_TASK = 50_000
FEW = 16  # members of a bucket whose pairs are all tried
_DRAW = mix(np.arange(1, REGISTERS + 2, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All sets' hashes one after the other, each ascending, and the sets' sizes."""
    t = WordTable(texts, lower=True)
    hashes, sets = t.word_hashes(), []
    for a, b in zip(t.first[:-1], t.first[1:], strict=True):
        words = hashes[a:b]
        sets.append(np.unique(window_hashes(words, WIDTH)) if b - a >= WIDTH else sequence_hash(words) if b > a else np.zeros(0, np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(s) for s in sets], np.int64)


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[set, register] of sets given one after the other."""
    n = len(sizes)
    least = np.full(n * REGISTERS, np.inf)
    doc = np.repeat(np.arange(n), sizes)
    h, value = hashes, np.zeros(len(hashes))
    place = (h >> U64(3)).astype(np.int64) % REGISTERS
    stride = (h >> U64(17)).astype(np.int64) % (REGISTERS // 2) * 2 + 1  # odd, so all registers are visited once
    for j in range(REGISTERS):
        u = (mix(h ^ _DRAW[j]) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        value = value - np.log(u) / (REGISTERS - j)
        np.minimum.at(least, doc * REGISTERS + place, value)
        some = value < least.reshape(n, REGISTERS).max(axis=1)[doc]  # later values are larger still
        h, value, doc, stride = h[some], value[some], doc[some], stride[some]
        place = (place[some] + stride) % REGISTERS
        if not len(h):
            break
    with np.errstate(divide="ignore"):
        steps = np.floor(1 - (np.log(least) - math.log(RATE)) / math.log(BASE))
    return np.clip(np.nan_to_num(steps, neginf=0), 0, TOP).astype("<u2").reshape(n, REGISTERS)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, points: int = 101) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood given registers and set sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, points)[None, :] * np.minimum(u / v, v / u)[:, None]
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = step(u[:, None] - v[:, None] * grid), step(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likelihood = larger[:, None] * log(more) + smaller[:, None] * log(less) + same[:, None] * log(1 - more - less)
    return grid[np.arange(len(a)), likelihood.argmax(axis=1)]


def _key(hashes: np.ndarray) -> bytes:
    return np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes ^ U64(0xD1B54A32D192ED03)).sum(dtype=np.uint64) + U64(len(hashes))]).tobytes() if len(hashes) else b""


def _sketches(docs: DataFrame) -> DataFrame:
    def run(texts: list, other: list) -> pa.RecordBatch:
        hashes, sizes = shingle_sets(texts)
        keys = [_key(s) for s in np.split(hashes, np.cumsum(sizes)[:-1])] if len(sizes) else []
        rows = [r.tobytes() if n else b"" for r, n in zip(registers(hashes, sizes), sizes, strict=True)]
        return pa.RecordBatch.from_arrays([*other, pa.array(sizes), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n", "key", "regs"])

    return map_texts(ordered_documents(docs), run, "doc_id long, n long, key binary, regs binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, set (64-bit hashes as bytes) of the wanted (doc, key)."""

    def run(texts: list, other: list) -> pa.RecordBatch:
        hashes, sizes = shingle_sets(texts)
        sets = np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []
        keep = [k for k, (s, key) in enumerate(zip(sets, other[1].to_pylist(), strict=True)) if _key(s) == key]
        return pa.RecordBatch.from_arrays([other[0].take(pa.array(keep, pa.int64())), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["doc", "set"])

    found = ordered_documents(docs).join(wanted, F.col("doc_id") == F.col("doc")).select("text", "doc", "key")
    return map_texts(found, run, "doc long, set binary").dropDuplicates(["doc"])


def _arrow(df: DataFrame, schema: str, run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    importable(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, 1000):
                yield run(batch.slice(k, 1000))

    return df.mapInArrow(batches, schema)


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    """band, value, doc, n: one row for each band of each class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = _registers_of(batch.column("regs"))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        value = np.zeros(regs.shape[:2], np.uint64)
        for k in range(ROWS):
            value = mix(value ^ (regs[:, :, k] + U64(k << 20)))
        rows = batch.num_rows
        arrays = [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), rows)), pa.array(value.reshape(-1).view(np.int64))]
        arrays += [pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("doc", "n")]
        return pa.RecordBatch.from_arrays(arrays, ["band", "value", "doc", "n"])

    return _arrow(classes.select("doc", "n", "regs"), "band int, value long, doc long, n long", run)


def _fits(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * LINK


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share enough: estimated on registers, confirmed in full."""

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (_registers_of(batch.column(c)) for c in ("regs_a", "regs_b"))
        na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        ok = similarity(ra, rb, na, nb) >= LINK / 100 - MARGIN if batch.num_rows else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    def sure(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * shared >= LINK * (len(x) + len(y) - shared))
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    side = lambda table, name, *columns: table.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    joined = pairs.join(side(classes, "a", "n", "regs"), "a").join(side(classes, "b", "n", "regs"), "b")
    close = cut(_arrow(joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b"), "a long, b long", likely), few=True)
    whole = close.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")
    return cut(_arrow(whole.select("a", "b", "set_a", "set_b"), "a long, b long", sure), few=True)


def components(edges: DataFrame) -> DataFrame:
    """doc, component (its smallest reachable doc) of all docs that edges (a, b) name; labels fall, and jump along labels, until none changes.

    Tables of links are small beside the documents, so each step runs in as
    many tasks as they need and no more.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), few=True)
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(both.count() / LINKS_PER_TASK))
    few = lambda df: df.coalesce(parts)
    labels = cut(few(both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m")).select("doc", F.least("doc", "m").alias("component"))))
    while True:
        near = few(both.join(labels.select(F.col("doc").alias("b"), "component"), "b")).groupBy(F.col("a").alias("doc")).agg(F.min("component").alias("near"))
        fallen = few(labels.join(near, "doc")).select("doc", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        ahead = labels.select(F.col("doc").alias("component"), F.col("component").alias("ahead"))
        jumped = cut(few(fallen.join(ahead, "component", "left").select("doc", "was", F.least("component", F.coalesce("ahead", "component")).alias("component"))))
        labels = jumped.select("doc", "component")
        if jumped.where("was <> component").isEmpty():
            return labels


def _through(labels: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows with the doc in column ``name`` replaced by its component."""
    of = labels.select(F.col("doc").alias(name), F.col("component").alias("_component"))
    return rows.join(of, name, "left").withColumn(name, F.coalesce("_component", name)).drop("_component")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each bucket's most typical member with each other one."""
    typical = members.groupBy("doc").agg(F.sum("size").alias("score"))
    scored = members.join(typical, "doc")
    heads = scored.groupBy("band", "value").agg(F.max(F.struct("score", "doc", "n")).alias("head"))
    pairs = members.join(heads.select("band", "value", F.col("head.doc").alias("head"), F.col("head.n").alias("head_n")), ["band", "value"])
    return pairs.where(F.col("doc") != F.col("head")).where(_fits("n", "head_n")).select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct()


def _across(rows: DataFrame, bucket: list[str], ranked: bool = False) -> DataFrame:
    """Pairs of fitting sizes and different components in the same bucket (columns doc, n, component).

    With ``ranked`` the bucket is a shingle and ``rank`` its place among the
    doc's, rarest first.  Sets of sizes n and m that link share at least
    85 (n + m) / 185 shingles, so one of those is among the first n - that + 1
    and m - that + 1 of theirs.
    """
    mixed = rows.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*bucket)
    left = rows.join(mixed, bucket)
    right = left.select(*bucket, *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "component", *["rank"] * ranked)])
    on = [left[c] == right[c] for c in bucket]
    both = left.join(right, [*on, F.col("doc") < F.col("doc_b"), F.col("component") != F.col("component_b"), _fits("n", "n_b"), *[F.expr(f"rank{x} <= n{x} + 1 - ceil({LINK} * (n + n_b) / {100 + LINK})") for x in ("", "_b") if ranked]])
    return both.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()


def _prefixes(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """token, doc, n, component, rank: the shingles, rarest among the dense first, of which two linked sets share one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
        sizes = [len(s) for s in found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("doc").to_numpy(), sizes)), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["doc", "token"])

    tokens = _arrow(dense.join(sets, "doc").select("doc", "set"), "doc long, token long", run)
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy("often", "token")))
    near = ranked.join(dense, "doc").where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * LINK / 100) + 1)
    return cut(near.where("often > 1").select("token", "doc", "n", "component", "rank"), few=True)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sketched = cut(_sketches(docs))
    full = sketched.where("n > 0 and doc_id is not null")
    classes = cut(full.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("doc"), "n", "regs")).alias("r")).select("key", "r.*"))

    bands = _bands(classes)
    counts = bands.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(counts, ["band", "value"]), few=True)
    wanted = members.select("doc").distinct().join(classes.select("doc", "key"), "doc")
    sets = cut(_sets(docs, wanted))

    first = _links(_stars(members), classes, sets)
    labels = components(first)
    labelled = members.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    labelled = cut(labelled, few=True)
    mixed = labelled.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    dense = labelled.where(F.col("size") > FEW).join(mixed.select("band", "value"), ["band", "value"]).groupBy("doc").agg(F.max("n").alias("n"), F.max("component").alias("component"))
    sparse = _across(labelled.where(F.col("size") <= FEW), ["band", "value"])
    more = cut(sparse.unionByName(_across(_prefixes(cut(dense, few=True), sets), ["token"], ranked=True)).distinct(), few=True)
    second = _links(more, classes, sets)
    merged = components(_through(labels, _through(labels, second, "a"), "b"))  # links between components

    final = _through(merged, _through(labels, classes.select("key", F.col("doc").alias("component")), "component"), "component")
    joined = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key")).join(final, "key", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stand for their component, with all columns.

    Rows with a null or repeated doc_id are judged by their texts as all
    others; a row without words goes only if one of the same doc_id and text is there.
    """
    table = Rows(docs)
    kept = groups(table.documents("text")).where("kept").select(F.col("doc_id").alias("_row"))
    found = table.rows.join(kept, "_row", "left_semi")
    if not table.by_id:
        doc_id, text = table.of("doc_id"), table.of("text")
        again = found.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text])
        found = again.select(*table.plain).unionByName(found.where(F.col(doc_id).isNull()).select(*table.plain))
    return table.restored(found)
