"""Toxicity by non-negative positive-unlabelled learning of a linear classifier.

Confirmed toxic texts are the positives; every text open to learning, whatever
its label, counts as unlabelled, all of them.  With class prior P the risk
estimator is P * loss(positives as +) + max(0, loss(unlabelled as -) - P *
loss(positives as -)); where the second part falls below zero its gradient is
followed upwards, so the classifier can't gain by fitting the unlabelled set.
Features are the presence of lower-case words and of their beginnings; those
whose document frequencies among the positives and among all texts differ most
are kept.

The unlabelled texts come down to how often each set of kept features occurs,
in groups that are random shares of them; in each round every group takes some
steps of descent from the same weights, and the weights are averaged.  The
driver sees features and weights, never texts or their word sets.  The margin
is turned into a score by a logistic curve fitted on labelled rows that the
classifier has not seen.

Cases: a null or empty text has no words and gets the score of a text without
features; without a toxic and another labelled row to learn from every score
is 0; labels of a null doc_id are ignored, of several labels of a row the
largest holds; a null doc_id is neither held out nor learned from; repeated
rows are scored as often as they occur, and each counts as unlabelled; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, map_texts, ordered_documents, smallest
from .wordtable import U64, WordTable, mix

POSITIVES, LABELLED = 3000, 4000  # labelled rows of smallest hash that teach, and that calibrate with them
FEATURES, RATE, DECAY = 1024, 0.1, 1e-4
ROUNDS, STEPS = 8, 50  # of averaging, and of descent between
GROUP_TEXTS = 500_000  # unlabelled texts in one group
PREFIXES = (4, 5, 6)
LEAST_POSITIVES, LEAST_TEXTS = 2, 4  # in which a feature occurs
LEAST_GAIN = 4.5  # standard errors by which its frequencies differ
LEAST_SHARE = 0.5  # of toxic texts among those with a feature, as the prior and the frequencies tell
LEAST = 0.7
FOLDS, HELD_OUT = 3, 1
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def held_out(doc_id: Column) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words and of their first 4, 5 and 6 bytes, and their texts' numbers."""
    t = WordTable([(x or "").lower() for x in texts], space=_GAP)
    hashes, doc, size = [t.word_hashes()], [t.doc], t.end - t.start
    for n in PREFIXES:
        longer = size > n
        hashes.append(t.span_hash(t.start[longer], t.start[longer] + n) ^ U64(n << 40))
        doc.append(t.doc[longer])
    return np.concatenate(hashes) & U64(2**62 - 1), np.concatenate(doc)


def chosen_features(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, prior: float) -> np.ndarray:
    """Places of the features to keep, given in how many positive and unlabelled texts each occurs."""
    share = (in_p + in_u) / (n_p + n_u)
    gain = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    toxic = prior * (in_p / n_p) / ((in_u + 1) / n_u)  # estimated share of toxic texts among those with the feature
    gain[(in_p + in_u < LEAST_TEXTS) | (toxic < LEAST_SHARE)] = 0
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    return np.sort(chosen[gain[chosen] >= LEAST_GAIN])


class Sets:
    """Sets of feature numbers, one after the other, each of a weight; weights add up to 1."""

    def __init__(self, sets: list, weights: np.ndarray | None = None):
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.flat = np.concatenate([np.asarray(s, np.int64) for s in sets] + [np.zeros(0, np.int64)])
        self.weight = np.full(len(sets), 1 / max(len(sets), 1)) if weights is None else weights / weights.sum()

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.weight)) + b

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        """The gradient by weights, and by the bias at the end, from that by margins."""
        return np.append(np.bincount(self.flat, g[self.row], n), g.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(w: np.ndarray, b: float, positive: Sets, unlabelled: Sets, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam steps on the non-negative risk of both samples."""
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = positive.margins(w, b), unlabelled.margins(w, b)
        negative = (unlabelled.weight * np.logaddexp(0, zu)).sum() - prior * (positive.weight * np.logaddexp(0, zp)).sum()
        gu, gp = unlabelled.weight * _sigmoid(zu), -prior * positive.weight * _sigmoid(zp)  # of the negative part
        if negative >= 0:
            gp = gp + prior * positive.weight * (_sigmoid(zp) - 1)
        else:  # only upwards, until it is no longer negative
            gu, gp = -gu, -gp
        g = positive.back(gp, len(w)) + unlabelled.back(gu, len(w)) + DECAY * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]  # every kept feature is a likely sign, none a counter-sign
    return w, float(b)


def feature_sets(hashes: np.ndarray, doc: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature numbers of all features (ascending hashes ``keys``) in texts given by word hashes and text numbers; each once a text."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[keys & U64(0xFFFFF)] = True
    some = np.flatnonzero(maybe[hashes & U64(0xFFFFF)])
    hashes, doc = hashes[some], doc[some]
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    once = np.unique(doc[hit] * len(keys) + at[hit])
    return once // len(keys), once % len(keys)


class PositiveUnlabelled:
    """A linear classifier with a calibrated score."""

    def __init__(self, keys: np.ndarray, w: np.ndarray, b: float):
        self.keys, self.w, self.b, self.scale, self.shift = keys, w, b, 1.0, 0.0

    @classmethod
    def of(cls, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> PositiveUnlabelled:
        """From the word sets of two samples that one machine holds."""
        count = lambda sets: np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
        (known, in_p), (others, in_all) = count(positive), count(unlabelled)
        at = np.minimum(np.searchsorted(others, known), max(len(others) - 1, 0))
        in_u = np.where(others[at] == known, in_all[at], 0) if len(others) else np.zeros(len(known), np.int64)
        keys = known[chosen_features(in_p, len(positive), in_u, len(unlabelled), prior)]
        sets = lambda rows: Sets([np.flatnonzero(np.isin(keys, r)) for r in rows])
        w, b = np.zeros(len(keys)), -1.0
        for _ in range(ROUNDS):
            w, b = descend(w, b, sets(positive), sets(unlabelled), prior)
        return cls(keys.astype(np.uint64), w, b)

    def margin(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of texts given by word hashes and text numbers."""
        row, feature = feature_sets(hashes, doc, n, self.keys)
        return np.bincount(row, self.w[feature], n) + self.b

    def calibrate(self, margins: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> PositiveUnlabelled:
        """Fits the logistic curve by Newton steps with smoothed targets."""
        n_t = toxic.sum()
        y = np.where(toxic, (n_t + 1) / (n_t + 2), 1 / (len(toxic) - n_t + 2))
        x, c = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
        for _ in range(rounds):
            s = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = x.T @ (x * (s * (1 - s))[:, None]) + 1e-6 * np.eye(2)
            c = c - np.clip(np.linalg.solve(h, x.T @ (s - y)), -1, 1)
        self.scale, self.shift = float(max(c[0], 1e-6)), float(c[1])
        return self

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margins + self.shift, -50, 50)))


_ODD = mix(np.arange(1, 25, dtype=np.uint64)) | U64(1)


def _least_hashes(words_of: np.ndarray) -> np.ndarray:
    """24 least hashes of a word set."""
    return np.array([mix(words_of * k).min() for k in _ODD]) if len(words_of) else np.zeros(0, np.uint64)


def _one_of_copies(ids: list[int], sketches: list[np.ndarray]) -> list[int]:
    """Of labelled texts, those that don't share four least hashes, in one of six bands, with an earlier one: a text's copies teach once."""
    seen: set[tuple[int, bytes]] = set()
    kept = []
    for i, sketch in zip(ids, sketches, strict=True):
        bands = {(k, row.tobytes()) for k, row in enumerate(np.asarray(sketch, np.int64).reshape(-1, 4))}
        if not bands & seen:
            kept.append(i)
        seen |= bands
    return kept


def _sorted_words(texts: list) -> list[np.ndarray]:
    hashes, doc = words(texts)
    order = np.argsort(doc, kind="stable")
    return [np.unique(h) for h in np.split(hashes[order], np.searchsorted(doc[order], np.arange(1, len(texts))))]


def train(docs: DataFrame, labels: DataFrame) -> PositiveUnlabelled | None:
    """A classifier from samples of the labelled rows and all unlabelled ones; None without rows of both labels."""
    spark = docs.sparkSession
    open_ = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    open_ = open_.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = open_.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).first()
    if not share["n"] or share["share"] in (0.0, 1.0):
        return None
    prior = float(share["share"])
    sample = lambda toxic, n, seed: smallest(open_.where(F.col("toxic") == toxic), n, F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = sample(1, POSITIVES, 1).unionByName(sample(0, LABELLED, 3))
    texts = ordered_documents(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def told(texts: list, other: list) -> pa.RecordBatch:
        sets = _sorted_words(texts)
        return pa.RecordBatch.from_arrays([*other, pa.array([_least_hashes(s).astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "toxic", "sketch", "words"])

    labelled = cut(map_texts(texts.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "toxic"), told, "doc_id long, toxic int, sketch array<long>, words array<long>"))  # at most the samples' ids
    labelled = labelled.groupBy("doc_id").agg(F.min(F.struct("sketch", "toxic", "words")).alias("r")).select("doc_id", "r.*")  # of several rows of an id one
    ids = {}
    found = labelled.select("doc_id", "toxic", "sketch").toPandas().sort_values("doc_id")
    for toxic, part in found.groupby("toxic"):
        ids[toxic] = _one_of_copies(part["doc_id"].tolist(), part["sketch"].tolist())
    if len(ids.get(1, [])) < 2 or not ids.get(0):
        return None

    # features: in how many positives, then in how many of all texts
    positives = labelled.join(F.broadcast(spark.createDataFrame([(i,) for i in ids[1]], "doc_id long")), "doc_id")  # at most POSITIVES rows
    counted = positives.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_POSITIVES).toArrow()  # of at most POSITIVES texts
    order = np.argsort(counted["word"].to_numpy().astype(np.uint64))
    known, in_p = counted["word"].to_numpy().astype(np.uint64)[order], counted["n"].to_numpy()[order]

    def frequencies(texts: list, other: list) -> pa.RecordBatch:
        _, feature = feature_sets(*words(texts), len(texts), known)
        place, n = np.unique(feature, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(n, len(texts)))], ["feature", "n"])

    often = map_texts(texts.select("text"), frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    in_u, n_u = np.zeros(len(known), np.int64), int(often.loc[often["feature"] == -1, "n"].sum())
    often = often[often["feature"] >= 0]
    in_u[often["feature"].to_numpy(np.int64)] = often["n"].to_numpy(np.int64)
    keys = known[chosen_features(in_p, len(ids[1]), in_u, n_u, prior)]

    # how often each set of features occurs, in groups that are random shares of the texts
    groups = math.ceil(n_u / GROUP_TEXTS)

    def kept(texts: list, other: list) -> pa.RecordBatch:
        row, feature = feature_sets(*words(texts), len(texts), keys)
        sets = np.split(feature, np.searchsorted(row, np.arange(1, len(texts))))
        counted = pd.DataFrame({"group": other[0].to_pylist(), "features": [s.astype("<i4").tobytes() for s in sets]}).groupby(["group", "features"]).size()
        return pa.RecordBatch.from_arrays([pa.array(counted.index.get_level_values(0).tolist(), pa.int32()), pa.array(counted.index.get_level_values(1).tolist(), pa.binary()), pa.array(counted.to_numpy(), pa.int64())], ["group", "features", "n"])

    share_of = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)).cast("int").alias("group")
    found = map_texts(texts.select("text", share_of), kept, "group int, features binary, n long").groupBy("group", "features").agg(F.sum("n").alias("n"))
    sets = cut(found.coalesce(max(groups, spark.sparkContext.defaultParallelism)))  # a group's sets are few beside its texts

    # three models at once: one from each half of the positives, and one from all
    signs = labelled.select("doc_id", "toxic", F.filter("words", lambda w: w.isin([int(k) for k in keys.astype(np.int64)])).alias("words")).toPandas()
    of = {i: np.searchsorted(keys, np.sort(np.asarray(w, np.int64).astype(np.uint64))) for i, w in zip(signs["doc_id"], signs["words"], strict=True)}
    lots = [ids[1][1::2], ids[1][0::2], ids[1]]
    learned = [(np.zeros(len(keys)), -1.0)] * len(lots)
    samples = [Sets([of[i] for i in lot]) for lot in lots]
    for _ in range(ROUNDS):
        learned = _averaged(sets, learned, samples, prior)
    margins, toxic = [], []
    for fold, (w, b) in enumerate(learned[:2]):  # each half of the labelled rows is judged by what the other half taught
        tested = [*ids[1][fold::2], *ids[0][fold::2]]
        margins.append(Sets([of[i] for i in tested]).margins(w, b))
        toxic.append(np.arange(len(tested)) < len(ids[1][fold::2]))
    return PositiveUnlabelled(keys, *learned[2]).calibrate(np.concatenate(margins), np.concatenate(toxic))


def _averaged(sets: DataFrame, learned: list[tuple[np.ndarray, float]], samples: list[Sets], prior: float) -> list[tuple[np.ndarray, float]]:
    """One round: all groups descend from the same weights, and theirs are averaged by the groups' texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("features", kind="stable")
        unlabelled = Sets([np.frombuffer(f, "<i4") for f in group["features"]], group["n"].to_numpy(float))
        n, out = int(group["n"].sum()), []
        for k, ((w, b), positive) in enumerate(zip(learned, samples, strict=True)):
            w, b = descend(w, b, positive, unlabelled, prior)
            out.append(pd.DataFrame({"model": k, "place": np.arange(len(w) + 1), "value": np.append(w, b) * n, "n": n}))
        return pd.concat(out)

    exact = F.sum(F.col("value").cast("decimal(38,12)")).cast("double") / F.sum("n")  # the same in any order
    found = sets.groupBy("group").applyInPandas(run, "model int, place int, value double, n long").groupBy("model", "place").agg(exact.alias("value")).toPandas().sort_values(["model", "place"])
    rows = [part["value"].to_numpy() for _, part in found.groupby("model")]
    return [(r[:-1], float(r[-1])) for r in rows]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)

    def run(texts: list, other: list) -> pa.RecordBatch:
        scores = np.zeros(len(texts)) if model is None else model.score(model.margin(*words(texts), len(texts)))
        return pa.RecordBatch.from_arrays([*other, pa.array(scores), pa.array((scores >= LEAST).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_texts(ordered_documents(docs).select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int")
