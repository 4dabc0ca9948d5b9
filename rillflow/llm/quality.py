"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The forest's trees cut the box that labelled rows span by random features and
values; a tree stops where at most one good row of its draw is left.  Rows in
parts of the box that good rows leave empty end after few cuts, and a short
mean path makes a high anomaly score, 2 ** (-path / c(draw)).  All labelled
rows teach: they span the box, every tree has a draw of its own of all good
ones (256, as the method has it), and the score above which a row is rejected
is calibrated on all of them, each scored by a forest of the other folds' rows.

Cases: a null or empty text has no words, so ``base_failed`` holds; a row
repeated is judged as often as it occurs; an empty table gives an empty
result; a null doc_id is carried through; columns besides doc_id and text are
ignored.  Without labelled rows of both kinds there is no forest: the score is
null and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sinks.tables import with_ids
from ..workers import importable
from .common import cut, filter_texts, map_texts, ordered_documents
from .wordtable import IS_SPACE, U64, WordTable, mix, window_hashes

TREES, DRAW, DEPTH = 128, 256, 14
FOLDS = 4
MOST_GOOD_REJECTED = 0.002
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SEED = 7
ASKED = 600  # good rows that a tree's hash picks, about, of which its draw are the first: without a fold's rows there still are over 256

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CHAR_START = np.array([b & 0xC0 != 0x80 for b in range(256)]) & ~IS_SPACE
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?|=~^_/\\{}[]+")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_text(t: WordTable, mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum(mask[t.buf], out=total[1:])
    return total[t.at[1:] - 1] - total[t.at[:-1]]


def _salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(doc.astype(np.uint64) + U64(1)))


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    key = _salted(hashes, doc)
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order][new], minlength=n)


def statistics(texts: list[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts, and the rule statistics of each text (one row of floats in 0..1 each)."""
    t, n = WordTable(texts), len(texts)
    words = np.diff(t.first)
    hashes = t.word_hashes()

    breaks = np.flatnonzero(t.buf == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1])
    filled = np.searchsorted(t.start, breaks) > np.searchsorted(t.start, begin)
    begin, close = begin[filled], breaks[filled]
    line_doc = np.searchsorted(t.at, begin, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    dup_lines = lines - _distinct(t.span_hash(begin, close), line_doc, n)

    repeated = np.zeros(n, np.int64)
    windows = window_hashes(hashes, WINDOW)
    if len(windows):
        whole = np.flatnonzero(t.doc[: len(windows)] == t.doc[WINDOW - 1 :])
        key = _salted(windows[whole], t.doc[whole])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
        repeated = np.bincount(t.doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    counts = dict(zip(COUNTS, (words, _per_text(t, _CHAR_START), _per_text(t, _SYMBOLS), dup_lines, repeated), strict=True))
    some, letters = np.maximum(words, 1), np.maximum(_per_text(t, _LETTER), 1)
    mean = counts["word_chars"] / some
    step = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (t.doc[1:] == t.doc[:-1])]) if len(hashes) else np.zeros(0, bool)
    features = np.column_stack([
        mean / (mean + 6),
        counts["n_symbols"] / (counts["n_symbols"] + 0.5 * some),
        dup_lines / np.maximum(lines, 1),
        repeated / some,
        _per_text(t, _UPPER) / letters,
        (marks := _per_text(t, _MARKS)) / (marks + 0.5 * some),
        (digits := _per_text(t, _DIGIT)) / (digits + 2 * some),
        np.bincount(t.doc[step], minlength=n) / some,
        _distinct(hashes, t.doc, n) / np.maximum(some, 1) ** 0.9 if len(hashes) else np.zeros(n),
    ])
    return counts, np.clip(features, 0, 1)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean depth that random cuts need to part n rows."""
    m = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


class IsolationForest:
    """Random cuts of a box; ``fit`` takes the rows that count as usual and all rows that span the box."""

    def __init__(self, trees: int = TREES, draw: int = DRAW, depth: int = DEPTH, seed: int = SEED):
        self.trees, self.draw, self.depth, self.seed = trees, draw, depth, seed

    def fit(self, usual: np.ndarray, spanning: np.ndarray) -> IsolationForest:
        rng, n = np.random.default_rng(self.seed), min(self.draw, len(usual))
        return self._grown((usual[rng.choice(len(usual), n, replace=False)] for _ in range(self.trees)), n, spanning.min(axis=0), spanning.max(axis=0), rng)

    def fit_draws(self, draws: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> IsolationForest:
        """From the rows that each tree has drawn and the box's ends."""
        return self._grown(draws, max(map(len, draws)), low, high, np.random.default_rng(self.seed))

    def _grown(self, draws: Iterable[np.ndarray], drawn: int, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> IsolationForest:
        high = np.where(high > low, high, low + 1e-9)
        self.forest = []
        for rows in draws:
            feature, value, child, path = [], [], [], []
            waiting = [(rows, low, high, 0, -1)]
            while waiting:
                rows, a, b, depth, parent = waiting.pop()
                if parent >= 0:
                    child[parent].append(len(feature))
                child.append([])
                if len(rows) <= 1 or depth >= self.depth:
                    feature.append(-1)
                    value.append(0.0)
                    path.append(depth + float(_expected(np.array(len(rows)))))
                    continue
                k = int(rng.integers(rows.shape[1]))
                cut = float(rng.uniform(a[k], b[k]))
                me = len(feature)
                feature.append(k)
                value.append(cut)
                path.append(0.0)
                left, right = b.copy(), a.copy()
                left[k], right[k] = cut, cut
                below = rows[:, k] < cut
                waiting.append((rows[~below], right, b, depth + 1, me))  # popped second
                waiting.append((rows[below], a, left, depth + 1, me))
            pairs = np.array([c if len(c) == 2 else [0, 0] for c in child])
            self.forest.append((np.array(feature), np.array(value), pairs, np.array(path)))
        self.scale = float(_expected(np.array(drawn))) or 1.0
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, value, child, path in self.forest:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth + 1):
                k = feature[at]
                inner = k >= 0
                if not inner.any():
                    break
                right = rows[np.arange(len(rows)), np.maximum(k, 0)] >= value[at]
                at = np.where(inner, child[at, right.astype(np.int64)], at)
            total += path[at]
        return 2.0 ** (-total / len(self.forest) / self.scale)


def calibrate(scores: np.ndarray, good: np.ndarray, most: float = MOST_GOOD_REJECTED) -> float:
    """The score of best balanced accuracy that rejects at most a share ``most`` of the good rows."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    lost, caught = np.cumsum(g) / max(g.sum(), 1), np.cumsum(~g) / max((~g).sum(), 1)
    last = np.append(s[1:] != s[:-1], True) & (lost <= most)
    if not last.any():
        return float("inf")
    k = int(np.flatnonzero(last)[np.argmax((caught - lost)[last])])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def calibrate_groups(groups: list[tuple[float, float, int, int]], good: int, bad: int, most: float = MOST_GOOD_REJECTED) -> float:
    """``calibrate`` over groups of rows: lowest and highest score, good and bad rows; the highest groups, to the first that may not be rejected and one more.

    A group is of one score, or of bad rows alone that lie between two good ones; cuts inside those are never best.
    """
    groups = sorted(groups, key=lambda g: -g[1])
    lost, caught = np.cumsum([g[2] for g in groups]) / max(good, 1), np.cumsum([g[3] for g in groups]) / max(bad, 1)
    last = lost <= most
    if not last.any():
        return float("inf")
    k = int(np.flatnonzero(last)[np.argmax((caught - lost)[last])])
    return (groups[k][0] + groups[k + 1][1]) / 2 if k + 1 < len(groups) else groups[k][0]


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


MEASURED = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, features array<double>"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and features of every row, kept in files: statistics are some hundred bytes a text."""

    def run(texts: list, other: list) -> pa.RecordBatch:
        counts, features = statistics(texts)
        return pa.RecordBatch.from_arrays([other[0], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(_failed(counts)), pa.array(list(features), pa.list_(pa.float64()))], ["doc_id", *COUNTS, "base_failed", "features"])

    return cut(map_texts(ordered_documents(docs), run, MEASURED))


def train(told: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """A forest and its threshold from all labelled rows that don't fail the base rules; None without rows of both kinds.

    ``told`` are documents, or what ``measured`` made of them.  Of several
    rows of a labelled id the one of least features teaches.
    """
    told = told if "features" in told.columns else measured(told)
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = told.select("doc_id", "base_failed", "features").join(labelled, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("features", "base_failed", "quality")).alias("r")).where("not r.base_failed")
    return fitted(one.select("doc_id", (F.col("r.quality") == 1).alias("good"), F.col("r.features").alias("features")))


def fitted(rows: DataFrame) -> tuple[IsolationForest, float] | None:
    """The forest of all rows (doc_id, good, features) and the threshold from the forests of all folds but one."""
    rows = cut(with_ids(rows, "nth", ["doc_id"], first=0).withColumn("fold", (F.col("nth") % FOLDS).cast("int")).drop("nth"))
    width = rows.select(F.max(F.size("features"))).first()[0] or 0
    ends = [end(F.col("features")[k]).alias(f"{name}{k}") for name, end in (("low", F.min), ("high", F.max)) for k in range(width)]
    folds = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), *ends).collect()}  # a row a fold
    good, bad = (sum(r[kind] for r in folds.values()) for kind in ("good", "bad"))
    if not good or not bad:
        return None
    asked = draws(rows, good)
    tree, fold, x = asked["tree"].to_numpy(), asked["fold"].to_numpy(), np.stack(asked["features"].to_numpy())
    begin = np.searchsorted(tree, np.arange(TREES + 1))

    def forest(without: int | None) -> IsolationForest:
        spanning = [r for f, r in folds.items() if f != without] or list(folds.values())
        own = fold != without
        own = own if own.any() else np.ones(len(fold), bool)  # a single good row is in every forest
        drawn = [x[a:b][own[a:b]][:DRAW] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        low, high = (np.array([end(r[f"{name}{k}"] for r in spanning) for k in range(width)]) for name, end in (("low", min), ("high", max)))
        return IsolationForest().fit_draws(drawn, low, high)

    return forest(None), threshold(scores_without_own_fold(rows, {f: forest(f) for f in folds}), good, bad)


def draws(rows: DataFrame, good: int):
    """The good rows of smallest hash for each tree, in order of tree and hash: enough of all of them for each forest's draw of 256, whatever their number."""
    importable(rows.sparkSession)
    share = min(1.0, ASKED / good)
    bound = U64(min(int(share * 2.0**64), 2**64 - 1))

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for tree in range(TREES):
                key = mix(own ^ mix(np.array([tree + 1], np.uint64)))
                at = np.flatnonzero(key <= bound)
                some = batch.take(pa.array(at))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(key[at].view(np.int64)), *some.columns], ["tree", "key", "doc_id", "fold", "features"])

    found = rows.where("good").select("doc_id", "fold", "features").mapInArrow(pick, "tree int, key long, doc_id long, fold int, features array<double>")
    frame = found.toPandas()  # about 600 rows a tree
    frame["key"] = frame["key"].to_numpy().view(np.uint64)
    return frame.sort_values(["tree", "key", "doc_id"], ignore_index=True)


def scores_without_own_fold(rows: DataFrame, forests: dict[int, IsolationForest]) -> DataFrame:
    """good and score of every row, by the forest of the other folds."""
    importable(rows.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            fold, x = batch.column(1).to_numpy(), np.stack(batch.column(2).to_numpy(zero_copy_only=False))
            scores = np.zeros(len(fold))
            for f in np.unique(fold):
                scores[fold == f] = forests[int(f)].score(x[fold == f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["good", "score"])

    return cut(rows.select("good", "fold", "features").mapInArrow(run, "good boolean, score double"))


def threshold(scored: DataFrame, good: int, bad: int, most: float = MOST_GOOD_REJECTED) -> float:
    """``calibrate`` over all rows; the driver gets the good scores that may be rejected, one in 500, and the bad rows between each two as a group."""
    tops = scored.where("good").groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).limit(int(most * good) + 2).collect()
    edges = np.array(sorted(r["score"] for r in tops))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = batch.column(0).to_numpy()
            at = np.searchsorted(edges, s)
            same = edges[np.minimum(at, len(edges) - 1)] == s
            yield pa.RecordBatch.from_arrays([pa.array(2 * at + same), batch.column(0)], ["at", "score"])

    between = scored.where("not good").select("score").mapInArrow(place, "at long, score double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    held = {2 * int(np.searchsorted(edges, r["score"])) + 1: [r["score"], r["score"], r["n"], 0] for r in tops}
    for r in between:
        if r["at"] in held:
            held[r["at"]][3] = r["n"]
        else:
            held[r["at"]] = [r["low"], r["high"], 0, r["n"]]
    return calibrate_groups([tuple(g) for g in held.values()], good, bad, most)


def held_out(x: np.ndarray, good: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """The score of each row by a forest that is fitted without its fold's rows."""
    fold, scores = np.arange(len(x)) % folds, np.zeros(len(x))
    for k in range(folds):
        own = fold == k
        usual = x[good & ~own] if (good & ~own).any() else x[good]  # a single good row is in every forest
        scores[own] = IsolationForest().fit(usual, x[~own] if (~own).any() else x).score(x[own])
    return scores


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, anomaly of every row."""
    told = measured(docs)
    model = train(told, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            scores = None if model is None else model[0].score(np.stack(batch.column("features").to_numpy(zero_copy_only=False)))
            kept = ~failed if model is None else ~failed & (scores < model[1])
            anomaly = pa.nulls(batch.num_rows, pa.float64()) if model is None else pa.array(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept), anomaly], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return told.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns."""
    model = train(docs, labels)

    def keep(texts: list) -> np.ndarray:
        counts, features = statistics(texts)
        kept = ~_failed(counts)
        return kept if model is None else kept & (model[0].score(features) < model[1])

    return filter_texts(docs, keep)
