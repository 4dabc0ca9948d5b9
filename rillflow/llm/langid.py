"""Language identification by unigram models whose segmentations are summed out.

Each language has a probability for every piece of a fixed public vocabulary
(a byte-level one, so that any text can be segmented).  A stretch of letters
is scored by the forward algorithm, which sums over all ways to cut it into
pieces; a text's score in a language is the sum of its stretches' log
probabilities.  The piece probabilities are learned by expectation-
maximisation: forward and backward sums give each piece's expected count.

A stretch is a run of bytes that are ASCII letters or beyond ASCII, lower
case, of any length: the sums of the last places are carried on.  Its first
piece is one that the vocabulary lists with a space before it, or a single
byte.  Only what teaches is cut, into at most 256 bytes between characters.

Cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing can be learned; a null lang is not learned from; a null
doc_id is neither held out nor learned from; repeated rows are judged as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, map_texts
from .wordtable import U64, WordTable, mix

DOCUMENTS_PER_LANGUAGE = 400  # of smallest hash, from which a language is learned
MOST_BROADCAST = 100_000  # languages, or ids to learn from; more are joined by exchange
DOCUMENT_WEIGHT = 200.0  # words that each of them counts for, however long it is
ROUNDS = 4
TAUGHT_BYTES = 256  # of a stretch that teaches as a whole
HELD_OUT = 5
SMOOTHING = 0.05
_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_FIRST = U64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")
WIDTHS = (4, 8, 12, 16, 24, 40, 64, 128, TAUGHT_BYTES)  # stretches of about the same length go together, longer ones alone
CELLS, BLOCK = 3_000_000, 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """The vocabulary's pieces by the hash of their bytes; those that begin a stretch have keys of their own."""

    def __init__(self, path: str):
        inner, first = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
        with open(path, "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0])
                body = token.removeprefix(b" ")
                if body and not _GAP[np.frombuffer(body, np.uint8)].any() and body == body.lower():
                    (first if token[:1] == b" " else inner).add(body)
        keys = np.concatenate([_hashes(sorted(inner)), _hashes(sorted(first)) ^ _FIRST])
        self.keys = np.sort(keys)
        self.longest = max(map(len, inner | first))
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(keys >> U64(43)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; len(self) where there is none."""
        found = np.full(len(hashes), len(self.keys), np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> U64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[some]
        found[some[hit]] = at[hit]
        return found


def _hashes(pieces: list[bytes]) -> np.ndarray:
    t = WordTable([])
    t.buf = np.frombuffer(b"".join(pieces) + b"\n", np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    return t.span_hash(ends - np.array([len(p) for p in pieces]), ends)


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def stretches(texts: list[str | None], most: int | None = None) -> tuple[WordTable, np.ndarray, np.ndarray, np.ndarray]:
    """The table, and begin, end and text number of each stretch; with ``most`` cut into so many bytes at most, between characters."""
    t = WordTable([(x or "").lower() for x in texts], space=_GAP)
    if most is None or not (t.end - t.start > most).any():
        return t, t.start, t.end, t.doc
    begin, end, doc = [], [], []
    for a, b, d in zip(t.start.tolist(), t.end.tolist(), t.doc.tolist(), strict=True):
        while b - a > most:
            c = a + most
            while c > a + 1 and t.buf[c] & 0xC0 == 0x80:
                c -= 1
            begin.append(a)
            end.append(c)
            doc.append(d)
            a = c
        begin.append(a)
        end.append(b)
        doc.append(d)
    return t, np.array(begin, np.int64), np.array(end, np.int64), np.array(doc, np.int64)


def _lattice(pieces: Pieces, t: WordTable, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Piece numbers [row, place, length - 1] of all spans of the rows."""
    longest = min(pieces.longest, width)
    place, length = np.arange(width)[None, :, None], np.arange(1, longest + 1)[None, None, :]
    inside = place + length <= size[:, None, None]
    row, i, n = np.nonzero(inside)
    start = begin[row] + i
    hashes = t.span_hash(start, start + n + 1)
    hashes[i == 0] ^= _FIRST
    ids = np.full(inside.shape, len(pieces), np.int32)
    ids[inside] = pieces.find(hashes)
    return ids


def _forward(ids: np.ndarray, p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums [place, row, language], each place scaled by a power of e kept in the second result."""
    n, width, longest = ids.shape
    sums, scale = np.zeros((width + 1, n, p.shape[1])), np.zeros((width + 1, n))
    sums[0] = 1
    for j in range(1, width + 1):
        total = np.zeros((n, p.shape[1]))
        base = scale[max(0, j - longest) : j].max(axis=0)
        for k in range(1, min(longest, j) + 1):
            some = np.flatnonzero(ids[:, j - k, k - 1] < len(p) - 1)  # longer spans are rarely pieces
            if len(some):
                total[some] += sums[j - k, some] * p[ids[some, j - k, k - 1]] * np.exp(scale[j - k, some] - base[some])[:, None]
        top = total.max(axis=1)
        live = (top > 0) & (j <= size)
        sums[j] = np.where(live[:, None], total / np.where(live, top, 1)[:, None], 0)
        scale[j] = np.where(live, base + np.log(np.where(live, top, 1)), scale[j - 1])
    return sums, scale


def _groups(size: np.ndarray, longest: int):
    for low, width in zip((0, *WIDTHS), WIDTHS):
        some = np.flatnonzero((size > low) & (size <= width))
        rows = max(1, CELLS // (width * min(longest, width)))
        for k in range(0, len(some), rows):
            yield some[k : k + rows], width


def _one_long(pieces: Pieces, p: np.ndarray, t: WordTable, a: int, b: int) -> np.ndarray:
    """Log probabilities [language] of one stretch of any length, place after place; the sums of the last places are all that is kept."""
    longest, log = pieces.longest, 0.0
    sums = np.zeros((longest + BLOCK, p.shape[1]))
    sums[longest - 1] = 1
    back = np.arange(longest, 0, -1)
    for begin in range(0, b - a, BLOCK):
        n = min(BLOCK, b - a - begin)
        end = begin + np.arange(1, n + 1)[:, None]
        start = end - back[None, :]
        inside = start >= 0
        row, col = np.nonzero(inside)
        hashes = t.span_hash(a + start[row, col], a + begin + 1 + row)
        hashes[start[row, col] == 0] ^= _FIRST
        ids = np.full(inside.shape, len(pieces), np.int64)
        ids[inside] = pieces.find(hashes)
        chance = p[ids]
        for j in range(n):
            total = (sums[j : j + longest] * chance[j]).sum(axis=0)
            top = total.max()
            sums[j + longest] = total
            if top < 1e-90:
                sums[j + 1 : j + longest + 1] /= top
                log += math.log(top)
        sums[:longest] = sums[n : n + longest]
    return np.log(np.maximum(sums[longest - 1], 1e-300)) + log


def log_probabilities(pieces: Pieces, p: np.ndarray, t: WordTable, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[stretch, language] log probabilities over all segmentations."""
    size, out = end - begin, np.zeros((len(begin), p.shape[1]))
    for k in np.flatnonzero(size > WIDTHS[-1]):
        out[k] = _one_long(pieces, p, t, int(begin[k]), int(end[k]))
    for rows, width in _groups(size, pieces.longest):
        sums, scale = _forward(_lattice(pieces, t, begin[rows], size[rows], width), p, size[rows])
        at, k = size[rows], np.arange(len(rows))
        out[rows] = np.log(np.maximum(sums[at, k], 1e-300)) + scale[at, k][:, None]
    return out


def expected_counts(pieces: Pieces, p: np.ndarray, t: WordTable, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[piece, language] expected counts over segmentations of weighted stretches (weight [stretch, language]) of at most 256 bytes."""
    size, out, longest = end - begin, np.zeros((len(pieces) + 1, p.shape[1])), pieces.longest
    for rows, width in _groups(size, longest):
        ids, n = _lattice(pieces, t, begin[rows], size[rows], width), size[rows]
        sums, scale = _forward(ids, p, n)
        back, shift = np.zeros_like(sums), np.zeros_like(scale)
        k = np.arange(len(rows))
        for j in range(width, -1, -1):
            total, last = np.zeros((len(rows), p.shape[1])), j == n
            ahead = range(1, min(longest, width - j) + 1)
            base = shift[j + 1 : j + 1 + longest].max(axis=0) if j < width else np.zeros(len(rows))
            for m in ahead:
                some = np.flatnonzero(ids[:, j, m - 1] < len(pieces))
                if len(some):
                    total[some] += back[j + m, some] * p[ids[some, j, m - 1]] * np.exp(shift[j + m, some] - base[some])[:, None]
            total[last], base = 1.0, np.where(last, 0.0, base)
            top = total.max(axis=1)
            live = top > 0
            back[j] = np.where(live[:, None], total / np.where(live, top, 1)[:, None], 0)
            shift[j] = np.where(live, base + np.log(np.where(live, top, 1)), -1e9 if j > 0 else 0.0)
        whole, whole_scale = sums[n, k], scale[n, k]
        w = np.where(whole > 0, weight[rows] / np.maximum(whole, 1e-300), 0)
        for j in range(width):
            for m in range(1, min(longest, width - j) + 1):
                piece = ids[:, j, m - 1]
                some = np.flatnonzero((piece < len(pieces)) & (shift[j + m] > -1e8))
                if len(some):
                    e = np.exp(np.minimum(scale[j, some] + shift[j + m, some] - whole_scale[some], 600))[:, None]
                    share = sums[j, some] * p[piece[some]] * back[j + m, some] * e * w[some]
                    for c in range(p.shape[1]):
                        out[:, c] += np.bincount(piece[some], share[:, c], len(out))
    return out


class UnigramModels:
    """Piece probabilities of each language over one vocabulary file."""

    def __init__(self, path: str, languages: list[str]):
        self.path, self.languages = path, languages

    def _normal(self, counts: np.ndarray) -> np.ndarray:
        counts = counts + SMOOTHING
        counts[-1] = 0  # the row of spans that are no piece
        return counts / counts.sum(axis=0)

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> UnigramModels:
        """From words (each one stretch) and their counts [word, language]."""
        pieces = pieces_of(self.path)
        t, begin, end, doc = stretches(words, TAUGHT_BYTES)
        weight, size = counts[doc].astype(float), end - begin
        start = np.zeros((len(pieces) + 1, counts.shape[1]))
        for rows, width in _groups(size, pieces.longest):
            ids = _lattice(pieces, t, begin[rows], size[rows], width).reshape(len(rows), -1)
            for c in range(counts.shape[1]):
                start[:, c] += np.bincount(ids.ravel(), np.repeat(weight[rows, c], ids.shape[1]), len(start))
        self.p = self._normal(start)
        for _ in range(rounds):
            self.p = self._normal(expected_counts(pieces, self.p, t, begin, end, weight))
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language (``und`` without letters) and its posterior under equal priors, for each text."""
        t, begin, end, doc = stretches(texts)
        hashes = t.span_hash(begin, end)
        _, one, which = np.unique(mix(hashes), return_index=True, return_inverse=True)
        scores = log_probabilities(pieces_of(self.path), self.p, t, begin[one], end[one])[which]
        total = np.column_stack([np.bincount(doc, scores[:, c], len(texts)) for c in range(len(self.languages))])
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = np.array([bool(x) and any(m[0].isalpha() for m in _LETTER.finditer(x)) for x in texts], bool)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, path: str, per_language: int = DOCUMENTS_PER_LANGUAGE) -> UnigramModels | None:
    """Models of all languages that rows open to learning have."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    open_ = plain.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = open_.groupBy("lang").agg(F.count("*").alias("n"))
    # a bound on the hash leaves little more than per_language rows of each language to be ranked
    share = (per_language + 8 * per_language**0.5 + 100) / F.col("n")
    counts = cut(counts.coalesce(docs.sparkSession.sparkContext.defaultParallelism))
    languages = counts.count()
    small = F.broadcast(counts) if languages <= MOST_BROADCAST else counts  # one row a language
    few = open_.select("doc_id", "lang").join(small, "lang").where((share >= 1) | (F.xxhash64("doc_id") / float(2**64) + 0.5 < share)).select("doc_id", "lang").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang")
    chosen = F.broadcast(chosen) if languages * per_language <= MOST_BROADCAST else chosen  # at most per_language ids a language
    # of several rows of an id one teaches
    sample = open_.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(texts: list, other: list) -> pa.RecordBatch:
        t, begin, end, doc = stretches(texts, TAUGHT_BYTES)
        lang = np.array(other[0].to_pylist(), object)[doc] if len(doc) else np.zeros(0, object)
        weight = (DOCUMENT_WEIGHT / np.maximum(np.bincount(doc, minlength=len(texts)), 1))[doc]
        words = [t.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin, end, strict=True)]
        counted = pd.DataFrame({"lang": lang, "word": words, "n": weight}).groupby(["lang", "word"], sort=True)["n"].sum()
        return pa.RecordBatch.from_arrays([pa.array(counted.index.get_level_values(0).tolist(), pa.string()), pa.array(counted.index.get_level_values(1).tolist(), pa.string()), pa.array(counted.to_numpy(), pa.float64())], ["lang", "word", "n"])

    exact = F.sum(F.col("n").cast("decimal(30,12)")).cast("double").alias("n")  # the same in any order
    counted = map_texts(sample.select("text", "lang"), run, "lang string, word string, n double").groupBy("lang", "word").agg(exact).toPandas()
    known = sorted(counted["lang"].unique())
    if not known:
        return None
    grid = counted.pivot_table(index="word", columns="lang", values="n", aggfunc="sum", fill_value=0)[known].sort_index()
    return UnigramModels(path, known).fit(list(grid.index), grid.to_numpy())


def identify(docs: DataFrame, path: str | None = None, per_language: int = DOCUMENTS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    path = path or default_path()
    model = train(docs, path, per_language)

    def run(texts: list, other: list) -> pa.RecordBatch:
        if model is None:
            found, score = ["und"] * len(texts), np.zeros(len(texts))
        else:
            found, score = model.predict(texts)
        return pa.RecordBatch.from_arrays([*other, pa.array(found, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", held_out(F.col("doc_id")))
    return map_texts(plain, run, "doc_id long, held_out boolean, lang_pred string, score double", most=3_000_000)
