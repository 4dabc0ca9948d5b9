"""Byte-level BPE in two tiers: a perfect hash of the vocabulary for whole pieces, a heap over linked bytes for the rest.

Tier one looks up all pieces of a slice of texts at once: a minimal perfect
hash gives each piece the one token that it could be, and lengths and bytes
are compared, so a piece is found if and only if it is in the vocabulary.
Tier two takes each other distinct piece: its bytes are a linked list, a heap
holds the ranks of neighbours that make a token, and the leftmost pair of
lowest rank is merged until none is left, in time n log n.  Short pieces are
merged together, a row of arrays each, and ask the hash of tier one whether
two neighbours make a token.

Ids equal those of the tiktoken library for the same ranks and splitting rule,
without special tokens.  For the rule of this family (``PATTERN``) texts are
cut by classes of code points in whole arrays; the classes are asked of that
library itself, as its Unicode version decides what a letter is.  Any other
rule is run by the ``regex`` module.

Cases: a null text counts as empty and has no tokens; repeated rows are
encoded as often as they occur; an empty table gives an empty result; a null
doc_id is carried through; the strings of special tokens are ordinary text;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import importable, map_texts, ordered_documents
from .wordtable import U64, mix, powers

SLICE = 500_000  # characters of text encoded at once
CACHE_PIECES, CACHE_BYTES = 500_000, 16_000_000  # pieces of tier two whose ids are remembered, and their bytes; beyond either all are forgotten
KEYS_A_BUCKET = 3
SHORT = 64  # bytes; a longer piece has its heap alone
CELLS = 1 << 18  # bytes of the pieces that are merged together
NONE = np.int64(2**62)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

# fixed values: the splitting rule of this family of vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, DIGIT, SPACE = range(4)


class Spans:
    """64-bit hashes of spans of some bytes, by one running sum over all of them."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * powers(BASE, len(data)), out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * powers(INVERSE, len(self.data) + 1)[begin])


class Heaps:
    """A binary heap of numbers in each row, pushed to and popped from for many rows at once.  Room is for twice the columns that it begins with."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.heap = np.full((n, 2 * width), NONE)
        self.heap[:, :width] = np.sort(rows, axis=1)  # in order, hence a heap
        self.count = (rows < NONE).sum(axis=1)

    def push(self, row: np.ndarray, value: np.ndarray) -> None:
        """A number for each row; no row twice."""
        heap, at = self.heap, self.count[row]
        self.count[row] += 1
        while len(row):
            up = (at - 1) >> 1
            above = heap[row, np.maximum(up, 0)]
            rises = (at > 0) & (above > value)
            heap[row[~rises], at[~rises]] = value[~rises]
            heap[row[rises], at[rises]] = above[rises]
            row, at, value = row[rises], up[rises], value[rises]

    def pop(self, row: np.ndarray) -> np.ndarray:
        """The least number of each row, none of which is empty or there twice."""
        heap = self.heap
        top = heap[row, 0]
        self.count[row] -= 1
        last = self.count[row]
        value = np.where(last > 0, heap[row, last], NONE)
        heap[row, last] = NONE
        at = np.zeros(len(row), np.int64)
        while len(row):
            left = 2 * at + 1
            inside = left + 1 < heap.shape[1]
            left = np.where(inside, left, 0)
            a, b = np.where(inside, heap[row, left], NONE), np.where(inside, heap[row, left + 1], NONE)
            below, child = np.minimum(a, b), left + (b < a)
            sinks = below < value
            heap[row[~sinks], at[~sinks]] = value[~sinks]
            heap[row[sinks], at[sinks]] = below[sinks]
            row, at, value = row[sinks], child[sinks], value[sinks]
        return top


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by displacing buckets.

    Keys are dealt into buckets; the largest first, each bucket gets the first
    displacement that sends all its keys to free places.  A bucket of one key
    is sent to a place that the others left free.
    """

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.buckets = max(1, self.n // KEYS_A_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)  # a displacement, or -1 - place
        bucket = self._bucket(keys)
        size = np.bincount(bucket, minlength=self.buckets)
        free = np.ones(self.n, bool)
        for most in range(int(size.max(initial=0)), 1, -1):
            order = np.argsort(bucket, kind="stable")
            members = order[np.isin(bucket[order], np.flatnonzero(size == most))].reshape(-1, most)
            tried = 0
            while len(members):
                at = self._displaced(keys[members], np.full(members.shape, tried))
                ordered = np.sort(at, axis=1)
                fits = free[at].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                # of several buckets that want a place the first has it
                flat = at[fits].reshape(-1)
                owner = np.repeat(np.arange(int(fits.sum())), most)
                first = np.full(self.n, len(owner) + 1)
                np.minimum.at(first, flat, owner)
                won = np.flatnonzero(fits)[(first[at[fits]] == np.arange(int(fits.sum()))[:, None]).all(axis=1)]
                free[at[won]] = False
                self.shift[bucket[members[won, 0]]] = tried
                members = np.delete(members, won, axis=0)
                tried += 1
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(free)[: len(single)]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(32)).astype(np.int64) % self.buckets

    def _displaced(self, keys: np.ndarray, by: np.ndarray) -> np.ndarray:
        return (mix(keys + by.astype(np.uint64) * U64(BASE)) % U64(max(self.n, 1))).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """A place of 0 .. n - 1 for each key; distinct for the keys that it was made of, any for others."""
        by = self.shift[self._bucket(keys)]
        return np.where(by < 0, -1 - by, self._displaced(keys, np.maximum(by, 0)))


class TwoTier:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tokens = list(self.ranks)
        self.longest = max(map(len, tokens))
        size = np.array([len(t) for t in tokens], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(tokens), np.uint8)
        hashes = Spans(data).hashes(begin, begin + size)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two tokens of one hash")
        self.hash = PerfectHash(hashes)
        at = self.hash.places(hashes)
        self.size, self.begin, self.id, self.data = np.zeros_like(size), np.zeros_like(size), np.zeros_like(size), data
        self.size[at], self.begin[at], self.id[at] = size, begin, np.array(list(self.ranks.values()))
        by_id = np.zeros(max(self.ranks.values()) + 1, np.int64)
        by_id[self.id] = np.arange(len(tokens))
        self.place_of = by_id  # of an id
        self.pattern = None if pattern == PATTERN else regex.compile(pattern)
        self.kind = classes() if self.pattern is None else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes, self.known_ids = 0, 0
        self.flat, self.first, self.many = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, many: np.ndarray) -> None:
        """Keeps the ids of pieces, given one after the other with how many each has; room is doubled when it is short."""
        n, at = len(self.known), self.known_ids
        while n + len(pieces) > len(self.many):
            self.first, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.many))
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[n : n + len(pieces)] = at + np.cumsum(many) - many
        self.many[n : n + len(pieces)] = many
        self.flat[at : at + len(ids)] = ids
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.known_ids, self.known_bytes = at + len(ids), self.known_bytes + sum(map(len, pieces))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at a byte
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        pending = dict((k, r) for r, k in heap)  # the rank that holds for the pair at each symbol

        def renew(k: int) -> None:
            end = after[after[k]] if after[k] < n else 0
            rank = ranks.get(piece[k:end]) if k < end <= k + longest else None
            if rank is None:
                pending.pop(k, None)
            else:
                pending[k] = rank
                heapq.heappush(heap, (rank, k))

        while heap:
            rank, k = heapq.heappop(heap)
            if pending.get(k) != rank:
                continue  # one of its symbols has been merged since
            gone = after[k]
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            pending.pop(gone, None)
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        found, k = [], 0
        while k < n:
            found.append(ranks[piece[k : after[k]]])
            k = after[k]
        return found

    def merge_rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a power of two, and how many each has: their heaps are worked on together, a row each."""
        text = Spans(np.frombuffer(b"".join(pieces), np.uint8))
        size = np.array([len(p) for p in pieces])
        base, place, rows = np.cumsum(size) - size, np.arange(width), len(pieces)
        after = np.tile(place + 1, (rows, 1))
        before = after - 2
        alive = place < size[:, None]
        pending = np.full((rows, width), NONE)
        row, k = np.nonzero(place + 2 <= size[:, None])
        rank = self.ids(text, base[row] + k, base[row] + k + 2)
        pending[row, k] = np.where(rank >= 0, rank, NONE)
        heaps = Heaps(np.where(pending < NONE, pending * width + place, NONE))

        def renew(row: np.ndarray, k: np.ndarray) -> None:
            end = after[row, k]
            more = end < size[row]
            pending[row[~more], k[~more]] = NONE
            row, k = row[more], k[more]
            rank = self.ids(text, base[row] + k, base[row] + after[row, end[more]])
            found = rank >= 0
            pending[row, k] = np.where(found, rank, NONE)
            heaps.push(row[found], (rank * width + k)[found])

        row = np.flatnonzero(heaps.count)
        while len(row):
            top = heaps.pop(row)
            k = top % width
            live = pending[row, k] == top // width  # else one of its symbols has been merged since
            at, k = row[live], k[live]
            gone = after[at, k]
            behind = after[at, gone]
            after[at, k] = behind
            inner = behind < size[at]
            before[at[inner], behind[inner]] = k[inner]
            alive[at, gone] = False
            pending[at, gone] = NONE
            renew(at, k)
            ahead = before[at, k]
            has = ahead >= 0
            renew(at[has], ahead[has])
            row = row[heaps.count[row] > 0]
        row, k = np.nonzero(alive)
        return self.ids(text, base[row] + k, base[row] + after[row, k]), alive.sum(axis=1)

    def _learn(self, pieces: list[bytes]) -> None:
        by_width: dict[int, list[bytes]] = {}
        for p in pieces:
            by_width.setdefault(0 if len(p) > SHORT else max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        for p in by_width.pop(0, []):
            ids = self.merge(p)
            self._remember([p], np.array(ids), np.array([len(ids)]))
        for width, some in by_width.items():
            step = CELLS // width
            for i in range(0, len(some), step):
                self._remember(some[i : i + step], *self.merge_rows(some[i : i + step], width))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        if len(self.known) > CACHE_PIECES or self.known_bytes > CACHE_BYTES:
            self._forget()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"".join(raw)
        text = Spans(np.frombuffer(joined, np.uint8))
        firsts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        if self.pattern is None:
            begin = cuts(text.data, firsts, self.kind)
            end = np.append(begin[1:], len(joined))
        else:
            begin, end = self._matched(texts, raw)
        whole = self.ids(text, begin, end)
        count = np.ones(len(begin), np.int64)
        missed = np.flatnonzero(whole < 0)
        pieces = [joined[a:b] for a, b in zip(begin[missed].tolist(), end[missed].tolist(), strict=True)]
        self._learn(sorted(set(pieces) - self.known.keys()))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        many = self.many[at].astype(np.int64)
        count[missed] = many
        total = np.cumsum(count)
        out = np.zeros(int(total[-1]) if len(total) else 0, np.int64)
        out[(total - count)[whole >= 0]] = whole[whole >= 0]
        out[_gather((total - count)[missed], many)] = self.flat[_gather(self.first[at].astype(np.int64), many)]
        return out, np.diff(np.append(0, total)[np.searchsorted(begin, firsts)])

    def ids(self, text: Spans, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The token that each span of bytes is, -1 where it is none."""
        place = self.hash.places(text.hashes(begin, end))
        size = end - begin
        maybe = np.flatnonzero(size == self.size[place])
        at, size = place[maybe], size[maybe]
        found = np.full(len(begin), -1, np.int64)
        if len(maybe):
            differ = text.data[_gather(begin[maybe], size)] != self.data[_gather(self.begin[at], size)]
            same = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
            found[maybe[same]] = self.id[at[same]]
        return found

    def _matched(self, texts: list[str | None], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rule's matches; what it leaves out between them has no tokens."""
        begin, end, first = [], [], 0
        for text, data in zip(texts, raw, strict=True):
            at = last = 0
            for m in self.pattern.finditer(text or ""):
                if m.end() > m.start():
                    at += len(text[last : m.start()].encode("utf-8", "surrogatepass"))
                    begin.append(first + at)
                    at += len(m[0].encode("utf-8", "surrogatepass"))
                    end.append(first + at)
                    last = m.end()
            first += len(data)
        return np.array(begin, np.int64), np.array(end, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        at = self.place_of[ids]
        return self.data[_gather(self.begin[at], self.size[at])].tobytes()


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[k] .. begin[k] + size[k] - 1 of all k, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the library's rules see it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    found = np.zeros(0x110000, np.uint8)
    for kind, rule in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        encoding = tiktoken.Encoding("class", pat_str=rule, mergeable_ranks=single, special_tokens={})
        found[np.frombuffer(bytes(encoding.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return found


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte each begins at."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begin].astype(np.uint32)
    if len(begin) == len(data):
        return lead, begin
    size = np.diff(np.append(begin, len(data)))
    point = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[begin[more] + k] & 0x3F
    return point, begin


def cuts(data: np.ndarray, firsts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The first bytes of all matches of ``PATTERN`` in texts that lie one after the other, from ``firsts`` on.

    Every character is in some match.  A match is a run of one class, with the
    last of the blanks before it where that is a space of its own; of a run of
    blanks all but the last are a match where something follows.  A lone
    apostrophe that begins a match takes an ending such as ``re`` from the
    letters behind it.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    point, begin = _code_points(data)
    n = len(point)
    of = kind[point]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(begin, firsts)] = True
    run = first.copy()
    run[0], run[n] = True, True
    run[1:n] |= of[1:] != of[:-1]
    space = of == SPACE
    ends = run[1:] & ~first[1:] & space  # the last blank of a run with something behind it in the text
    cut = run[:n] | ends
    joined = np.zeros(n, bool)
    joined[1:] = ends[:-1] & (point[:-1] == 32)  # begins behind a space that goes with it
    cut &= ~joined

    apostrophe = np.flatnonzero((point == 39) & cut & run[1:] & ~first[1:])
    apostrophe = apostrophe[of[np.minimum(apostrophe + 1, n - 1)] == LETTER]
    if len(apostrophe):
        inside = np.append(~run[:n], [False, False])  # goes on from the character before
        near = np.append(point, [0, 0])
        one, two = near[apostrophe + 1], np.where(inside[apostrophe + 2], near[np.minimum(apostrophe + 2, n)], 0)
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, [115, 116, 109, 100])
        for some, taken in ((apostrophe[short], 1), (apostrophe[pair], 2)):
            cut[some + 1] = False
            behind = some + 1 + taken
            cut[behind[behind < n]] |= True  # the rest of the letters, or what begins there in any case
    return begin[cut]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str = PATTERN) -> TwoTier:
    return TwoTier(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every row.  The file of ranks must be readable on every machine."""
    path = path or default_path()

    def run(texts: list, other: list) -> pa.RecordBatch:
        ids, sizes = vocabulary(path, pattern).encode(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([other[0], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_texts(ordered_documents(docs), run, "doc_id long, ids array<int>", most=SLICE)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and content (bytes) of rows with ids; a null array has no bytes."""
    importable(encoded.sparkSession)
    path = path or default_path()

    def batches(it):
        for batch in it:
            found = [vocabulary(path).decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, content binary")


def encoded_digests(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass over the texts."""
    path = path or default_path()

    def run(texts: list, other: list) -> pa.RecordBatch:
        vocab = vocabulary(path, pattern)
        ids, sizes = vocab.encode(texts)
        parts = np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
        digest = lambda data: hashlib.sha256(data).hexdigest()
        columns = [sizes, [digest(p.astype("<u4").tobytes()) for p in parts], [digest(vocab.decode(p)) for p in parts]]
        return pa.RecordBatch.from_arrays([other[0], *map(pa.array, columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(ordered_documents(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most=SLICE)
