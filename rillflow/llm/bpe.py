"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of a piece's tree hold ``rank * width + place`` of the pair that
begins at each symbol; a node holds the least of its two children, so the root
is the leftmost pair of lowest rank.  A merge changes three leaves and the
nodes above them; it ends when the root holds no rank.  Short pieces of equal
width are merged together, a row each, longer ones alone with a plain tree:
time is n log n in a piece's length either way.

Ids equal those of the tokenizers library for the same file (a byte-level
model with its splitting rule, added tokens found in the text, no special
tokens put around it).  Texts of code points that any Unicode version classes
alike are split here; others are split by that library's own splitter, since
its Unicode version decides what a letter is.

Cases: a null text counts as empty and has no tokens; the added token's string
in a text is that token; repeated rows are encoded as often as they occur; an
empty table gives an empty result; a null doc_id is carried through.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import importable, map_texts, ordered_documents

NONE = np.int64(2**62)
SHORT = 64  # bytes; longer pieces have a tree of their own
TREE_CELLS = 1 << 18  # leaves of the trees that are merged at once
SLICE = 300_000  # bytes of text encoded at once
CACHE_PIECES, CACHE_BYTES = 150_000, 4_000_000  # pieces whose ids are remembered, and their bytes; beyond either all are forgotten

# fixed values: the splitting rule of this family of vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: blocks whose letters, digits and spaces were settled long ago
SETTLED = "[\\0-ԧ‐-⁞₠-₸←-⏧①-⛿ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f320\U0001f600-\U0001f640]*+"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in found]
    return found | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, character = spec["model"]["vocab"], byte_characters()
        byte_of = {c: b for b, c in character.items()}
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[character[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.pair = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        most = max([*vocab.values(), *self.added.values()]) + 1
        shown = [b""] * most
        for token, k in vocab.items():
            shown[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, k in self.added.items():
            shown[k] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.token_size = np.array([len(x) for x in shown], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_size)[:-1]])
        self.pattern, self.settled = regex.compile(PATTERN), regex.compile(SETTLED)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_bytes, self.known_ids = 0, 0
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self._remember(list(self.added), np.array(list(self.added.values()), np.int64), np.ones(len(self.added), np.int64))

    def _remember(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Keeps the ids of pieces, given one after the other with how many each has; room is doubled when it is short."""
        n, at = len(self.known), self.known_ids
        while n + len(pieces) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[n : n + len(pieces)] = at + np.cumsum(size) - size
        self.size[n : n + len(pieces)] = size
        self.flat[at : at + len(ids)] = ids
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.known_ids = at + len(ids)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merges rows of symbols (-1 beyond a row's end; the width is a power of two); -1 where none is left."""
        n, width = ids.shape
        if width == 1:
            return ids
        ids = ids.copy()
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        place = np.arange(width)
        ranks = np.full((n, width), NONE)
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = np.where(ranks < NONE, ranks * width + place, NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        flat = tree.reshape(-1)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            node, base = at + width, rows * (2 * width)
            flat[base + node] = value
            while width > 1:
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
                if node[0] == 1:
                    break

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = after[rows, at]
            b = np.where(nxt < width, ids[rows, np.minimum(nxt, width - 1)], -1)
            r = self._rank(ids[rows, at], b)
            return np.where(r < NONE, r * width + at, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % width, root // width
            gone = after[rows, at]
            ids[rows, at] = self.made[rank]
            ids[rows, gone] = -1
            nxt = after[rows, gone]
            after[rows, at] = nxt
            inner = nxt < width
            before[rows[inner], nxt[inner]] = at[inner]
            put(rows, gone, NONE)
            put(rows, at, pair(rows, at))
            prev = before[rows, at]
            has = prev >= 0
            if has.any():
                put(rows[has], prev[has], pair(rows[has], prev[has]))
            rows = rows[tree[rows, 1] < NONE]
        return ids

    def merge_one(self, data: bytes) -> list[int]:
        """Merges one piece of any length with a tree of Python numbers."""
        ids = [int(self.byte_ids[b]) for b in data]
        n = len(ids)
        width = 1 << max(0, n - 1).bit_length()
        none, pair, made = int(NONE), self.pair, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def key(at: int) -> int:
            nxt = after[at]
            rank = pair.get(ids[at] << 32 | ids[nxt]) if nxt < n else None
            return none if rank is None else rank * width + at

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        for at in range(n - 1):
            tree[width + at] = key(at)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone] = int(made[rank]), -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return [t for t in ids if t >= 0]

    def _learn(self, pieces: Iterable[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            by_width.setdefault(0 if len(data) > SHORT else 1 << (len(data) - 1).bit_length(), []).append((p, data))
        for width, group in by_width.items():
            self.known_bytes += sum(len(d) for _, d in group)
            if not width:
                for p, d in group:
                    ids = np.array(self.merge_one(d), np.int64)
                    self._remember([p], ids, np.array([len(ids)]))
                continue
            step = TREE_CELLS // width
            for i in range(0, len(group), step):
                part = group[i : i + step]
                size = np.array([len(d) for _, d in part])
                rows = np.full((len(part), width), -1, np.int64)
                rows[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(d for _, d in part), np.uint8)]
                done = self.merge_rows(rows)
                left = done >= 0
                self._remember([p for p, _ in part], done[left], left.sum(axis=1))

    def _split(self, text: str) -> list[str]:
        found: list[str] = []
        for k, segment in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                found.append(segment)
            elif self.settled.fullmatch(segment):
                found += self.pattern.findall(segment)
            else:
                found += [segment[a:b] for _, (a, b) in _library_splitter().pre_tokenize_str(segment)]
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        if len(self.known) > CACHE_PIECES or self.known_bytes > CACHE_BYTES:
            self._forget()
        split = [self._split(t) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys() if split else set()
        self._learn(sorted(new))
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        size = self.size[at].astype(np.int64)
        ids = self.flat[_gather(self.begin[at].astype(np.int64), size)].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(s) for s in split], dtype=np.int64)] if split else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.token_bytes[_gather(self.token_at[ids], self.token_size[ids])].tobytes()


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[k] .. begin[k] + size[k] - 1 of all k, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = begin - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(total)


@functools.lru_cache(maxsize=1)
def _library_splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row.  The vocabulary's path must be readable on every machine."""
    path = path or default_path()

    def run(texts: list, other: list) -> pa.RecordBatch:
        ids, sizes = vocabulary(path).encode(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([other[0], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_texts(ordered_documents(docs), run, "doc_id long, ids array<int>", most=SLICE)


def _per_row(encoded: DataFrame, path: str, names: list[str], schema: str, of) -> DataFrame:
    importable(encoded.sparkSession)

    def batches(it):
        for batch in it:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(np.diff(column.offsets.to_numpy())))])
            for i in range(0, batch.num_rows, 500):
                j = min(i + 500, batch.num_rows)
                rows = [of(vocabulary(path), flat[ends[k] : ends[k + 1]]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", *names])

    return encoded.select("doc_id", "ids").mapInArrow(batches, schema)


def _text(vocab: ByteBpe, ids: np.ndarray) -> tuple[str]:
    return (vocab.decode(ids).decode("utf-8", "replace"),)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are no UTF-8 become U+FFFD."""
    return _per_row(encoded, path or default_path(), ["text"], "doc_id long, text string", _text)


def _digest(vocab: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
    text = _text(vocab, ids)[0]
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
DIGESTS_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids."""
    return _per_row(encoded, path or default_path(), DIGESTS, DIGESTS_SCHEMA, _digest)


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``digests(encode(docs))`` in one pass: a task has one Python worker, and ids never go back to the JVM."""
    path = path or default_path()

    def run(texts: list, other: list) -> pa.RecordBatch:
        vocab = vocabulary(path)
        ids, sizes = vocab.encode(texts)
        rows = [_digest(vocab, part) for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
        return pa.RecordBatch.from_arrays([other[0], *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", *DIGESTS])

    return map_texts(ordered_documents(docs), run, DIGESTS_SCHEMA, most=SLICE)
