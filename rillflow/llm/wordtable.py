"""Words, lines and rolling hashes of many texts at once, on bytes with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for UTF-8
is the same as the code point pattern ``[^\\x20\\x09-\\x0D]+``.  Hashes are
64-bit polynomials over a table of random byte values, finished by a bijective
mixer, so that a word's hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(2**62, 2**63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest seen is kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, U64(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 23:
            _powers[base] = known
    return known[:n]


class WordTable:
    """The words of some texts (None counts as empty).

    ``buf`` holds all texts, each followed by a newline; ``start``/``end`` are
    the words' byte bounds in it, ``doc`` their text's number, ``first`` the
    number of each text's first word (one more entry than texts), ``at`` each
    text's first byte (one more entry as well).  ``space`` marks the bytes
    between words.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, space: np.ndarray = IS_SPACE):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        self.at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(self.lengths + 1, out=self.at[1:])
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~space[self.buf]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of ``buf``."""
        if self._sums is None:
            n = len(self.buf)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * powers(_BASE, n), out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * powers(_INVERSE, len(self.buf) + 1)[start])

    def word_hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


_WINDOW = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _WINDOW[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _WINDOW[k]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a short sequence, told apart from windows by its length."""
    return mix(np.sum(words * _WINDOW[: len(words)], dtype=np.uint64, keepdims=True) + _WINDOW[-1:] * U64(len(words) + 1))


def slices(lengths: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together take about ``most`` characters; a longer text stands alone."""
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if k > at and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)
