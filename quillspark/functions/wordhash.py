"""Hashes of words and word sequences of many texts at once, with numpy.

Nothing here depends on Python's salted hash(), so every executor computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE, _ROLL = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Bytes of words: ASCII letters and digits and all characters beyond ASCII (texts must have no others than letters there).
UNICODE_WORDS = np.zeros(256, bool)
UNICODE_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of words as functions.text.words has them, in lower-case text.
ASCII_WORDS = np.zeros(256, bool)
ASCII_WORDS[[39, *range(48, 58), *range(97, 123)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE, _WORDS = _Powers(_BASE), _Powers(_ROLL)


class WordHashes:
    """hashes: of all words of the texts; doc: index of each word's text; first: index of each text's first word,
    with one more entry for the end. texts are in lower case; `inside` says which bytes make words, all others part them."""

    def __init__(self, texts: list[str], inside: np.ndarray = UNICODE_WORDS):
        raw = "\n".join(texts).encode("utf-8", "surrogatepass") if texts else b""
        lengths = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        self.buffer = np.frombuffer(raw, np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        within = inside[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], within, [False]]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _BYTE.get(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum((self.buffer.astype(U) + U(1)) * up[: len(raw)])])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, none across texts, and the index of the first word of each."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        up, down = _WORDS.get(len(self.hashes) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.hashes * up[:-1])])
        where = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix((sums[where + k] - sums[where]) * down[where]), where


def chunks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size characters; a longer text is a range of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
