"""Vectorised text kernel shared by the corpus operators.

Everything here works on one block of documents as a single byte buffer:
words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` (safe on
UTF-8, where continuation bytes never fall in that range), every word and
every window of ``k`` words gets a 64-bit fingerprint by prefix sums modulo
2**64, so the cost per document does not depend on ``k``.  A document is never
cut; a block simply holds as many whole documents as fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
CHUNK = 1 << 19  # bytes or words hashed at a time

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if fold:
        table[65:91] = table[97:123]
    return table


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 64)
            up, down = np.full(n, self.base, _U), np.full(n, self.inverse, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_OF_BYTES, _OF_WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Block:
    """Words of some whole documents.

    ``buf``: bytes, documents divided by one newline; ``at``: first byte of each document and, last,
    one past the end; ``start``/``end``: byte span of each word; ``first``: number
    of the first word of each document and, last, the number of words.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=self.at[1:])
        inside = np.zeros(len(self.buf) + 1, np.int8)
        np.logical_not(_SPACE[self.buf], out=inside[1:].view(bool))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.n_words = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.n_words)

    def span_hash(self, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
        """Fingerprint of each byte span, spans in order and apart; ``fold``: A-Z count as a-z."""
        out = np.empty(len(start), _U)
        at = 0
        while at < len(start):
            base = start[at]
            stop = max(int(np.searchsorted(end, base + CHUNK, "right")), at + 1)
            piece = self.buf[base : end[stop - 1]]
            up, down = _OF_BYTES.to(len(piece) + 1)
            total = np.zeros(len(piece) + 1, _U)
            np.cumsum(_CODES[fold][piece] * up[: len(piece)], out=total[1:])
            s, e = start[at:stop] - base, end[at:stop] - base
            out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
            at = stop
        return out

    def word_hash(self, fold: bool = False) -> np.ndarray:
        return self.span_hash(self.start, self.end, fold)

    def windows(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first word and document of each run of ``k`` words inside one document."""
        grams = window_hash(words, k)
        counts = np.maximum(self.n_words - k + 1, 0)
        doc = np.repeat(np.arange(len(self.texts)), counts)
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[doc]
        return grams[begin] if len(begin) else np.zeros(0, _U), begin, doc


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each run of ``k`` consecutive items, document ends ignored."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    for at in range(0, n, CHUNK):
        piece = words[at : at + CHUNK + k - 1]
        m = len(piece) - k + 1
        up, down = _OF_WORDS.to(len(piece) + 1)
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum(piece * up[: len(piece)], out=total[1:])
        out[at : at + m] = mix((total[k:] - total[:-k]) * down[:m] + _U(k))
    return out


def sequence_hash(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the items ``begin`` to ``end`` (exclusive); equal to ``window_hash`` of that length."""
    up, down = _OF_WORDS.to(len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES, change: Callable[[bytes], bytes] | None = None) -> Iterator[tuple[slice, Block]]:
    """The batch in runs of whole documents of about ``limit`` bytes, each text changed first if asked."""
    texts = as_bytes(batch.column(text))
    texts = [change(x) for x in texts] if change else texts
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield slice(begin, i), Block(texts[begin:i])
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(texts):
        yield slice(begin, len(texts)), Block(texts[begin:])
