"""Arrow text batches as numpy arrays: words, lines, hashes and windows without a Python loop per word.

Text is handled as UTF-8 bytes. Every separator used here is ASCII, so word limits in
bytes are word limits in characters. Hashes are 64-bit and computed over the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; one longer text makes a piece of its own
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1


def separators(keep: Callable[[int], bool]) -> np.ndarray:
    """Table over byte values: True where a byte is no part of a word."""
    return np.array([b < 128 and not keep(b) for b in range(256)])


#: words of ``[^\x20\x09-\x0D]+``
BLANKS = separators(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
PUNCTUATION = separators(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
NEWLINE = separators(lambda b: b != 0x0A)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, up to ``n``."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_word(word: str, lower: bool = False) -> int:
    """The hash that ``Spans.hashes`` gives to this word."""
    data = word.encode()
    if lower:
        data = bytes(_LOWER[np.frombuffer(data, dtype=np.uint8)])
    total = sum((b + 1) * pow(_BASE, i, 1 << 64) for i, b in enumerate(data)) & _U64
    return int(mix(np.array([total ^ (len(data) * 0x2545F4914F6CDD1D & _U64)], dtype=np.uint64))[0])


@dataclass
class Spans:
    """Runs of non-separator bytes: start, end (exclusive) and document of each."""

    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    n_docs: int
    text: "TextBatch"

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.docs, minlength=self.n_docs).astype(np.int64)

    @cached_property
    def firsts(self) -> np.ndarray:
        """Index of each document's first run, and the number of runs at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @cached_property
    def hashes(self) -> np.ndarray:
        sums, inverse = self.text.prefix_hash
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(raw ^ ((self.ends - self.starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every window of ``size`` runs that stays in one document."""
        h, n = self.hashes, len(self.starts)
        if n < size:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        out = h[: n - size + 1].copy()
        for i in range(1, size):
            out = out * np.uint64(_BASE) + h[i : n - size + 1 + i]
        inside = self.docs[: n - size + 1] == self.docs[size - 1 :]
        return mix(out[inside]), self.docs[: n - size + 1][inside]


class TextBatch:
    """Some whole texts laid end to end, with a separator byte between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data``: bytes with one newline after each text; ``offsets``: text starts and the end."""
        self.data, self.offsets = data, offsets
        self.n_docs = len(offsets) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> "TextBatch":
        return next(cls.pieces(pa.array(texts, type=pa.string()), 1 << 62))[2] if texts else cls(np.empty(0, np.uint8), np.zeros(1, np.int64))

    @classmethod
    def pieces(cls, column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, "TextBatch"]]:
        """(first row, end row, batch) over runs of rows whose texts take about ``limit`` bytes; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        n = len(column)
        buffers = column.buffers()
        at = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            hi = min(hi, n)
            size = at[hi] - at[lo]
            data = np.full(size + hi - lo, 0x0A, dtype=np.uint8)
            shift = np.arange(hi - lo)
            keep = np.ones(len(data), dtype=bool)
            keep[at[lo + 1 : hi + 1] - at[lo] + shift] = False
            data[keep] = raw[at[lo] : at[hi]]
            yield lo, hi, cls(data, at[lo : hi + 1] - at[lo] + np.arange(hi - lo + 1))
            lo = hi
        # idle workers share an executor's memory with the running ones
        pa.default_memory_pool().release_unused()

    def take(self, rows: np.ndarray) -> "TextBatch":
        """A batch of these texts only."""
        lengths = (self.offsets[1:] - self.offsets[:-1])[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1][rows] - offsets[:-1], lengths)
        return TextBatch(self.data[index], offsets)

    def lowered(self) -> "TextBatch":
        return TextBatch(_LOWER[self.data], self.offsets)

    @cached_property
    def sizes(self) -> np.ndarray:
        """UTF-8 bytes of each text."""
        return self.offsets[1:] - self.offsets[:-1] - 1

    @cached_property
    def prefix_hash(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        power, inverse = _powers_to(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return sums, inverse

    def sum_by_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of set byte flags in each text."""
        if not self.n_docs:
            return np.zeros(0, dtype=np.int64)
        return np.add.reduceat(flags.astype(np.int64), self.offsets[:-1]) if len(flags) else np.zeros(self.n_docs, dtype=np.int64)

    def spans(self, separator: np.ndarray) -> Spans:
        """Runs of bytes outside ``separator``; the byte after each text always separates."""
        inside = ~separator[self.data]
        if self.n_docs:
            inside[self.offsets[1:] - 1] = False
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        docs = np.searchsorted(self.offsets, starts, side="right") - 1
        return Spans(starts, ends, docs, self.n_docs, self)

    @cached_property
    def character_starts(self) -> np.ndarray:
        """True at the first byte of every code point, the byte after a text included."""
        return (self.data & 0xC0) != 0x80
