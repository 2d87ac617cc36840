"""Words of Arrow text batches as numpy arrays: positions and 64-bit names, without a loop over words.

A word is a longest run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D`` of the UTF-8 text, which is
the same as ``[^\\x20\\x09-\\x0D]+`` on code points, as those bytes occur in no longer sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of the rolling sums; any odd numbers would do, these are from splitmix64.
_STEP = 0x9E3779B97F4A7C15
_WINDOW_STEP = 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self._up, self._down = self._row(base, 1024), self._row(self._inverse, 1024)

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            self._up, self._down = self._row(self._base, size), self._row(self._inverse, size)
        return self._up[:n], self._down[:n]


_BYTES, _WORDS, _WORDS2 = _Powers(_STEP), _Powers(_WINDOW_STEP), _Powers(0xD6E8FEB86659FD93)


def span_sums(values: np.ndarray, powers: _Powers) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than the values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers.get(len(values) + 1)[0][:-1], out=out[1:])
    return out


def span_names(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Names of the spans [start, end): equal sequences have equal names wherever they stand."""
    down = powers.get(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


@dataclass
class Words:
    """The words of a few documents, numbered through; word i of document d is first[d] + i."""

    raw: np.ndarray  #: bytes of the texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte behind each word
    name: np.ndarray  #: 64-bit name of each word
    first: np.ndarray  #: index of the first word of each document, with one more entry at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def names_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = span_sums(self.name, _WORDS)
        return span_names(self._sums, start, end, _WORDS)

    def second_names_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_sums2"):
            self._sums2 = span_sums(mix(self.name + np.uint64(_STEP)), _WORDS2)
        return span_names(self._sums2, start, end, _WORDS2)

    def text_of(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The document's words joined by one space; keep: a mask of its words."""
        a, b = self.first[doc], self.first[doc + 1]
        if a == b:
            return b""
        low = self.start[a]
        words = self.raw[low: self.end[b - 1]].tobytes().split()
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep) if k])


def find_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of a string array; null has none. lower: A-Z count as a-z."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    edge = np.frombuffer(at, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[edge[0]: edge[-1]] if data is not None else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    solid = ~IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)  # a document begins or ends here
    cut[edge] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    sums = span_sums(_BYTE_VALUE[LOWER[raw] if lower else raw], _BYTES)
    return Words(raw, start, end, span_names(sums, start, end, _BYTES), np.searchsorted(start, edge))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of text bytes (one row at least), for bounded arrays."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + n + 1]
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most_bytes, side="right")) - 1)
        yield batch.slice(row, min(stop, n) - row)
        row = min(stop, n)
