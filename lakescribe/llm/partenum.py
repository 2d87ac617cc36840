"""PartEnum signatures of sets: similar sets of one size band share one of them, without exception.

With similarity of `percent` / 100, sets of a and b >= a elements differ in k(a) = a * (100 - percent)
/ percent elements at most. A band of sizes deals the domain into n partitions. Among any k(a) + 1 of
them one is alike in both sets, so the contents of the first k(a) + 1 + spare(a) partitions, each
named by a digest, are the signatures of a set. Bands overlap: each pair has a band in common.

An empty partition is no signature, as unrelated sets share it. That loses no pair as long as no more
than spare(a) of the first partitions are empty. Where more are (and for very small sets), a set also
offers its first elements in a global order, one signature each: two similar sets share one of the
first x - ceil(x * percent / 100) + 1 elements. If one set of a pair has too many empty partitions,
the other one's count reaches the limit that its own size allows, so both offer their elements.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import mix

#: Sets up to this size offer elements only.
SMALL = 16
#: Largest over smallest size of a band.
BAND = 2.5
#: Stands for a band where single elements are offered.
ELEMENTS = -1


class Band:
    """Sizes low..high with the number of partitions that a set of each size offers."""

    def __init__(self, number: int, low: int, high: int, percent: int) -> None:
        self.number, self.low, self.high = number, low, high
        size = np.arange(low, high + 1)
        differ = size * (100 - percent) // percent
        self.parts = int(differ[-1] * 1.08) + 6
        empty = np.exp(-size / self.parts)
        spare = np.ceil(((differ + 1) * empty + 4 * np.sqrt((differ + 1) * empty) + 2) / (1 - empty)).astype(np.int64)
        self._offered = np.minimum(np.maximum.accumulate(differ + 1 + spare), self.parts)
        self._spare = self._offered - differ - 1
        self._percent = percent

    def offered(self, size: int) -> int:
        return int(self._offered[size - self.low])

    def most_empty(self, size: int) -> int:
        """Empty partitions with which no similar set of this size or smaller loses the pair."""
        least = max(self.low, -(-size * self._percent // 100))
        return int(self._spare[least - self.low: size - self.low + 1].min())


@lru_cache(maxsize=None)
def _band(number: int, percent: int) -> Band:
    if not number:
        low = SMALL + 1
    else:
        low = -(-(_band(number - 1, percent).high + 1) * percent // 100)
    return Band(number, low, max(int(low * BAND), low + 8), percent)


@lru_cache(maxsize=1 << 16)
def bands_of(size: int, percent: int) -> tuple[Band, ...]:
    found, number = [], 0
    while (band := _band(number, percent)).low <= size:
        if size <= band.high:
            found.append(band)
        number += 1
    return tuple(found)


def offers(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, signatures it may leave out, signatures) of a set, given as its distinct 64-bit elements in rising order.

    Single elements are those of band ELEMENTS, where none may be left out.
    """
    size = len(elements)
    if not size:
        return []
    out, sparse = [], size <= SMALL * 100 // percent
    for band in bands_of(size, percent):
        part = (mix(elements + np.uint64(band.number * 2 + 1)) >> np.uint64(32)) * np.uint64(band.parts) >> np.uint64(32)
        offered = band.offered(size)
        inside = part < offered
        part = part[inside]
        order = np.argsort(part, kind="stable")
        part = part[order]
        start = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 40)))
        empty, most_empty = offered - len(start), band.most_empty(size)
        if len(start):
            sums = np.add.reduceat(mix(elements[inside][order] ^ np.uint64(0xA0761D6478BD642F)), start)
            names = mix(sums + part[start] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band.number))
            out.append((band.number, max(0, most_empty - empty), names))
        sparse |= empty > most_empty
    if sparse:
        first = size - -(-size * percent // 100) + 1
        out.append((ELEMENTS, 0, mix(elements[:first] ^ np.uint64(0x8EBC6AF09C88C6E3))))
    return out


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, given as its distinct 64-bit elements in rising order."""
    return np.concatenate([np.zeros(0, np.uint64), *[names for _, _, names in offers(elements, percent)]])
