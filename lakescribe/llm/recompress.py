"""Recompression of word sequences: rounds that name runs and pairs, the same way in every document.

One round decides by the names of two neighbours only, so what becomes of a symbol depends on a
bounded stretch of words around it, its context. A symbol whose context lies inside a window of
words is found in every other copy of that window at the same place. Names are 64-bit digests of
what they stand for, so tasks agree on them without asking each other.
"""

from __future__ import annotations

import numpy as np

from .words import Words, mix

_FAR = 1 << 40  #: a context that reaches the edge of its document fits into no window


def _level(name, doc, low, high, length):
    return {"name": name, "doc": doc, "low": low, "high": high, "length": length}


def _words_as_runs(words: Words, doc: np.ndarray) -> dict:
    """Runs of one word become one symbol. The words on both sides belong to the context."""
    n = len(words.name)
    same = np.zeros(n, dtype=bool)
    same[1:] = (words.name[1:] == words.name[:-1]) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(~same)
    end = np.append(head[1:], n)
    length = end - head
    name = np.where(length > 1, mix(words.name[head] + length.astype(np.uint64)), words.name[head])
    own = doc[head]
    low, high = head - 1, end + 1
    low[head == words.first[own]] = -_FAR
    high[end == words.first[own + 1]] = _FAR
    return _level(name, own, low, high, length)


def _pair(level: dict, number: int) -> dict:
    """Neighbours (a, b) with the bits 0 and 1 become one symbol; bits come from the names."""
    name, doc, low, high = level["name"], level["doc"], level["low"], level["high"]
    n = len(name)
    bit = (mix(name + np.uint64(number * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(63)).astype(bool)
    together = doc[1:] == doc[:-1]
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = ~bit[:-1] & bit[1:] & together
    # a symbol with bit 0 looks at its right neighbour, one with bit 1 at its left one
    right_low, right_high = np.full(n, -_FAR), np.full(n, _FAR)
    right_low[:-1], right_high[:-1] = np.where(together, low[1:], -_FAR), np.where(together, high[1:], _FAR)
    left_low, left_high = np.full(n, -_FAR), np.full(n, _FAR)
    left_low[1:], left_high[1:] = np.where(together, low[:-1], -_FAR), np.where(together, high[:-1], _FAR)
    low = np.minimum(low, np.where(bit, left_low, right_low))
    high = np.maximum(high, np.where(bit, left_high, right_high))
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    length = level["length"].copy()
    at = np.flatnonzero(pair)
    name = name.copy()
    name[at] = mix(name[at] * np.uint64(0xD1B54A32D192ED03) + name[at + 1] + np.uint64(number))
    length[at] += length[at + 1]
    keep = ~second
    return _level(name[keep], doc[keep], low[keep], high[keep], length[keep])


def elect(words: Words, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `size` words of one document: (first word, context's first word, signature).

    The signature is the symbol of the highest round whose context the window holds, the one of
    the smallest name if there are several, so that neighbouring windows mostly agree; it is named
    by the words of its context. A window that holds none (it lies inside one run, or
    touches the edges of a short document) is named by all its words. Either way it depends on the
    window's words alone, so equal windows have equal signatures.
    """
    doc = np.repeat(np.arange(len(words.first) - 1), words.count)
    n = len(words.name)
    first = np.flatnonzero(np.arange(n) + size <= words.first[doc + 1]) if n else np.zeros(0, np.int64)
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    best_low, best_high = np.full(n + 1, -1), np.full(n + 1, -1)
    level = _words_as_runs(words, doc)
    for number in range(1, rounds + 1):
        level = _pair(level, number)
        low, high = level["low"], level["high"]
        fits = (high - low <= size) & (level["length"] > 1) & (low >= 0)
        low, high = low[fits], high[fits]
        if not len(low):
            continue
        # windows starting in [high - size, low] hold the context; the smallest name is written last, the leftmost of its places wins
        order = np.argsort(level["name"][fits], kind="stable")[::-1]
        begin = np.maximum(high - size, 0)
        spans = low - begin + 1
        begin, spans, low, high = begin[order], spans[order], low[order], high[order]
        where = np.repeat(begin - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        best_low[where], best_high[where] = np.repeat(low, spans), np.repeat(high, spans)
    low, high = best_low[first], best_high[first]
    none = low < 0
    low, high = np.where(none, first, low), np.where(none, first + size, high)
    return first, low, words.names_of(low, high)
