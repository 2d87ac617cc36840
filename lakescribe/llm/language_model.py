"""Character language models with interpolated Kneser-Ney smoothing, kept in sorted hash arrays.

Letters count as lower case, everything else as one space. A gram of up to N characters has a 64-bit
name. Per language and order, a model is a rising array of names with log probabilities beside it,
and one of contexts with their back-off weights. For scoring, the arrays of all languages are merged:
one search finds a gram for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = 32


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, _SPACE, dtype=np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0]


@dataclass
class Chars:
    """The normalised characters of a few texts, each led by order - 1 spaces, with their text's index."""

    code: np.ndarray
    doc: np.ndarray
    scored: np.ndarray  #: places whose character is predicted; the spaces in front are not
    letters: np.ndarray  #: letters of each text


def normalise(texts: list[str], order: int) -> Chars:
    pad = "\n" * (order - 1)
    size = np.array([len(t) + order - 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le") if texts else b"", dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    code = letters_table()[raw]
    blank = code == _SPACE
    front = np.zeros(len(raw), dtype=bool)
    for k in range(order - 1):
        front[begin + k] = True
    after_blank = np.zeros(len(raw), dtype=bool)
    after_blank[1:] = blank[:-1]
    keep = front | ~(blank & after_blank)
    doc = np.repeat(np.arange(len(texts)), size)
    letters = np.bincount(doc[~blank], minlength=len(texts))
    return Chars(code[keep].astype(np.uint64), doc[keep], ~front[keep], letters)


def gram_names(code: np.ndarray, order: int) -> list[np.ndarray]:
    """names[n - 1][i]: the name of the n characters that end at i (shorter at the very start)."""
    out, total, factor = [], np.zeros(len(code), dtype=np.uint64), 1
    spread = mix(code + np.uint64(1))
    for n in range(1, order + 1):
        shifted = np.zeros(len(code), dtype=np.uint64)
        shifted[n - 1:] = spread[: len(code) - n + 1]
        total = total + shifted * np.uint64(factor)
        factor = factor * _BASE & (2**64 - 1)
        out.append(mix(total + np.uint64(n)))
    return out


def count_grams(texts: list[str], order: int) -> pa.Table:
    """Counts of the longest grams with the names of their endings and contexts of each order.

    end_n: the last n characters; head_n: the n - 1 characters in front of the last one.
    """
    chars = normalise(texts, order)
    names = gram_names(chars.code, order)
    at = np.flatnonzero(chars.scored)
    _, pick, count = np.unique(names[-1][at], return_index=True, return_counts=True)
    at = at[pick]
    columns = {f"end_{n}": names[n - 1][at].view(np.int64) for n in range(1, order + 1)}
    columns |= {f"head_{n}": names[n - 2][at - 1].view(np.int64) for n in range(2, order + 1)}
    return pa.table(columns | {"n": count})


@dataclass
class Level:
    """One order for one language: grams with log probabilities, contexts with log back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray


def train(grams: pa.Table, order: int) -> list[Level]:
    """The model of one language from the counts of its longest grams, lowest order first."""
    column = {c: grams.column(c).to_numpy() for c in grams.column_names}
    count = column["n"].astype(np.float64)
    levels: list[Level] = []
    tables = {order: (column, count)}
    for n in range(order - 1, 0, -1):  # lower orders count the different characters in front
        upper, _ = tables[n + 1]
        own, pick, kinds = np.unique(upper[f"end_{n}"], return_index=True, return_counts=True)
        tables[n] = ({c: v[pick] for c, v in upper.items()}, kinds.astype(np.float64))
    for n in range(1, order + 1):
        table, count = tables[n]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        names = table[f"end_{n}"].view(np.uint64)
        if n == 1:
            total, kinds = count.sum(), len(count)
            back = discount * kinds / total
            p = (count - discount) / total + back / (kinds + 1)
            contexts, log_back = np.zeros(1, np.uint64), np.log([back / (kinds + 1)])  # an unknown character
        else:
            heads, which = np.unique(table[f"head_{n}"].view(np.uint64), return_inverse=True)
            total, kinds = np.bincount(which, weights=count), np.bincount(which)
            back = discount * kinds / total
            below = levels[-1]
            at = np.searchsorted(below.grams, table[f"end_{n - 1}"].view(np.uint64))
            p = (count - discount) / total[which] + back[which] * np.exp(below.log_p[at])
            contexts, log_back = heads, np.log(back)
        sort = np.argsort(names)
        levels.append(Level(names[sort], np.log(p)[sort], contexts, log_back))
    return levels


class Scorer:
    """Models of all languages side by side: rising names, one column of numbers per language."""

    def __init__(self, models: dict[str, list[Level]], order: int) -> None:
        self.languages, self.order = sorted(models), order
        own = [models[x] for x in self.languages]
        self._unknown = np.array([m[0].log_back[0] for m in own], dtype=np.float32)
        self._grams, self._p, self._contexts, self._back = [], [], [], []
        for n in range(order):
            contexts = np.unique(np.concatenate([m[n].contexts for m in own]))
            back = np.zeros((len(contexts), len(own)), dtype=np.float32)
            for k, m in enumerate(own):
                back[np.searchsorted(contexts, m[n].contexts), k] = m[n].log_back
            self._contexts.append(contexts), self._back.append(back)
            grams = np.unique(np.concatenate([m[n].grams for m in own]))
            self._grams.append(grams)
            p = np.full((len(grams), len(own)), np.nan, dtype=np.float32)
            for k, m in enumerate(own):
                p[np.searchsorted(grams, m[n].grams), k] = m[n].log_p
            self._p.append(p)

    def fill(self, grams: pa.Table) -> None:
        """Where a language lacks a gram that another has, its backed-off probability, once for all."""
        column = {c: grams.column(c).to_numpy().view(np.uint64) for c in grams.column_names if c != "n"}
        for n in range(self.order):
            names, pick = np.unique(column[f"end_{n + 1}"], return_index=True)
            p = self._p[n]
            if n == 0:
                lower = np.tile(self._unknown, (len(names), 1))
            else:
                lower = self._backed_off(n, column[f"head_{n + 1}"][pick])
                lower += self._p[n - 1][np.searchsorted(self._grams[n - 1], column[f"end_{n}"][pick])]
            at = np.searchsorted(self._grams[n], names)
            p[at] = np.where(np.isnan(p[at]), lower, p[at])

    def _backed_off(self, n: int, heads: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._contexts[n], heads), len(self._contexts[n]) - 1)
        return np.where((self._contexts[n][at] == heads)[:, None], self._back[n][at], np.float32(0))

    def _log_p(self, names: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        own = names[n][at]
        found = np.minimum(np.searchsorted(self._grams[n], own), len(self._grams[n]) - 1)
        out = self._p[n][found]
        missing = np.flatnonzero(self._grams[n][found] != own)
        if len(missing):
            if n == 0:
                out[missing] = self._unknown
            else:
                where = at[missing]
                out[missing] = self._backed_off(n, names[n - 1][where - 1]) + self._log_p(names, where, n - 1)
        return out

    def mean_log_p(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the mean log probability of a character; letters per text."""
        chars = normalise(texts, self.order)
        names = gram_names(chars.code, self.order)
        at = np.flatnonzero(chars.scored)
        log_p = self._log_p(names, at, self.order - 1)
        doc = chars.doc[at]
        n = np.bincount(doc, minlength=len(texts))
        sums = np.stack([np.bincount(doc, weights=log_p[:, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(n, 1)[:, None], chars.letters


def slices(texts: list[str], most_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of a bounded number of characters, one text at least."""
    own: list[str] = []
    size = 0
    for text in texts:
        if own and size + len(text) > most_chars:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own
