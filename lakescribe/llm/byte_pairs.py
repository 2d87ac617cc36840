"""Byte-pair vocabularies: words of a batch encoded along a trie, each shared prefix once.

The distinct words form a trie. Every node, that is every prefix, has exactly one last token; the node in
front of that token has its own, and so on back to the root. Depth-first, a node tries the tokens that
end there: the one that goes with the last token of the node in front of it is its state. So the states
of a prefix serve all words that begin with it, and a word's ids are read off by walking back.

The trie is held as its sorted words: sorted order is depth-first order, and what a word shares with
the one before it is the path that both have from the root. Only the current path has states in memory.

Whether two tokens go together needs no merging: it follows the parts that touched at the seam while
both tokens grew. If two of them would have merged before either grew, the tokens do not stay apart.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

#: Entries that a worker keeps of words and of pair tests; longest word kept; words of one step of a long text.
CACHE, KEPT_WORD, STEP = 400_000, 64, 1 << 16
#: The contractions and the white space of the word pattern.
CONTRACTIONS = "s|t|re|ve|m|ll|d"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Letters and numbers that Unicode 16.0 added to 15.1, the version of the interpreter's tables.
ADDED_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E "
    "11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
ADDED_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def _of_category(initial: str, added: str, limit: int) -> str:
    """The code points of a general category below a limit as ranges of a character class."""
    edges: list[list[int]] = []
    for code in range(limit):
        if unicodedata.category(chr(code))[0] != initial:
            continue
        if edges and edges[-1][1] == code - 1:
            edges[-1][1] = code
        else:
            edges.append([code, code])
    for part in added.split():
        first, _, last = part.partition("-")
        if int(first, 16) < limit:
            edges.append([int(first, 16), int(last or first, 16)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in edges)


def word_pattern(limit: int = 0x110000) -> re.Pattern[str]:
    """Contractions, then runs of letters, of numbers and of other characters with a space in front, then white space.

    For texts of code points below the limit only: beyond U+FFFF every range costs a comparison wherever a run ends.
    """
    letters, numbers = _of_category("L", ADDED_LETTERS, limit), _of_category("N", ADDED_NUMBERS, limit)
    return re.compile(
        f"'(?:{CONTRACTIONS})| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class BytePairs:
    """A byte-level vocabulary with ranked merges, read from a tokenizer file of the library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self._check(made)
        self.id: dict[str, int] = made["model"]["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in made["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        self._rank = {pair: rank for rank, pair in enumerate(pairs)}
        self._letters = dict(enumerate(byte_letters()))
        self._check_ranks(pairs)
        byte_of = {letter: byte for byte, letter in self._letters.items()}
        self._to_bytes = {i: bytes(byte_of[c] for c in t) for t, i in self.id.items()}
        self._to_bytes |= {i: t.encode() for t, i in self.added.items()}
        self._parts: dict[str, tuple[str, str]] = {}  # the two parts that merge last in a token
        self._lengths: dict[str, list] = {}  # the last two letters of a token -> lengths, longest first
        for a, b in pairs:
            if self.merge(a + b) == [a + b]:
                self._parts[a + b] = (a, b)
                self._lengths.setdefault((a + b)[-2:], []).append(len(a + b))
        for ending, lengths in self._lengths.items():
            # at place n those that fit into n letters; the last entry has all
            ordered = sorted(set(lengths), reverse=True)
            self._lengths[ending] = [tuple(size for size in ordered if size <= n) for n in range(ordered[0] + 1)]
        self._goes: dict[tuple[str, str], bool] = {}
        self.decimal = {i: str(i) for i in self.id.values()}
        self._pattern, self._short_pattern = word_pattern(), word_pattern(0x10000)
        self._beyond = re.compile("[\U00010000-\U0010ffff]")
        self._split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @staticmethod
    def _check(made: dict) -> None:
        """Stops at settings that this encoding does not know."""
        model, front = made["model"], made["pre_tokenizer"]
        plain = not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        words = front and front["type"] == "ByteLevel" and front["use_regex"] and not front["add_prefix_space"]
        exact = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"])
        if made["normalizer"] or model["type"] != "BPE" or not (plain and words and exact):
            raise ValueError("only byte-level BPE with plain merges, the standard words and exact added tokens is supported")

    def _check_ranks(self, pairs: list[tuple[str, str]]) -> None:
        """Stops unless merges make different tokens, each of parts made earlier; the traversal rests on that."""
        made = set(self._letters.values())
        if not made <= self.id.keys():
            raise ValueError("every byte must be a token")
        for a, b in pairs:
            if a not in made or b not in made or a + b in made or a + b not in self.id:
                raise ValueError(f"the merge of {a!r} and {b!r} is out of order")
            made.add(a + b)

    def merge(self, text: str) -> list[str]:
        """Merging by definition: the neighbours of the lowest rank first, leftmost of equal ones."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, tuple[str, str]]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                rank = self._rank.get(pair := (parts[i], parts[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, pair))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if parts[i] != pair[0] or (j := after[i]) >= len(parts) or parts[j] != pair[1]:
                continue
            parts[i], parts[j], after[i] = pair[0] + pair[1], None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether the tokens stay side by side when their strings are merged together."""
        rank, parts = self._rank, self._parts
        never = len(rank)
        # ranks at which the parts at the seam grew into the next larger ones
        left_grew = right_grew = never
        while True:
            joined = rank.get((left, right), never)
            # of equal ranks the leftmost pair merges first: (x, left) before (left, right), that before (right, y)
            if joined < left_grew and joined <= right_grew and joined < never:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            left_made, right_made = rank[a] if a else -1, rank[b] if b else -1
            # the later merge is undone first; of the same token on both sides the left one was made first
            if left_made > right_made:
                left_grew, left = left_made, a[1]
            else:
                right_grew, right = right_made, b[0]

    def _states(self, word: str, at: int, last: list[str]) -> None:
        """Adds the states of the prefixes of word longer than `at`; last[n] is the last token of its first n letters."""
        goes, parts, lengths, add = self._goes, self._parts, self._lengths, last.append
        for end in range(at + 1, len(word) + 1):
            fitting = lengths.get(word[end - 2: end])
            if fitting is None:
                add(word[end - 1])
                continue
            for size in fitting[end] if end < len(fitting) else fitting[-1]:
                if (token := word[end - size: end]) not in parts:
                    continue
                if size == end:
                    break
                pair = last[end - size], token
                if pair in goes:
                    fits = goes[pair]
                else:
                    fits = goes[pair] = self._stay_apart(*pair)
                if fits:
                    break
            else:
                token = word[end - 1]
            add(token)
        if len(goes) > CACHE:
            goes.clear()

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words written in byte letters, by one traversal of their trie."""
        path, last = "", [""]
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:]
            self._states(word, shared, last)
            path, at, ids = word, len(word), []
            while at:
                ids.append(self.id[last[at]])
                at -= len(last[at])
            ids.reverse()
            yield word, ids

    def letters(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self._letters)

    def split(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """The words of a text in steps of bounded length; (added tokens, True) stand by themselves."""
        at = 0
        for match in self._split_added.finditer(text) if self._split_added else ():
            yield from self._split_plain(text[at: match.start()])
            yield [match[0]], True
            at = match.end()
        yield from self._split_plain(text[at:] if at else text)

    def _pattern_of(self, text: str) -> re.Pattern[str]:
        return self._pattern if self._beyond.search(text) else self._short_pattern

    def _split_plain(self, text: str) -> Iterator[tuple[list[str], bool]]:
        if len(text) <= STEP:
            if text:
                yield self._pattern_of(text).findall(text), False
            return
        words = (m[0] for m in self._pattern_of(text).finditer(text))
        while step := list(islice(words, STEP)):
            yield step, False

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join([self._to_bytes.get(i, b"") for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return self.bytes_of(ids).decode("utf-8", "replace")


class Encodings(dict):
    """word -> ids as decimal text, filled a trie at a time, bounded; apart, what decodes to another text."""

    def __init__(self, model: BytePairs) -> None:
        super().__init__()
        self.model = model
        self._long: list[str] = []
        #: word -> the text decoded from its ids, of words that it differs from
        self.decoded: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not known yet, along one trie, and decodes their ids."""
        letters, decimal, decode = self.model.letters, self.model.decimal.__getitem__, self.model.decode
        new = {letters(w): w for w in words if w not in self}
        for spelled, ids in self.model.encode_words(new):
            word = new[spelled]
            self[word] = ",".join(map(decimal, ids))
            # a word holds whole characters, so its bytes are decoded by themselves
            if (decoded := decode(ids)) != word:
                self.decoded[word] = decoded
            if len(word) > KEPT_WORD:
                self._long.append(word)

    def of(self, words: list[str], added: bool) -> tuple[str, str]:
        """The ids of words as decimal text and the text decoded from them; added: they are added tokens."""
        if added:
            ids = [self.model.added[w] for w in words]
            return ",".join(map(str, ids)), self.model.decode(ids)
        differs = self.decoded
        return ",".join(map(self.__getitem__, words)), "".join([differs.get(w, w) for w in words] if differs else words)

    def trim(self) -> None:
        """Forgets long words, and everything once there is too much of it."""
        for word in self._long:
            self.pop(word, None)
            self.decoded.pop(word, None)
        self._long.clear()
        if len(self) > CACHE:
            self.clear()
            self.decoded.clear()
