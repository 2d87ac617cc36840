"""SentencePiece merge vocabularies: encoding by a table of each prefix's last token, and decoding.

For every prefix of a unit there is exactly one last token. A token that ends there is the one if it
goes with the last token of the prefix in front of it: merging the two strings together must give
the two tokens again. An automaton lists the tokens that end at each place, the pair test picks one,
and walking back from the end gives the ids.

The pair test needs no merging. It follows the parts that touched at the seam while both tokens were
made: if some of them would have merged with each other before either grew, the tokens do not go.

A unit is a stretch that no piece crosses: the space marks in front of a word and the word up to a
full stop or comma behind a letter, or a line break. The vocabulary is tested for that. Runs of space marks have tied scores; they are merged directly.
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import sentencepiece

SPACE = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Entries that a worker keeps of units and of pair tests.
CACHE = 400_000


class Pieces:
    """A merge vocabulary with byte fallback, read from a model file of the library."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.end_id = model.eos_id()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self._byte_of = {i: b for b, i in self.byte.items()}
        if crossing := [p for p in self.id if SPACE in p.lstrip(SPACE) or "\n" in p]:
            raise ValueError(f"pieces cross the borders of units: {crossing[:3]}")
        stops = "".join(c for c in ".," if not any(re.search(f"[{_LETTERS}][{c}]", p) for p in self.id))
        letter, other = f"[{_LETTERS}]", f"[^{SPACE}\n{_LETTERS}]"
        self._units = re.compile(f"\n|(?=[^\n]){SPACE}*{other}*(?:{letter}++[^{SPACE}\n{_LETTERS}{stops}]{other}*)*{letter}*")
        blanks = [self.score[p] for p in self.id if set(p) == {SPACE} and len(p) > 1]
        others = [s for p, s in self.score.items() if p.strip(SPACE) and len(p) > 1]
        if len(set(others)) < len(others) or blanks and others and max(blanks) > min(others):
            raise ValueError("scores of pieces must differ, and space runs come last")
        self._parts: dict[str, tuple[str, str]] = {}  # the two parts that merged last in a piece
        self._automaton = ahocorasick.Automaton()
        for piece in self.id:
            # runs of space marks are merged directly; one mark is a start
            if (piece.strip(SPACE) or piece == SPACE) and self._made(piece):
                self._automaton.add_word(piece, piece)
        self._automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._runs: dict[int, list[str]] = {}

    def _made(self, piece: str) -> bool:
        """Whether merging can make the piece; notes of which two parts."""
        steps: list[tuple[str, str]] = []
        if self.merge(piece, steps) != [piece]:
            return False
        if steps:
            self._parts[piece] = steps[-1]
        return True

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Merging by definition: the best-scored neighbours first, leftmost of equal ones."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[joined], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != joined:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _goes(self, left: str, right: str) -> bool:
        """Whether the tokens stay side by side when their strings are merged; '' is no token."""
        if not left:
            return True
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            found = self._pairs[left, right] = self._stay(left, right)
        return found

    def _stay(self, left: str, right: str) -> bool:
        score, parts = self.score, self._parts
        # scores with which the parts at the seam grew into the next larger ones; better ones came earlier
        left_grew = right_grew = float("-inf")
        while True:
            joined = score.get(left + right)
            # of equal scores the leftmost merges first
            if joined is not None and joined > left_grew and joined >= right_grew:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # the later merge of the two is undone first
            if b is None or a is not None and score[left] < score[right]:
                left_grew, left = score[left], a[1]
            elif a is None or score[right] < score[left]:
                right_grew, right = score[right], b[0]
            else:  # the same piece on both sides: the left one merged first
                right_grew, right = score[right], b[0]

    def _word(self, word: str) -> list[str]:
        """Tokens of a word with at most one space mark in front."""
        ends: list[list[str]] = [[] for _ in word]
        for at, piece in self._automaton.iter(word):
            ends[at].append(piece)
        last = [""] * (len(word) + 1)
        goes = self._goes
        for at, char in enumerate(word, 1):
            for piece in ends[at - 1]:
                if goes(last[at - len(piece)], piece):
                    last[at] = piece
                    break
            else:
                last[at] = char  # not in the vocabulary: its bytes
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _run(self, n: int) -> list[str]:
        if n not in self._runs:
            if len(self._runs) > 4096:
                self._runs.clear()
            self._runs[n] = self.merge(SPACE * n)
        return self._runs[n]

    def unit_tokens(self, unit: str) -> list[str]:
        word = unit.lstrip(SPACE)
        marks = len(unit) - len(word)
        if not word:
            return self._run(marks)
        if marks < 2:
            return self._word(unit)
        tokens = self._word(SPACE + word)
        if tokens[0] == SPACE:  # the last mark did not join the word
            return self._run(marks) + tokens[1:]
        return self._run(marks - 1) + tokens

    def ids_of(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if token in self.id:
                out.append(self.id[token])
            else:
                out.extend(self.byte[b] for b in token.encode())
        return out

    def units(self, text: str) -> list[str]:
        """The units of a text with the mark that stands in front of it; an empty text has none."""
        return self._units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.ids_of(self.unit_tokens(unit))] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; marks are spaces, one in front is dropped, control ids have no text."""
        text = self.surface(ids)
        marked = next((self.text[i].startswith(SPACE) for i in ids if self.text[i] in self.id or i in self._byte_of), False)
        return text[1:] if marked else text

    def surface(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self._byte_of:
                raw.append(self._byte_of[i])
                continue
            if raw:
                out.append(_bytes_text(raw))
                raw = bytearray()
            if self.text[i] in self.id:
                out.append(self.text[i].replace(SPACE, " "))
        if raw:
            out.append(_bytes_text(raw))
        return "".join(out)


def _bytes_text(raw: bytearray) -> str:
    """UTF-8; each byte of no valid sequence is one replacement character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(raw[at: at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)
