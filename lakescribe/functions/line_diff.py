"""Line differences of two texts: anchors, kept runs, unified hunks, and applying them.

Lines that occur once in both texts are anchors; the longest increasing subsequence of their places is
kept, and what lies between two anchors is compared in the same way. A stretch without unique common lines
pairs the k-th occurrences of its common lines instead. Work is n log n for a level of stretches, of
which there are LEVELS at most; memory follows the number of lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

#: Levels of stretches between anchors; a stretch below is replaced as a whole. Lines of context of a hunk.
LEVELS, CONTEXT = 24, 3
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with increasing second places; first places increase already."""
    ends: list[int] = []  # smallest last place of a subsequence of each length
    at: list[int] = []  # the pair that has it
    before = [-1] * len(pairs)
    for k, (_, place) in enumerate(pairs):
        size = bisect_left(ends, place)
        before[k] = at[size - 1] if size else -1
        if size == len(ends):
            ends.append(place)
            at.append(k)
        else:
            ends[size], at[size] = place, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(old: list[int], new: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Places of lines of old[a:b] and new[c:d] to be kept as they are."""
    left, right = Counter(old[a:b]), Counter(new[c:d])
    place = {line: j for j, line in enumerate(new[c:d], c) if right[line] == 1}
    unique = [(i, place[line]) for i, line in enumerate(old[a:b], a) if left[line] == 1 and line in place]
    if unique:
        return _increasing(unique)
    places: dict[int, list[int]] = {}
    for j in range(d - 1, c - 1, -1):
        if new[j] in left:
            places.setdefault(new[j], []).append(j)
    pairs = [(i, places[old[i]].pop()) for i in range(a, b) if places.get(old[i])]
    return _increasing(pairs)


def kept_runs(before: list[str], after: list[str]) -> list[tuple[int, int, int]]:
    """(place before, place after, lines) of the runs of lines that stay, in order."""
    number: dict[str, int] = {}
    old = [number.setdefault(line, len(number)) for line in before]
    new = [number.setdefault(line, len(number)) for line in after]
    kept: list[tuple[int, int]] = []
    waiting = [(0, len(old), 0, len(new), 0)]
    while waiting:
        a, b, c, d, level = waiting.pop()
        while a < b and c < d and old[a] == new[c]:
            kept.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            kept.append((b, d))
        if a == b or c == d or level == LEVELS:
            continue
        for i, j in (found := _anchors(old, new, a, b, c, d)):
            waiting.append((a, i, c, j, level + 1))
            kept.append((i, j))
            a, c = i + 1, j + 1
        if found:
            waiting.append((a, b, c, d, level + 1))
    runs: list[tuple[int, int, int]] = []
    for i, j in sorted(kept):
        if runs and (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) == (i, j):
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    return runs


def _changes(before: list[str], after: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, c, d): lines a:b before become lines c:d after."""
    a = c = 0
    for i, j, size in [*kept_runs(before, after), (len(before), len(after), 0)]:
        if (a, c) != (i, j):
            yield a, i, c, j
        a, c = i + size, j + size


def _range(start: int, size: int) -> str:
    """A range of lines as hunks write it: from 1, the size left out if 1, the line in front if empty."""
    return f"{start + 1}" if size == 1 else f"{start + 1 if size else start},{size}"


def unified_diff(before: list[str], after: list[str], old_name: str, new_name: str) -> list[str]:
    """The lines of a unified diff, without line ends; none for equal texts."""
    hunks: list[list[tuple[int, int, int, int]]] = []
    for change in _changes(before, after):
        if hunks and change[0] - hunks[-1][-1][1] <= 2 * CONTEXT:
            hunks[-1].append(change)
        else:
            hunks.append([change])
    out = [f"--- {old_name}", f"+++ {new_name}"] if hunks else []
    for hunk in hunks:
        first, last = hunk[0], hunk[-1]
        lead, tail = min(CONTEXT, first[0]), min(CONTEXT, len(before) - last[1])
        a, c = first[0] - lead, first[2] - lead
        out.append(f"@@ -{_range(a, last[1] + tail - a)} +{_range(c, last[3] + tail - c)} @@")
        for i, j, k, m in hunk:
            out.extend(" " + line for line in before[a:i])
            out.extend("-" + line for line in before[i:j])
            out.extend("+" + line for line in after[k:m])
            a = j
        out.extend(" " + line for line in before[a: a + tail])
    return out


def apply_diff(before: list[str], diff: list[str]) -> list[str]:
    """The lines after the diff; a diff that does not fit raises ValueError."""
    out, at, left, right = [], 0, 0, 0
    for line in diff[2:]:
        if not (left or right):
            head = _HUNK.fullmatch(line)
            if head is None:
                raise ValueError(f"no hunk: {line!r}")
            start, left, right = int(head[1]), int(head[2] or 1), int(head[4] or 1)
            start -= 1 if left else 0
            if start < at:
                raise ValueError(f"hunks overlap: {line!r}")
            out.extend(before[at:start])
            at = start
            continue
        sign, rest = line[:1], line[1:]
        if sign not in (" ", "-", "+") or sign != "+" and before[at: at + 1] != [rest]:
            raise ValueError(f"line {at + 1} differs: {line!r}")
        at, left = (at, left) if sign == "+" else (at + 1, left - 1)
        if sign != "-":
            out.append(rest)
            right -= 1
        if left < 0 or right < 0:
            raise ValueError(f"a hunk is longer than it says: {line!r}")
    if left or right:
        raise ValueError("the last hunk is shorter than it says")
    return out + before[at:]
