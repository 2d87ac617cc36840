"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest
from lakescribe.llm.spelling import _Names, near_pairs, spelling_forms, vocabulary
from lakescribe.llm.spelling_query import misspelled

DOCS = "doc_id long, text string, word string, n int, id string, run string"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if is_near(w, o))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = tuple(out[w]) + (root,)
    return out


def found(spark, counts, **options):
    rows = [(w, n, "x", "y", 1) for w, n in counts.items()]
    done = spelling_forms(spark.createDataFrame(rows, "word string, n long, form string, root string, shard int"), **options).collect()
    assert len(done) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in done}


def test_forms_equal_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for alphabet in ("ab", "abcdefgh", "aéßz", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(120):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
            counts[word] = rng.choice([1, 2, 3, 20, 30, 300, 4000])
            i = rng.randrange(len(word))
            counts[word[:i] + rng.choice(alphabet) + word[i + rng.randrange(2):]] = rng.choice([1, 2, 25, 300])
    for base in ("x" * 47, "y" * 48, "abcdefghij" * 7):  # words that share the shard of long ones, and its border
        counts |= {base: 500, base[1:]: 50, base + "z": 5, base[:-1] + "q": 5, base[:20] + "w" + base[21:]: 4}
    assert found(spark, counts) == expected(counts)
    assert found(spark, counts, filter_bytes=256) == expected(counts)  # many passes


def test_ties_chains_and_counts(spark):
    chain = {"aaaaaaa": 100_000, "aaaaaab": 10_000, "aaaaabb": 1_000, "aaaabbb": 100, "aaabbbb": 10, "aabbbbb": 1}
    ties = {"zzzzzzz": 2, "zzzzzzé": 20, "zzzzzzÉ": 20, "zzzzzz": 20, "zzzzzzy": 19}
    done = found(spark, chain | ties)
    assert done == expected(chain | ties)
    assert done["aabbbbb"][4] == "aaaaaaa" and done["zzzzzzz"][2] == "zzzzzz"
    with pytest.raises(ValueError):
        spelling_forms(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_edits_have_the_names_of_their_words():
    words = ["abca", "aabb", "zéßa"]
    edits, names = _Names(words), {}
    row, place, name = edits.deletions()
    assert all(_Names([words[r][:p] + words[r][p + 1:]]).own()[0] == n for r, p, n in zip(row, place, name))
    import numpy as np

    alphabet = np.array(sorted(map(ord, "abzéß")), dtype=np.uint32)
    for row, place, letter, name in edits.replacements(alphabet):
        for r, p, c, n in zip(row, place, letter, name):
            other = words[r][:p] + chr(alphabet[c]) + words[r][p + 1:]
            assert chr(alphabet[c]) > words[r][p] and _Names([other]).own()[0] == n
            names[r, other] = 1
    assert len(names) == sum(sum(ord(x) > ord(c) for x in "abzéß") for w in words for c in w)


def test_vocabulary(spark):
    texts = [
        "Wonderful wonderful WONDERFUL day", "Überraschung überraschung; Ueberraschung×÷ x", None, "", "short words only",
        "wonderful" * 2000 + " " + "wonderful" * 2000, "snake_case_identifier identifier1identifier", "wonderful " * 300,
    ]
    rows = [(i, t, "a", 1, "b", "c") for i, t in enumerate(texts)] + [(None, texts[0], "a", 1, "b", "c")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 7
    want = {w: n for w, n in counts.items() if n >= 2}
    assert {r.word: r.n for r in vocabulary(docs, spelled=misspelled).collect()} == want
    assert {r.word for r in vocabulary(docs, least_count=1).collect()} >= {"identifier", "überraschung", "Überraschung"}
    assert vocabulary(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_and_null_words(spark):
    schema = "word string, n long"
    assert spelling_forms(spark.createDataFrame([], schema)).count() == 0
    done = spelling_forms(spark.createDataFrame([(None, 3), ("", 2), ("a", 5)], schema)).collect()
    assert sorted((r.word, r.n_near, r.root) for r in done) == [("", 0, ""), ("a", 0, "a")]
    assert near_pairs(spark.createDataFrame([("ab", 3), ("b", 2)], schema)).count() == 1
