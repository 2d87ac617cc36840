"""Word names, recompression and set signatures against plain Python."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from lakescribe.llm.key_filter import key_filter, only
from lakescribe.llm.partenum import offers, signatures
from lakescribe.llm.recompress import elect
from lakescribe.llm.words import find_words, pieces
from pyspark.sql import functions as F

TEXTS = ["", None, " a\tb\x0bc\x0c\r\nd ", "é ü x y", "one", "a" * 3000, "x y " * 500, "A b\x1cB"]


def test_words_are_those_of_the_pattern():
    words = find_words(pa.array(TEXTS))
    for d, text in enumerate(TEXTS):
        want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        a, b = words.first[d], words.first[d + 1]
        assert [words.raw[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])] == want
        assert words.text_of(d) == b" ".join(want)


def test_names_tell_words_apart_and_agree():
    words = find_words(pa.array(["ab ba ab", "ba", "a b", "AB"]), lower=True)
    assert words.name[0] == words.name[2] == words.name[-1] and words.name[0] != words.name[1] == words.name[3]


def test_slices_cover_the_batch():
    batch = pa.record_batch({"text": pa.array(TEXTS * 3)})
    parts = list(pieces(batch, "text", 1000))
    assert len(parts) > 3 and pa.Table.from_batches(parts).column("text").to_pylist() == TEXTS * 3


def test_equal_windows_elect_equal_symbols():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [f"{t} {texts[0]} q" for t in texts[:20]] + ["z " * 70, "y z " * 50]
    words = find_words(pa.array(texts))
    for size, rounds in ((5, 2), (20, 3)):
        first, low, name = elect(words, size, rounds)
        assert len(first) == sum(max(0, n - size + 1) for n in words.count)
        seen = {}
        for p, start, symbol in zip(first, low, name):
            key = tuple(words.name[p: p + size])
            assert seen.setdefault(key, (symbol, start - p))[0] == symbol


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    domain = rng.integers(0, 1 << 64, 6000, dtype=np.uint64)
    for size in [*range(1, 60), 90, 150, 240, 400, 1000, 2500]:
        for share in (0.80, 0.85, 0.95):
            whole = rng.choice(domain, size, replace=False)
            common = -(-size * 80 // 100) if share == 0.80 else round(size * share)
            a = np.sort(whole)
            extra = rng.choice(domain, size // 5 + 3, replace=False)
            for b in (whole[:common], np.concatenate((whole[: round(size * 0.9)], extra[: size // 20]))):
                b = np.unique(b)
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= 80 * (len(a) + len(b) - inter):
                    assert set(signatures(a, 80).tolist()) & set(signatures(b, 80).tolist()), (size, share)


def test_similar_sets_still_meet_without_their_most_frequent_signatures():
    """Whatever the order of all signatures is, each set leaves out the last ones that it may leave out."""
    rng = np.random.default_rng(5)
    domain, left_out, pairs = rng.integers(0, 1 << 64, 6000, dtype=np.uint64), 0, 0

    def kept(own, salt):
        found = set()
        for band, may_drop, names in offers(own, 80):
            order = np.argsort((names * np.uint64(salt)) >> np.uint64(3), kind="stable")
            found |= {(band, x) for x in names[order[: len(order) - may_drop]].tolist()}
        return found

    for size in [*range(4, 60, 3), 75, 90, 120, 150, 200, 240, 330, 400, 700, 1000, 2500]:
        for share in (0.80, 0.805, 0.82, 0.9):
            for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 3):
                a = rng.choice(domain, size, replace=False)
                extra = rng.integers(0, 1 << 64, size, dtype=np.uint64)
                part = -(-size * 90 // 100) if share == 0.9 else -(-size * int(share * 1000) // 1000)
                b = np.concatenate((a[:part], extra[: size // 18])) if share == 0.9 else a[:part]
                inter = len(np.intersect1d(a, b))
                if len(b) and 100 * inter >= 80 * (len(a) + len(b) - inter):
                    pairs += 1
                    left_out += sum(d for _, d, _ in offers(np.sort(a), 80))
                    assert kept(np.sort(a), salt) & kept(np.sort(b), salt), (size, share, salt)
    assert pairs > 250 and left_out > 10 * pairs


def test_a_filter_loses_no_key(spark):
    keys = spark.range(-500, 5000, 3).select((F.col("id") * 1_000_003).alias("doc"))
    rows = spark.range(-500, 5000).select((F.col("id") * 1_000_003).alias("doc"), F.lit("x").alias("text"))
    wanted = {r.doc for r in keys.collect()}
    found = [r.doc for r in only(rows, "doc", key_filter(keys, "doc")).collect()]
    assert wanted <= set(found) and len(found) == len(set(found)) < 2300
    small = key_filter(keys, "doc", filter_bytes=64)  # too small for its keys: all pass
    assert small.value.nbytes == 64 and wanted <= {r.doc for r in only(rows, "doc", small).collect()}
    assert only(rows, "doc", key_filter(keys.limit(0), "doc")).count() == 0


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (5, 40, 40, 300, 300, 301)]
    for a, b in itertools.combinations(sets, 2):
        assert not set(signatures(a, 80).tolist()) & set(signatures(b, 80).tolist())
