"""Hard negatives against brute force over all pairs."""

import math
import random

import pytest
from lakescribe.llm import hard_negatives as H
from lakescribe.llm.hard_negatives import hard_negatives
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<double>, label int, id string, key int, block int, norm double, angles int, low string"
EXTRA = ("i", 1, 2, 3.0, 4, "l")


def expected(rows, positives=5, negatives=3, scale=256):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(scale * x) for x in v)
        if sum(x * x for x in whole) < 2**62:
            usable.setdefault((i, label, whole), 1)
    out, asked = set(), {}
    for i, label, v in sorted(usable):
        if i % 50 == 0:
            asked.setdefault(i, (label, v))
    for a, (label, v) in asked.items():
        scored = {(-sum(x * y for x, y in zip(v, w)), j, own == label) for j, own, w in usable if j != a and len(w) == len(v)}
        near = [(-s, j) for s, j in sorted({(s, j) for s, j, same in scored if same})[:positives]]
        for p, j in near:
            fits = [(-s, n) for s, n in sorted({(s, n) for s, n, same in scored if not same}) if 50 * p <= 100 * -s <= 95 * p]
            out |= {(a, j, k + 1, n, p, s) for k, (s, n) in enumerate(fits[:negatives])}
    return out


def found(spark, rows, **options):
    done = hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 50 == 0, **options)
    assert done.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in done.collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(rng, n, dim, clusters, labels, spread=0.3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    out = []
    for i in range(n):
        centre = rng.choice(centres)
        length = rng.choice([0.1, 1, 1, 3])
        out.append((i, [length * (c + spread * rng.gauss(0, 1)) for c in centre], rng.randrange(labels), *EXTRA))
    return out


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 3)
    rows = clustered(random.Random(2), 900, 6, 9, 4)
    want = expected(rows)
    assert len(want) > 100 and found(spark, rows) == want


def test_ties_copies_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 25)
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(3)], rng.randrange(3), *EXTRA) for i in range(400)]
    rows += rows[:120]  # repeated rows
    rows += [(50, [1.0, 0.0, 1.0], 0, *EXTRA), (50, [0.0, 1.0, 1.0], 2, *EXTRA), (7, [1.0, 1.0, 1.0], 1, *EXTRA)]  # ids of several rows
    rows += [
        (100, [0.0, 0.0, 0.0], 1, *EXTRA), (1000, None, 1, *EXTRA), (1050, [1.0, None, 1.0], 1, *EXTRA), (1100, [1.0, float("nan"), 0.0], 1, *EXTRA),
        (1150, [float("inf"), 0.0, 0.0], 1, *EXTRA), (1200, [1.0, 1.0, 1.0], None, *EXTRA), (None, [1.0, 1.0, 1.0], 1, *EXTRA),
        (1250, [], 1, *EXTRA), (1251, [], 1, *EXTRA), (1252, [], 2, *EXTRA), (1300, [1.0, 2.0], 1, *EXTRA), (1301, [1.0, 2.0], 1, *EXTRA),
        (1302, [1.0, 1.0], 2, *EXTRA), (1350, [1e300, 0.0, 0.0], 1, *EXTRA), (1400, [0.0, 0.0, 0.0], 2, *EXTRA), (1401, [0.001, 0.0, 0.001], 2, *EXTRA),
    ]
    assert found(spark, rows) == expected(rows)


def test_long_vectors_score_in_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 400_000.0) for _ in range(4)], rng.randrange(2), *EXTRA) for i in range(150)]
    want = expected(rows)
    assert max(abs(r[4]) for r in want) > 2**53 and found(spark, rows) == want


def test_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 30)
    rng = random.Random(1)
    rows = [(i, [1.0, 0.5, 0.0] if i % 3 else [rng.random() for _ in range(3)], i % 5, *EXTRA) for i in range(300)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, positives=2, negatives=1) == expected(rows, 2, 1)


def test_empty_tables_and_no_anchor(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0], 1, *EXTRA), (2, [1.0], 2, *EXTRA)]) == set()
    assert found(spark, [(50, [1.0], 1, *EXTRA)]) == set()
    with pytest.raises(ValueError):
        found(spark, [], low_percent=0)
