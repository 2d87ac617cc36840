"""Operators on documents against brute force, with nulls, ties, repeated rows and odd columns."""

import collections
import hashlib
import random
import re

import pytest
from lakescribe.llm.chat_format import format_conversations, read_back
from lakescribe.llm.components import connected_components
from lakescribe.llm.jaccard_join import jaccard_groups
from lakescribe.llm.line_templates import line_dedup
from lakescribe.llm.packing import best_boundaries, length_bin, pack
from lakescribe.llm.quality import measure_quality, quality_filter
from lakescribe.llm.substring_dedup import substring_dedup
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, doc string, whole string, symbol string, _text string, one int, leaf string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def made_texts(seed=1, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = say(30), []
    for i in range(n):
        text = say(rng.randrange(0, 90))
        if i % 4 == 0:
            text += " " + passage + " " + say(rng.randrange(8))
        if i % 7 == 3:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 9 == 5:
            text = texts[i // 2]
        texts.append(text)
    return [*texts, "", "  \n ", "one", "w " * 300, "long " + "y" * 20_000, " x  Z z", "Z Z z z z z"]


@pytest.fixture(scope="module")
def rows():
    texts = made_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (500, None), (None, texts[3] + " and more words than that"), (7, texts[7]), (7, texts[7])]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "t", 1, "l") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_windows(rows, size):
    seen, out = set(), {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        words = WORD.findall(text or "")
        gone, mine = [False] * len(words), set()
        for p in range(len(words) - size + 1):
            window = tuple(words[p: p + size])
            if window in seen or window in mine:
                gone[p: p + size] = [True] * size
            mine.add(window)
        seen |= mine
        left = [w for w, g in zip(words, gone) if not g]
        out[key] = (len(words), sum(gone), sha(" ".join(left)), " ".join(left))
    return out


def test_substring_dedup(docs, rows, none):
    for size, rounds in ((20, 3), (6, 2)):
        got = substring_dedup(docs, size=size, rounds=rounds, with_text=True).collect()
        want = brute_windows(rows, size)
        assert len(got) == len(rows)
        for r in got:
            n, removed, digest, text = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, digest)
            assert r.kept_text == (text if removed else None)
    assert substring_dedup(none).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(frame):
    long = " ".join(f"w{i}" for i in range(40))
    docs = frame("doc_id long, text string", (1, "a " + long), (1, "b " + long), (2, long), (None, None))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == [(0, 0, 0), (1, 41, 0), (1, 41, 0), (2, 40, 40)]


def brute_groups(rows, n=5):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for key, text in rows:
        words = [w.translate(lower) for w in WORD.findall(text or "")]
        own = {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        sets.append(own)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    order = lambda x: (x is not None, x or 0)
    return sorted(((k, len(s), min(least[find(i)], key=order)) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_jaccard_groups(docs, rows, block_words):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs, block_words=block_words).collect()), key=str)
    assert got == brute_groups(rows)


def test_jaccard_groups_of_nothing(none, frame):
    assert jaccard_groups(none).count() == 0
    blank = frame("doc_id long, text string", (1, None), (2, ""), (3, " "), (4, "one"), (5, "ONE"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(blank).collect()) == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_copies_offer_no_signatures_and_few_texts_meet(spark, monkeypatch):
    """Of copies one stands for all; texts that share a passage only do not meet."""
    from lakescribe.llm import jaccard_join

    written = collections.defaultdict(list)
    kept = jaccard_join.materialize

    def counted(df, label):
        written[label].append(found := kept(df, label))
        return found

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    rng = random.Random(8)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage, alone = say(40), [say(120) for _ in range(30)]
    rows = [(k * 100 + i, t) for k in range(20) for i, t in enumerate(alone)]
    assert {r.component_id for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(30))
    assert written["offers"][0].count() < 5_000  # of 600 times about 130, but for what passes the filter in vain
    texts = [f"{say(150)} {passage} {say(150)}" for _ in range(60)]
    rows = [*enumerate(texts), (100, f"{texts[7]} {say(5)}")]
    got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(60)}, 100: 7}
    assert written["members"][1].select("doc").distinct().count() < 20


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for node in sorted(near):
        stack = [node]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = node
                stack += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    dups, letters = len(lines) - len(set(lines)), sum(c.isalpha() for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    kept = not failed and 2 * len(words) <= chars <= 12 * len(words) and 10 * symbols <= len(words) \
        and 100 * letters >= 60 * chars and 100 * dups <= 30 * len(lines)
    return len(words), chars, symbols, dups, len(covered), failed, kept


def test_quality(docs, rows, none, spark):
    more = [(600, "a # b\na # b\n" * 40), (601, "12 345 6789 " * 30 + "x y z"), (602, "\n".join(f"line {i} of many words here" for i in range(30)))]
    extra = spark.createDataFrame([(i, t, "x", "y", "z", "t", 1, "l") for i, t in more], SCHEMA)
    both = docs.unionByName(extra)
    order = ["symbols", "few_letters", "long_words", "short_words", "repeated_lines"]
    got = sorted((tuple(r) for r in measure_quality(both, order).collect()), key=str)
    assert got == sorted(((i, *brute_quality(t)) for i, t in [*rows, *more]), key=str)
    kept = quality_filter(both, order)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in [*rows, *more] if brute_quality(t)[-1]), key=str)
    for again in (list(reversed(order)), None):  # the order never changes the verdict
        assert kept.exceptAll(quality_filter(both, again)).count() == 0 == quality_filter(both, again).exceptAll(kept).count()
    assert measure_quality(none).count() == 0 == quality_filter(none).count()


def test_repeat_words_where_packed_names_collide(spark, monkeypatch):
    from lakescribe.llm import quality

    texts = made_texts(8, 30)
    monkeypatch.setattr(quality, "_INDEX_BITS", 60)  # four bits of a name are left, so most names collide
    monkeypatch.setattr(quality, "_INDEX", (1 << 60) - 1)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", quality.repeat_words_of(quality.words_of(F.col("text"))).alias("n")).collect()
    assert [(r.text, r.n) for r in got] == [(t, brute_quality(t)[4]) for t in texts]


def test_line_dedup(frame, none):
    head = "This page was printed on 2024-01-{:02d} by user{} of the site"
    rows = [(i, head.format(i, i) + f"\nown text {chr(97 + i)} of document {chr(97 + i)}\n\nAll rights reserved by nobody today") for i in range(8)]
    rows += [(20, rows[3][1]), (21, "quite different words stand here\nAll rights reserved by nobody today"), (22, None), (23, ""), (None, "only\n\nthis ")]
    rows += [(30 + i, f"Order shipped from depot {w} yesterday evening at noon\nunique {w} line {w}") for i, w in enumerate("red green blue black white pink".split())]
    done = {r.doc_id: r for r in line_dedup(frame("doc_id long, text string, gone int", *[(*r, 1) for r in rows]), keep=("gone",)).collect()}
    assert len(done) == len(rows)
    assert done[0].n_removed == 0 and done[0].kept_text == rows[0][1] and done[0].n_lines == 3
    for i in range(1, 8):
        assert done[i].kept_text == f"own text {chr(97 + i)} of document {chr(97 + i)}\n" and done[i].n_removed == 2
    assert done[20].kept_text == f"own text d of document d\n"
    assert done[21].kept_text == "quite different words stand here"
    assert done[22].kept_text is None and done[22].n_lines == 0 and done[23].kept_text == "" and done[None].n_lines == 2
    assert done[30].n_removed == 0 and done[31].kept_text == "unique green line green"  # a field in the middle
    assert line_dedup(none).count() == 0


def test_copies_alone_make_no_line_recur(frame):
    text = "alpha beta gamma delta epsilon\nzeta eta theta iota kappa"
    got = line_dedup(frame("doc_id long, text string", *[(i, text) for i in range(30)])).collect()
    assert len(got) == 30 and not any(r.n_removed for r in got)


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_boundaries_have_the_least_padding():
    import itertools

    import numpy as np

    rng = random.Random(6)
    for buckets in (1, 2, 3, 4, 9):
        lengths = sorted(rng.choice([1, 2, 5, 9, 30, 31, 100, 105]) for _ in range(40))
        kinds = sorted(set(lengths))
        count = np.array([lengths.count(k) for k in kinds])
        bounds = best_boundaries(np.array(kinds), count, buckets)
        choices = [c for k in range(1, min(buckets, len(kinds)) + 1) for c in itertools.combinations(kinds, k) if c[-1] == kinds[-1]]
        assert len(bounds) <= buckets and padding(lengths, bounds) == min(padding(lengths, c) for c in choices)
    assert best_boundaries(np.array([], dtype=int), np.array([], dtype=int), 3) == []


def test_bins_hold_their_lengths(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 2, 1023, 1024, 1025, 1040, 2047, 2048, 2049, 10**6 + 1, 10**12 + 7]], "n long")
    for r in df.select("n", length_bin("n").alias("b")).collect():
        assert r.b == r.n if r.n <= 1024 else 0 <= r.b - r.n <= r.n / 32


def test_pack(docs, rows, none):
    got = pack(docs, buckets=5, budget=200, shard_rows=10).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == sorted(
        (i, len(WORD.findall(t or "")) + 1) for i, t in rows if i is not None)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches[r.bucket_tokens, r.shard, r.batch].append(r.place)
    assert len({b for b, _, _ in batches}) <= 5
    for (bucket, _, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and (len(places) == 1 or bucket * len(places) <= 200)
    assert pack(none).count() == 0
    by_column = pack(docs, length=F.when(F.col("doc_id") > 3, F.col("doc_id"))).collect()
    assert sum(r.n_tokens == 0 for r in by_column) == sum(1 for i, _ in rows if i is None or i <= 3)


def test_chat_format(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "\\", "\\\\n<|", "<\\|", "", None, "ends with <", "é\n\n", "|>\\n"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant"] * 3, odd))]
    turns += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, None, "us\\ner\n<|x", "q"), (None, 1, None, None)]
    turns += [(4, 1, "assistant", "y" * 50_000), (4, 0, "user", "x"), (5, 0, "user", "x"), (6, 0, "assistant", "x")]
    schema = "conv_id long, turn long, role string, text string, segments int, valid string"
    done = {r.conv_id: r for r in format_conversations(spark.createDataFrame([(*t, 1, "v") for t in turns], schema))
            .withColumn("back", read_back(F.col("formatted"))).collect()}
    assert {k: r.valid for k, r in done.items()} == {1: False, 2: False, 3: False, None: False, 4: True, 5: False, 6: False}
    for key, r in done.items():
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(b.role, b.text) for b in r.back] == [(t[2] or "", t[3] or "") for t in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        unescaped = [re.sub(r"\\([\\|])", r"\1", s.text) for s in r.segments if s.loss]
        assert unescaped == [t[3] or "" for t in own if t[2] == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(own)
    assert format_conversations(spark.createDataFrame([], schema)).count() == 0
