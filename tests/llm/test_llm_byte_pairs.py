"""Byte pairs against the library and against merging by definition."""

import hashlib
import random

import public_tokenizers
import pytest
from lakescribe.llm.byte_pair_encoding import decode_byte_pairs, encode_byte_pairs
from lakescribe.llm.byte_pairs import STEP, BytePairs, Encodings, word_pattern
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id string, ids string, decoded string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return BytePairs(PATH)


def texts():
    rng = random.Random(7)
    alphabets = ["ab", "aeiou then", "é ñüß€日本x ", "0123456789 .,-=", "<|endoftext|> a", "  \n\t\r\xa0　.a=-_'s"]
    made = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [
        *made, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't they've I'LL", "x" * 5000, " " * 3000 + "y", "\x1c\x85",
        "word " * (STEP // 4), "the cat sat, " * 9000 + "<|endoftext|>" + "on the mat " * 9000, "\U0001f600" * 40, "\x00�",
    ]


def test_ids_and_decoding_equal_the_library(spark, library):
    given = texts()
    rows = [(i, t, "a", "b", "c", 1) for i, t in enumerate(given)] + [(None, None, "a", "b", "c", 1), (0, given[0], "a", "b", "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    values, digests = encode_byte_pairs(docs, PATH), encode_byte_pairs(docs, PATH, digests=True)
    assert values.columns == ["doc_id", "ids", "decoded"] and digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = values.collect()
    assert len(found) == len(rows) and [r.ids for r in found if r.doc_id is None] == [[]]
    of = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(given)}
    for r in found:
        if r.doc_id is not None:
            assert r.ids == of[r.doc_id] and r.decoded == library.decode(r.ids, skip_special_tokens=False) == given[r.doc_id]
    for r in digests.collect():
        ids = of.get(r.doc_id, [])
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decoding_any_ids(spark, library):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(200)] + [[], [50256, 220, 50256]]
    rows = [(i, ids, "x") for i, ids in enumerate(lists)] + [(None, None, "x"), (-1, [None, 64, 99999], "x")]
    done = {r.doc_id: r.decoded for r in decode_byte_pairs(spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string"), PATH).collect()}
    assert done[None] is None and done[-1] == "a"
    assert all(done[i] == library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(lists))


def test_words_of_every_code_point(library, model):
    for low in range(0, 0x110000, 256):
        chars = [chr(c) for c in range(low, low + 256) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c}1{c}! {c}\n{c} \t" for c in chars)
        spans, at = [], 0
        for words, _ in model.split(text):
            for w in words:
                spans.append((at, at + len(w)))
                at += len(w)
        assert spans == [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


def test_the_traversal_equals_merging(model):
    rng = random.Random(11)
    tokens = list(model.id)
    words = {"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))) for _ in range(2000)}
    words |= {w[:k] for w in list(words)[:300] for k in range(1, len(w))} | {"a" * k for k in range(1, 70)}
    done = dict(model.encode_words(words))
    assert done.keys() == words
    assert all(ids == [model.id[t] for t in model.merge(w)] for w, ids in done.items())
    assert list(model.encode_words([])) == []


def test_an_empty_table(spark):
    assert encode_byte_pairs(spark.createDataFrame([], DOCS), PATH).count() == 0
    assert encode_byte_pairs(spark.createDataFrame([], DOCS), PATH, digests=True).count() == 0


def test_other_settings_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as file:
        made = json.load(file)
    made["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        BytePairs(str(tmp_path / "other.json"))


def test_ranges_beyond_the_first_plane_cost_only_texts_that_have_such_characters(model):
    whole = word_pattern()
    plain = ["it's 12 words,\n  é ñ٠ 一�Ɤ x", "a  b　c 힣!"]
    wide = ["a \U0001d400\U0001d401 b", "\U0001f600\U0001f600 x", " \U0001d7d8 1", "\U000105c0 \U0010ffff", "\U00010d40"]
    for text in (*plain, *wide):
        assert [w for words, _ in model.split(text) for w in words] == whole.findall(text)
    assert all(len(model._pattern_of(t).pattern) < len(whole.pattern) for t in plain)
    assert all(model._pattern_of(t).pattern == whole.pattern for t in wide)


def test_only_words_that_decode_differently_keep_a_text(model):
    """Words are looked up once, for their ids; what ids decode to is kept only where it is not the word."""
    known = Encodings(model)
    known.learn({"one", " two", "é"})
    assert known.decoded == {} and dict(known) == {w: ",".join(map(str, i)) for w, i in (
        (w, [model.id[t] for t in model.merge(model.letters(w))]) for w in ("one", " two", "é"))}
    assert known.of(["one", " two", "é"], False) == (",".join(known[w] for w in ("one", " two", "é")), "one two\u00e9")
    known.decoded["one"] = "1"
    assert known.of(["one", " two", "one"], False)[1] == "1 two1"
