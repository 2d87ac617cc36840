"""Personal data, pieces, languages, embeddings and the pipeline against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from lakescribe.llm import language_model
from lakescribe.llm.embedding_dedup import embedding_groups
from lakescribe.llm.language_id import UNDETERMINED, fit, fold, identify
from lakescribe.llm.pii import KINDS, find_personal_data, masked
from lakescribe.llm.piece_encoding import encode_pieces
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, doc string, tokens string, base int, id string, spans int"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PERSONAL = [
    "mail a.b@c.de, x@y.z@w.v and a@b.c_d@e.f é@q.r", "192.168.0.1 1.2.3.256 1.2.3.4.5.6.7.8 0001.2.03.4 9.9.9", None, "",
    "4111 1111-1111 1111 and 4111111111111112 and 49622512133590 3", "+1 (462) 555-7216 +49 30 1234567 +1 23 +123456789012345678",
    "é" * 50 + " 5500005555555559.", "1" * 4000, "@" * 300 + "a@b.c", "+1234567890+1234567890", "a" * 3000 + "@" + "b." * 2000 + "c",
]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [*PERSONAL, *["".join(rng.choice("ab1234567890..@+- ()5") for _ in range(rng.randrange(80))) for _ in range(150)]]
    rows = [(i, t, "d", "t", 1, "i", 2) for i, t in enumerate(texts)] + [(None, PERSONAL[0], "d", "t", 1, "i", 2), (0, PERSONAL[0], "d", "t", 1, "i", 2)]
    got = find_personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = PERSONAL[0] if r.doc_id is None else texts[r.doc_id]
        assert [tuple(s) for s in r.base] == base_spans(text or "")
    assert find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_contexts_give_unseen_identifiers_away(spark):
    known = [(i, f"some words here then member=user{i}{i}@mail.example and rest {i}.", ) for i in range(12, 20)]
    new = [(40, "now member=AB-99812-X comes"), (41, "and token AB-99812-X stays here"), (42, "plain order=77123456 here")]
    done = {r.doc_id: r for r in find_personal_data(spark.createDataFrame([*known, *new], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in done[40].more] == [("context", 11, 21)]
    assert not done[41].more and not done[42].more and all(len(done[i].base) == 1 for i, _ in known)


def test_contexts_are_whole_words(spark):
    long = "https://host.example/" + "path/" * 60
    known = [(i, f"{' ' * 3 * i}see {long} or {'x' * 90} {' ' * 90}user{i}{i}@mail.example and rest.") for i in range(12, 20)]
    new = [(40, f"see {long} or {'x' * 90} AB-99812-X comes"), (41, f"see {long} and {'x' * 90} AB-99812-Y comes")]
    done = {r.doc_id: r for r in find_personal_data(spark.createDataFrame([*known, *new], "doc_id long, text string")).collect()}
    begin = new[0][1].index("AB-")
    assert [tuple(s) for s in done[40].more] == [("context", begin, begin + 10)] and not done[41].more


def test_contexts_of_phones_cards_and_emails_without_digits(spark):
    tails = ["ann@mail.example", "bob@mail.example", "cid@mail.example", "dan@mail.example"]
    known = [(i, f"please call +1 (01{i}) 555-77{10 + i} today") for i in range(4)]
    known += [(10 + i, f"paid with {c} today") for i, c in enumerate(["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881"])]
    known += [(20 + i, f"our contact: <{t}> today; phone:+1 (01{i}) 555-88{10 + i}") for i, t in enumerate(tails)]
    new = {40: ("please call (017) 555-7713 now", "017) 555-7713"), 41: ("paid with 4111 1111 1111 1112 now", "4111 1111 1111 1112"),
           42: ("our contact: AB-99812-X now", "AB-99812-X"), 43: ("a phone:555-7713 now", "555-7713")}
    other = [(50, "please sing (017) 555-7713 now"), (51, "please call 12 34 abc 5")]
    df = spark.createDataFrame([*known, *[(k, t) for k, (t, _) in new.items()], *other], "doc_id long, text string")
    done = {r.doc_id: [tuple(s)[1:] for s in r.more] for r in find_personal_data(df).collect()}
    for k, (text, want) in new.items():
        assert [text[a:b] for a, b in done[k]] == [want], k
    assert not done[50] and not done[51] and not any(done[k] for k, _ in known)


def test_masked(spark):
    df = spark.createDataFrame([("é a@b.cd x", [("email", 2, 8), ("card", 3, 5)])], "text string, s array<struct<kind:string,begin:long,end:long>>")
    assert df.select(masked(F.col("text"), F.col("s"))).first()[0] == "é [EMAIL] x"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(spark, library):
    path, model = library
    rng = random.Random(9)
    alphabet = "ab ▁ \n\té😀ñ.,12 ing the <s></s><0x0A>  \x00_²"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(400)]
    texts += ["", " ", "x" * 20_000, " " * 100, "  two  spaces ", "▁▁a▁", "the" * 400, "\n\n", "x" + " " * 31 + "y", "Word.Next, a_. 2². end.", None, "same", "same"]
    df = spark.createDataFrame([(i, t, "i", "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    for r in encode_pieces(df, path).collect():
        want = model.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == want and r.decoded == model.decode(want)
    assert encode_pieces(df.limit(0), path).count() == 0


def test_decoding_equals_the_library(library):
    from lakescribe.llm.pieces import Pieces

    path, model = library
    own, rng = Pieces(path), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000), 1, 2]) for _ in range(12)]
        assert own.decode(ids) == model.decode(ids)


def brute_kneser_ney(texts, order):
    """Probabilities by definition: a function of (context, character)."""
    grams = collections.Counter()
    for text in texts:
        clean = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
        whole = " " * (order - 1) + clean
        for i in range(order - 1, len(whole)):
            grams[whole[i - order + 1: i + 1]] += 1
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def p(context, char, n=order):
        table = counts[n]
        once, twice = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        own = {g: c for g, c in table.items() if g[:-1] == context}
        total = sum(own.values())
        lower = 1 / (len(counts[1]) + 1) if n == 1 else p(context[1:], char, n - 1)
        if not total:
            return lower
        return max(table[context + char] - discount, 0) / total + discount * len(own) / total * lower

    return p


def test_kneser_ney_equals_its_definition():
    import pyarrow as pa

    order, sets = 3, {"x": ["ab abb abc", "abba cab", "bab"], "y": ["Éa, ca 9 acc", "aac cca e"]}
    own = {k: language_model.count_grams(v, order) for k, v in sets.items()}
    scorer = language_model.Scorer({k: language_model.train(v, order) for k, v in own.items()}, order)
    scorer.fill(pa.concat_tables([v.drop_columns(["n"]) for v in own.values()]))
    texts = ["abc cab", "zzz a", "éac  b", "q"]
    mean, letters = scorer.mean_log_p(texts)
    for i, text in enumerate(texts):
        clean = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
        whole = " " * (order - 1) + clean
        assert letters[i] == sum(c.isalpha() for c in text)
        for k, lang in enumerate(scorer.languages):
            p = brute_kneser_ney(sets[lang], order)
            want = np.mean([math.log(p(whole[j - order + 1: j], whole[j])) for j in range(order - 1, len(whole))])
            assert mean[i, k] == pytest.approx(want, abs=1e-4)


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["lorem", "dolor", "amet", "sit"], "bb": ["über", "schön", "das", "ist"], "cc": ["était", "où", "ça", "mais"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(3, 30))), k) for i in range(300) for k in [rng.choice(list(words))]]
    rows += [(900, None, "aa"), (901, "123 .. !", "bb"), (902, "das ist schön", None), (None, "dolor amet", "aa"), (3, rows[3][1], rows[3][2])]
    rows += [(903, "ist das " * 40_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    identifier = fit(docs.where(fold("doc_id") != 1))
    found = {r.doc_id: r for r in identify(docs, identifier).collect()}
    assert identify(docs, identifier).count() == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 900]
    assert sum(found[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.98
    assert found[900].lang_pred == found[901].lang_pred == UNDETERMINED and found[900].score == 0.0
    assert found[902].lang_pred == found[903].lang_pred == "bb" and 0 <= found[902].score <= 1
    strange = identify(spark.createDataFrame([(1, "xkqz wvkj qqxz zzkw")], "doc_id long, text string"), identifier).first()
    assert strange.lang_pred in words and not strange.accepted
    nothing = docs.limit(0)
    assert fit(nothing) is None and identify(nothing, identifier).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {UNDETERMINED}


def test_a_hot_text_is_one_text_of_the_sample(spark):
    from lakescribe.llm.language_id import _sample

    rows = [(i, "the same text again" if i % 3 else f"text number {i}", "aa") for i in range(900)] + [(i, f"autre {i}", "bb") for i in range(900, 940)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts = [_sample(docs, "text", "lang", 100, part).collect() for part in (0, 1)]
    for part in parts:
        assert len(part) == len(set(part)) and 60 < sum(r.lang == "aa" for r in part) < 150 and sum(r.lang == "bb" for r in part) > 5
    assert not set(parts[0]) & set(parts[1])


def brute_links(rows, least):
    usable = {}
    for k, (key, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            usable[k] = x / math.sqrt(x @ x)
    links = collections.defaultdict(set)
    for i in usable:
        for j in usable:
            if i != j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least:
                links[i].add(j)
    return links


def made_vectors(seed=1, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, dim))
    rows = [(i, (centers[i % 25] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.5])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[i * 7][1]) for i in range(20)]
    rows += [(900, None), (901, [0.0] * dim), (902, [float("nan")] + [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, []),
             (905, [float("inf")] * dim), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("cell_rows,block_rows", [(2000, 2048), (2000, 50)])
def test_embedding_groups(spark, cell_rows, block_rows):
    rows = made_vectors()
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, first string, copies int")
    got = collections.defaultdict(list)
    for r in embedding_groups(df, cell_rows=cell_rows, block_rows=block_rows).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    links = brute_links(rows, 0.95)
    component = {}
    for i in range(len(rows)):
        stack, seen = [i], set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += links[x]
        component[i] = min(rows[x][0] for x in seen)
    for i, (key, _) in enumerate(rows):
        assert (len(links[i]), component[i], key == component[i]) in got[key], key
    assert sum(map(len, got.values())) == len(rows)
    assert embedding_groups(df.limit(0)).count() == 0


def test_recall_of_cells(spark):
    rows = [r for r in made_vectors(5, 1500, 24) if r[0] < 900 or r[0] >= 910]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embedding_groups(df, cell_rows=100, block_rows=64).where("vec_id <> 0").collect()}
    links = brute_links(rows, 0.95)
    want = {rows[i][0]: len(links[i]) for i in range(len(rows)) if rows[i][0] != 0}
    assert all(found[k] <= want[k] for k in want)
    assert sum(found.values()) >= 0.9 * sum(want.values()) > 0


def test_no_link_is_lost_between_cells(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    first, other = unit(rng.normal(size=(1500, 16))), rng.normal(size=(1500, 16))
    other = unit(other - (other * first).sum(axis=1, keepdims=True) * first)
    cosine = rng.uniform(0.9505, 1, (1500, 1))
    vectors = np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * other]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embedding_groups(df, cell_rows=15, block_rows=64).collect()}
    units = unit(vectors.astype(np.float64))
    assert found == dict(enumerate(((units @ units.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    from test_llm_documents import brute_groups, brute_quality

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randrange(55, 120)) + "\nShared footer line of the whole site" for _ in range(30)]
    texts += [texts[3], texts[4].replace(texts[4].split()[5], "other", 1), "too short", None, "# " * 200, say(80) + " call a.b@c.de now"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, say(70), None, None, None), (3, texts[3], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    functions = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "personal_data", "packing"]

    kept = functions["quality"](spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if brute_quality(r[1])[-1]), key=str)
    cleaned = functions["lines"](spark, kept, "")
    assert cleaned.columns == docs.columns and cleaned.count() == kept.count()
    assert cleaned.where(F.col("text").contains("Shared footer")).count() == 1
    assert cleaned.where("doc_id > 0 AND n_chars <> length(text)").count() == 0
    left = functions["near_duplicates"](spark, cleaned, "")
    pairs = [(r.doc_id, r.text) for r in cleaned.collect()]
    want = {k for k, _, c in brute_groups(pairs) if k == c}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted(want, key=str) and len(want) < len(pairs)
    safe = functions["personal_data"](spark, left, "")
    assert safe.columns == docs.columns and safe.count() == left.count()
    assert safe.where(F.col("text").contains("@")).count() == 0
    assert [r.text for r in left.join(safe.select("doc_id", F.col("text").alias("new")), "doc_id").where("text <> new").collect()] == [
        r.text for r in left.where(F.col("text").contains("@")).collect()]
    packed = functions["packing"](spark, safe, "")
    assert packed.count() == safe.count() and packed.where("n_tokens > bucket_tokens").count() == 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), "").count() == 0, name


def test_pipeline_shuffles_texts_once_after_near_duplicates_are_known(spark):
    import corpus_pipeline as pipeline

    rows = [(i % 6 or None, f"text number {i % 4} of a few words", i) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = pipeline.near_duplicates(spark, docs, "")
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above, join, below = plan.partition("LeftSemi")
    assert join and "Window" in above and "Exchange" not in above and below.count("Exchange") >= 2
    assert len(left.collect()) == len({(r.doc_id, r.text) for r in left.collect()}) and left.schema == docs.schema


def test_pipeline_passes_clashing_names_through(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(200)]
    names = ("kept_text", "_id", "_name", "_spans", "_text", "_n", "_text_name", "row", "doc", "name", "place", "spans", "words", "id", "gone",
             "text_name", "new_text", "found_id", "base", "more", "component_id", "stays_id", "n_lines", "bucket_tokens", "odd name", "a.b")
    texts = [" ".join(rng.choice(words) for _ in range(70)) + f" mail a{i}.b@c.de" for i in range(12)]
    texts += [texts[0], texts[1], None, ""]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)] + [(0, texts[0], *[f"{n} 0" for n in names])]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        done = stage(spark, docs, "")
        assert done.columns == docs.columns, name
        found = done.collect()
        assert len(found) >= 12 and all(r[2 + k] == f"{n} {r.doc_id}" for r in found for k, n in enumerate(names)), name
    assert pipeline.packing(spark, docs, "").count() == len(rows)
    masked_texts = {r.doc_id: r.text for r in pipeline.personal_data(spark, docs, "").collect()}
    assert masked_texts[3] == texts[3].replace("a3.b@c.de", "[EMAIL]") and masked_texts[14] is None and masked_texts[15] == ""


def test_masking_takes_the_first_of_overlapping_spans(spark):
    rng = random.Random(8)
    kinds = "array<struct<kind:string,begin:long,end:long>>"
    rows = []
    for _ in range(200):
        text = "".join(rng.choice("abcé😀 1") for _ in range(rng.randrange(60)))
        spans = []
        for _ in range(rng.randrange(12)):
            begin = rng.randrange(len(text) + 1)
            spans.append((rng.choice(["ip", "card"]), begin, min(len(text), begin + rng.randrange(1, 9))))
        rows.append((text, [s for s in spans if s[1] < s[2]]))
    got = spark.createDataFrame(rows, f"text string, spans {kinds}").select("text", "spans", masked(F.col("text"), F.col("spans")).alias("m")).collect()
    for r in got:
        out, at = "", 0
        for begin, end, kind in sorted((s.begin, s.end, s.kind) for s in r.spans):
            if begin >= at:
                out, at = f"{out}{r.text[at:begin]}[{kind.upper()}]", end
        assert r.m == out + r.text[at:]


@pytest.mark.parametrize("few", [0, 10_000])
def test_contexts_by_index_equal_those_read_off(spark, monkeypatch, few):
    """Seeds and candidates of both ways against plain searches; many spans in a text take nothing like the square of the time."""
    import time

    from lakescribe.llm import pii

    monkeypatch.setattr(pii, "FEW_SPANS", few)
    rng = random.Random(4)
    parts = ["tel +1 (462) 555-7216", "id=a1@b.cd", "12 345", "word", "é", "\n", "\t ", " ", "1.2.3.4.5", "x" * 230, "(12) 34-5.", "q9", "a@b.c"]
    texts = [rng.choice([" ", ""]).join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    for r in pii._with_tokens(df).collect():
        text = texts[r.doc]
        base = [(b, e) for _, b, e in base_spans(text)]
        tokens = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]*[0-9][^ \t\n\x0b\f\r]*", text)]
        words = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
        assert [(s.begin, s.end) for s in r.base] == base
        free = {t for t in tokens if not any(b < t[1] and e > t[0] for b, e in base)}
        assert free <= {(t.begin, t.end) for t in r.tokens if not t.seed}
        for t in r.tokens:
            start, number = max((w[0], k) for k, w in enumerate(words) if w[0] <= t.begin)
            assert t.value == text[t.begin: t.end] and t.glued == (text[start: t.begin] if t.seed else "")
            assert t.before == ([text[slice(*words[number - 2])], text[slice(*words[number - 1])]] if number >= 2 else [])
        assert [(t.begin, t.end) for t in r.tokens if t.seed] == base
    if not few:
        seconds = []
        for n in (500, 40_000):
            text = " and ".join(f"{rng.randrange(10**9)} u{i}@mail.example" for i in range(n))
            begun = time.time()
            assert spark.createDataFrame([(1, text)], "doc long, text string").transform(pii._with_tokens).select(F.size("base")).first()[0] == n
            seconds.append(time.time() - begun)
        assert seconds[1] < 20 + 4 * seconds[0]


def test_patterns_equal_rounds_by_hand(spark):
    from lakescribe.llm.pii import learn_patterns

    rng = random.Random(13)
    for least_support, least_confidence, rounds in ((1, 0.5, 1), (2, 0.6, 3), (3, 0.75, 3)):
        rows = [(f"p{rng.randrange(14)}", f"i{rng.randrange(40)}") for _ in range(150)]
        known = {f"i{k}" for k in range(0, 40, 3)}
        edges = [(p, i, i in known and rng.random() < 0.8) for p, i in rows]
        graph = {}
        for p, i, seed in edges:
            graph[p, i] = graph.get((p, i), False) or seed
        belief = {e: float(seed) for e, seed in graph.items()}
        for _ in range(rounds):
            confident = {}
            for p in {p for p, _ in graph}:
                own = [b for (q, _), b in belief.items() if q == p]
                mean = sum(own) / len(own)
                if sum(b >= least_confidence for b in own) >= least_support and mean >= least_confidence:
                    confident[p] = mean
            best = {}
            for p, i in graph:
                if p in confident:
                    best[i] = max(best.get(i, 0.0), confident[p])
            belief = {(p, i): 1.0 if seed else best.get(i, 0.0) for (p, i), seed in graph.items()}
        found = learn_patterns(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), rounds, least_support, least_confidence)
        got = {r["pattern"]: r["confidence"] for r in found.collect()}
        assert got.keys() == confident.keys() and all(abs(got[p] - confident[p]) < 1e-9 for p in got)
