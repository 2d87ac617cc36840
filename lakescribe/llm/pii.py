"""Personal data in texts: base patterns, and identifiers that bootstrapped contexts give away.

Built-in functions only. Base kinds are found by patterns with a check of their digits. Base entities,
each as a whole, then seed lexical patterns: the words in front of one, or its key as in ``name=``.
Candidates are tokens with a digit and runs of numbers with blanks between them. Patterns and the identifiers they stand with form a graph that Spark scores in rounds;
identifiers that confident patterns introduce are added as spans of kind ``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .quality import let

#: Fixed patterns. The possessive forms match what the plain ones do, without recursion or retries:
#: behind each of them no text is left to match that it could have given back.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Candidates: a word that holds a digit; two and more words of digits and marks, as numbers are grouped.
WORD, TOKEN = r"\S++", r"[^\s0-9]*+[0-9]\S*+"
NUMBERS = r"(?<!\S)[(+]*+[0-9][0-9().+/-]*+(?:\x20++[(]*+[0-9][0-9().+/-]*+(?!\p{Punct}*+[^\s\p{Punct}]))++"


def scan(values: Column, merge, levels: int = 6, width: int = 16) -> Column:
    """Running results: item i becomes the items 0 to i merged, by looking back further from level to level.

    The second argument of merge can be null (there is nothing further back). Every level reads `width` items
    each, so n items take n log n steps and no array grows step by step; width**levels items at most.
    """
    steps = F.array(*[F.lit(k) for k in range(1, width)])

    def back(step: int):
        return lambda v: F.when(F.size(v) <= step, v).otherwise(F.transform(
            v, lambda x, i: F.aggregate(steps, x, lambda a, k: merge(a, F.get(v, i - k * step)))))

    for level in range(levels):
        values = let(values, back(width**level))
    return values


def _running_sums(values: Column) -> Column:
    return scan(values, lambda a, b: a + F.coalesce(b, F.lit(0)))


def _ranks(values: Column, asked: Column, or_equal: bool) -> Column:
    """For every number asked for how many of the values are below it, or equal to it too; by one sort of both."""
    value_tag, asked_tag = (0, 1) if or_equal else (1, 0)
    both = F.concat(
        F.transform(values, lambda v: F.struct(v.cast("long").alias("at"), F.lit(value_tag).alias("tag"), F.lit(-1).alias("i"))),
        F.transform(asked, lambda q, i: F.struct(q.cast("long").alias("at"), F.lit(asked_tag).alias("tag"), i.alias("i"))))

    def counted(items: Column) -> Column:
        return let(_running_sums(F.transform(items, lambda x: (x["i"] < 0).cast("int"))), lambda sums: F.transform(
            F.sort_array(F.filter(
                F.transform(items, lambda x, j: F.struct(x["i"].alias("i"), F.get(sums, j).alias("n"))), lambda x: x["i"] >= 0)),
            lambda x: x["n"]))

    return F.when(F.size(values) == 0, F.transform(asked, lambda q: F.lit(0))).otherwise(let(F.sort_array(both), counted))


def _spans(text: Column, pattern: str) -> Column:
    """All matches as (begin, end, value), code points, leftmost and not overlapping.

    Matches and the texts between them alternate, so places are running sums of lengths.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda value, i: F.length(value) + F.length(F.get(x["gaps"], i)))
        return let(_running_sums(lengths), lambda ends: F.transform(x["found"], lambda value, i: F.struct(
            (F.get(ends, i) - F.length(value)).cast("long").alias("begin"), F.get(ends, i).cast("long").alias("end"), value.alias("value"))))

    none = F.array().cast("array<struct<begin:long,end:long,value:string>>")
    return let(parts, lambda x: F.when(F.size(x["found"]) == 0, none).otherwise(placed(x)))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), s["value"].alias("value")))


def _luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x: x.cast("int"))
    folded = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(folded, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _ip_is_right(span: Column) -> Column:
    # a part of any length is at most 255 if no more than three digits follow its leading zeros
    parts = F.transform(F.split(span["value"], r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _card_is_right(span: Column) -> Column:
    digits = _digits(span["value"])
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _phone_is_right(span: Column) -> Column:
    return F.length(_digits(span["value"])).between(9, 15)


def base_spans(text: Column) -> Column:
    """The spans of base kinds in a text that is not null, by kind, then begin: (kind, begin, end, value)."""
    none = F.array().cast("array<struct<kind:string,begin:long,end:long,value:string>>")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _of_kind(_spans(text, EMAIL), "email")).otherwise(none),
        _of_kind(F.filter(_spans(text, IP), _ip_is_right), "ip"), _of_kind(F.filter(_spans(text, CARD), _card_is_right), "card"),
        F.when(F.contains(text, F.lit("+")), _of_kind(F.filter(_spans(text, PHONE), _phone_is_right), "phone")).otherwise(none),
    )


def _free(spans: Column, begun: Column, ended: Column) -> Column:
    """Spans that overlap no base span: as many of these begin in front of their end as end in front of their begin."""
    return F.filter(spans, lambda s, i: F.get(begun, i) == F.get(ended, i))


def _near(words: Column, spans: Column, places: Column, seed: bool) -> Column:
    """Spans as (begin, end, value, glued, before, seed); places: how many words begin up to their begin.

    glued: what stands in front of a seed in its word; before: the two words in front of that, empty if there are fewer.
    """

    def token(span: Column, at: Column) -> Column:
        own = F.get(words, at)
        glued = F.substring(own["value"], F.lit(1), (span["begin"] - own["begin"]).cast("int")) if seed else F.lit("")
        before = F.when(at >= 2, F.array(F.get(words, at - 2)["value"], F.get(words, at - 1)["value"]))
        return F.struct(
            span["begin"].alias("begin"), span["end"].alias("end"), span["value"].alias("value"), glued.alias("glued"),
            F.coalesce(before, F.array().cast("array<string>")).alias("before"), F.lit(seed).alias("seed"))

    return F.transform(spans, lambda s, i: token(s, F.get(places, i) - 1))


def _begins(spans: Column | str) -> Column:
    return F.transform(spans, lambda s: s["begin"])


def _ends(spans: Column | str) -> Column:
    return F.transform(spans, lambda s: s["end"])


#: Rows with so many spans at most read the contexts off the text itself, which for a few costs less than all words.
FEW_SPANS = 48


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda x: x != "")


def _in_front(text: Column, at: Column, window: int) -> Column:
    return F.substring(text, F.greatest(at - window + 1, F.lit(1)).cast("int"), F.least(at, F.lit(window)).cast("int"))


def _words_before(text: Column, at: Column, window: int = 200) -> Column:
    """The two last whole words before a place, in an array; empty if there are fewer."""
    near = _words(_in_front(text, at, window))
    # the first word of a window can be cut; with fewer than three the whole text in front is read
    whole = (at <= window) | (F.size(near) >= 3)
    return F.slice(F.when(whole, near).otherwise(_words(F.substring(text, F.lit(1), at.cast("int")))), -2, 2)


def _glued(text: Column, at: Column, window: int = 200) -> Column:
    """What stands in front of a place without a blank between."""
    last = lambda t: F.element_at(F.split(t, r"\s", -1), -1)
    near = last(_in_front(text, at, window))
    return F.when(F.length(near) < window, near).otherwise(last(F.substring(text, F.lit(1), at.cast("int"))))


def _read_off(text: Column, candidates: Column, base: Column) -> Column:
    """What `_near` gives for the free candidates and for base, from the text itself."""

    def token(span: Column, glued: Column, seed: bool) -> Column:
        return F.struct(
            span["begin"].alias("begin"), span["end"].alias("end"), span["value"].alias("value"), glued.alias("glued"),
            _words_before(text, span["begin"] - F.length(glued)).alias("before"), F.lit(seed).alias("seed"))

    free = F.filter(candidates, lambda t: ~F.exists(base, lambda s: (s["begin"] < t["end"]) & (s["end"] > t["begin"])))
    seeds = F.transform(base, lambda s: F.struct(s.alias("span"), _glued(text, s["begin"]).alias("glued")))
    return F.concat(F.transform(free, lambda s: token(s, F.lit(""), False)), F.transform(seeds, lambda x: token(x["span"], x["glued"], True)))


def _with_tokens(df: DataFrame) -> DataFrame:
    """(doc, text) with text_name, base and tokens: seeds, and the candidates that touch no base span.

    Seeds are base spans as wholes; candidates are words with a digit and runs of numbers. With more than FEW_SPANS of them
    the words are found once and contexts are read off by index; a few are looked up in the text. The results are the same,
    and either way the work follows the length of the text. Each step names what the next one reads, so nothing is worked out twice.
    """
    df = df.select("doc", "text", F.xxhash64("text").alias("text_name"), base_spans(F.col("text")).alias("base"),
                   F.concat(_spans(F.col("text"), TOKEN), _spans(F.col("text"), NUMBERS)).alias("candidates"))
    df = df.select("*", (F.size("base") + F.size("candidates") > FEW_SPANS).alias("many"))
    many = lambda value: F.when(F.col("many"), value)
    df = df.select(
        "*", many(_spans(F.col("text"), WORD)).alias("words"), many(_ranks(_begins("base"), _ends("candidates"), False)).alias("begun"),
        many(_ranks(_ends("base"), _begins("candidates"), True)).alias("ended"))
    df = df.select("*", many(let(F.struct("candidates", "begun", "ended"), lambda x: _free(x["candidates"], x["begun"], x["ended"]))).alias("free"))
    df = df.select(
        "*", many(_ranks(_begins("words"), _begins("free"), True)).alias("own"), many(_ranks(_begins("words"), _begins("base"), True)).alias("seeds"))
    by_index = let(F.struct("words", "base", "free", "own", "seeds"), lambda x: F.concat(
        _near(x["words"], x["free"], x["own"], False), _near(x["words"], x["base"], x["seeds"], True)))
    few = let(F.struct("text", "candidates", "base"), lambda x: _read_off(x["text"], x["candidates"], x["base"]))
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end")))
    return df.select("doc", "text_name", bare.alias("base"), F.when(F.col("many"), by_index).otherwise(few).alias("tokens"))


def _edges(tokens: DataFrame, least_length: int, least_digits: int) -> DataFrame:
    """(doc, text, begin, end, pattern, instance, seed) for each seed and each candidate that could be an identifier.

    The pattern of ``key=value`` and ``key:value`` is the key, else the two words in front; digits in
    it count as 9. The instance is the value without punctuation around it; a seed's is its whole span.
    """
    keyed = F.regexp_extract("value", r"^([\p{Punct}]*[\p{L}_-]+[=:])(.+)$", 2)
    is_keyed = ~F.col("seed") & (keyed != "")
    value = F.when(is_keyed, keyed).otherwise(F.col("value"))
    lead = F.when(F.col("seed"), 0).otherwise(F.length(F.regexp_extract(value, r"^\p{Punct}*", 0)))
    core = F.when(F.col("seed"), value).otherwise(F.regexp_replace(value, r"^\p{Punct}+|\p{Punct}+$", ""))
    key = F.when(F.col("seed"), F.regexp_extract("glued", r"^[\p{Punct}]*([\p{L}_-]+[=:])\p{Punct}*$", 1)).otherwise(
        F.regexp_extract("value", r"^[\p{Punct}]*([\p{L}_-]+[=:]).+$", 1))
    pattern = F.when(key != "", key).otherwise(F.array_join("before", " "))
    pattern = F.regexp_replace(F.lower(pattern), "[0-9]+", "9")
    begin = F.col("begin") + F.length("value") - F.length(value) + lead
    digits = F.length(F.regexp_replace("instance", "[^0-9]+", ""))
    return tokens.select(
        "doc", "text_name", begin.cast("long").alias("begin"), (begin + F.length(core)).cast("long").alias("end"),
        pattern.alias("pattern"), core.alias("instance"), "seed",
    ).where((F.col("pattern") != "") & (F.col("seed") | ((F.length("instance") >= least_length) & (digits >= least_digits))))


def learn_patterns(
    edges: DataFrame, rounds: int, least_support: int, least_confidence: float,
) -> DataFrame:
    """Confident patterns: (pattern, confidence).

    A pattern's confidence is the mean belief in the identifiers it stands with; seeds have belief 1,
    others the confidence of their best pattern so far. A pattern counts once `least_support` believed
    identifiers stand with it. Edges of the graph are counted first, so a pattern that stands with
    millions of tokens is one row per identifier.
    """
    graph = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    belief = graph.withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(0.0))
    patterns = None
    for _ in range(rounds):
        patterns = materialize(
            belief.groupBy("pattern").agg(
                F.avg("belief").alias("confidence"), F.sum(F.when(F.col("belief") >= least_confidence, 1).otherwise(0)).alias("support"),
            ).where((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence)).select("pattern", "confidence"),
            "pii-patterns",
        )
        best = graph.join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        belief = graph.join(best, "instance", "left").withColumn(
            "belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))))
    return patterns


def find_personal_data(
    docs: DataFrame, rounds: int = 3, least_support: int = 3, least_confidence: float = 0.75, least_length: int = 6,
    least_digits: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, text_name, base (spans of base kinds) and more (spans of kind context).

    Spans are (kind, begin, end), code points, end exclusive; base by kind, then begin; more by begin,
    none of them touching a base span. Null text: empty. Null ids and repeated rows are rows like
    others. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    df = docs.select(F.col(id_column).alias("doc"), text.alias("text"))
    found = materialize(_with_tokens(df), "pii-found")
    tokens = found.select("doc", "text_name", F.explode("tokens").alias("t")).select("doc", "text_name", "t.*")
    edges = materialize(_edges(tokens, least_length, least_digits), "pii-edges")
    patterns = learn_patterns(edges, rounds, least_support, least_confidence)
    more = (
        edges.where(~F.col("seed")).join(patterns.select("pattern"), "pattern", "left_semi")
        # bounded by the length of one document
        .groupBy("doc", "text_name").agg(F.array_sort(F.collect_set(F.struct(
            F.lit("context").alias("kind"), F.col("begin"), F.col("end")))).alias("more"))
    )
    # a token within a run of numbers that is found too goes: some span in front of it ends behind it, or the next begins with it
    reach = scan(_ends("more"), F.greatest)
    more = more.select("doc", "text_name", F.struct("more", reach.alias("reach")).alias("x")).withColumn("more", let(F.col("x"), lambda x: F.filter(
        x["more"], lambda s, i: ~(F.coalesce(F.get(x["reach"], i - 1) >= s["end"], F.lit(False))
                                  | F.coalesce(F.get(x["more"], i + 1)["begin"] == s["begin"], F.lit(False))))))
    left, right = found.drop("tokens").alias("l"), more.alias("r")
    joined = left.join(right, F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.text_name") == F.col("r.text_name")), "left")
    return joined.select(
        F.col("l.doc").alias(id_column), F.col("l.text_name").alias("text_name"), "base",
        F.coalesce("more", F.array().cast("array<struct<kind:string,begin:long,end:long>>")).alias("more"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts.

    Spans that touch none in front of them begin a group; within a group they are taken in order. What is kept is
    cut out of the list of characters and joined once.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<begin:long,end:long,kind:string>>")

    def grouped(items: Column, ends: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.coalesce(F.get(items, i)["begin"] >= F.get(ends, i - 1), F.lit(True)))
        return let(starts, lambda begun: F.transform(begun, lambda i, k: F.slice(
            items, i + 1, F.coalesce(F.get(begun, k + 1), F.size(items)) - i)))

    def first_of(group: Column) -> Column:
        return F.when(F.size(group) == 1, group).otherwise(F.aggregate(group, none, lambda kept, s: F.when(
            s["begin"] < F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(-1)), kept).otherwise(F.concat(kept, F.array(s)))))

    def cut(chars: Column, kept: Column) -> Column:
        piece = lambda begin, end: F.array_join(F.slice(chars, (begin + 1).cast("int"), (end - begin).cast("int")), "")
        parts = F.transform(kept, lambda s, i: F.concat(
            piece(F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)), s["begin"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        last = F.element_at(kept, -1)["end"]
        return F.concat(F.array_join(parts, ""), piece(last, F.size(chars)))

    def replaced(items: Column) -> Column:
        ends = scan(_ends(items), F.greatest)
        kept = F.flatten(F.transform(let(ends, lambda e: grouped(items, e)), first_of))
        return let(kept, lambda k: let(F.split(text, ""), lambda chars: cut(chars, k)))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, replaced))
