"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule rejects a text. A document is judged by one conditional chain: the first rule that rejects
ends it. A sample tells what each rule costs and rejects; rules with more rejections per second come
first. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
Rule = Callable[[Column, Column], Column]

#: Characters of a text in the sample that orders the rules.
SAMPLE_LENGTH = 20_000

_INDEX_BITS = 23
_INDEX = (1 << _INDEX_BITS) - 1


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def symbols_of(text: Column) -> Column:
    """How many characters of #*$%&|<> a text has."""
    return F.size(F.split(F.coalesce(text, F.lit("")), "[#*$%&|<>]", -1)) - 1


def dup_lines_of(text: Column) -> Column:
    lines = lines_of(text)
    return F.size(lines) - F.size(F.array_distinct(lines))


def letters_of(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}]+", ""))


def _windows(words: Column) -> Column:
    """64-bit names of all windows of three words."""
    last = F.size(words) - 3
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _covered(places: Column) -> Column:
    """Words covered by windows of three words at these rising places."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where filters are moved below projections."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words_of(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more.

    Windows are sorted as numbers: 41 bits of their name and 23 of their place. Where two names share
    the 41 bits only, or places need more than 23, the sort takes whole names instead.
    """
    high = lambda x: F.shiftright(x, _INDEX_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_INDEX)).cast("int")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))

    def places(names: Column, twins: Column) -> Column:
        mixed = F.exists(
            F.sequence(F.lit(0), F.size(twins) - 1),
            lambda i: same(high(F.get(twins, i)), high(F.get(twins, i + 1)))
            & (F.get(names, place(F.get(twins, i))) != F.get(names, place(F.get(twins, i + 1)))),
        )
        exact = let(
            F.sort_array(F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("place")))),
            lambda pairs: F.transform(
                F.filter(pairs, lambda x, i: same(x["name"], F.get(pairs, i + 1)["name"]) | same(x["name"], F.get(pairs, i - 1)["name"])),
                lambda x: x["place"]),
        )
        return F.sort_array(F.when(mixed | (F.size(names) > _INDEX), exact).otherwise(F.transform(twins, place)))

    def covered(names: Column) -> Column:
        packed = F.sort_array(F.transform(names, lambda x, i: x.bitwiseAND(F.lit(~_INDEX)).bitwiseOR(i.cast("long"))))
        twins = let(packed, lambda both: F.filter(
            both, lambda x, i: same(high(x), high(F.get(both, i + 1))) | same(high(x), high(F.get(both, i - 1)))))
        return let(twins, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(let(places(names, t), _covered)))

    return let(_windows(words), covered)


#: Rejecting conditions on a text that is not null and its words, beside the base ones.
RULES: Mapping[str, Rule] = {
    "short_words": lambda text, words: _word_chars(words) < 2 * F.size(words),
    "long_words": lambda text, words: _word_chars(words) > 12 * F.size(words),
    "symbols": lambda text, words: 10 * symbols_of(text) > F.size(words),
    "few_letters": lambda text, words: 100 * letters_of(text) < 60 * _word_chars(words),
    "repeated_lines": lambda text, words: 100 * dup_lines_of(text) > 30 * F.size(lines_of(text)),
}


def _word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def rule_order(docs: DataFrame, text_column: str = "text", sample_rows: int = 2000, rules: Mapping[str, Rule] | None = None) -> list[str]:
    """Rule names by rejections per second on a sample of about `sample_rows` texts of at most SAMPLE_LENGTH characters.

    Every task draws its own share and writes it, so no text goes through an exchange or the driver.
    """
    rules = RULES if rules is None else rules
    text = docs.select(F.col(text_column).alias("text"))
    share = min(1.0, sample_rows / max(1, text.count()))
    short = F.coalesce(F.length("text") <= SAMPLE_LENGTH, F.lit(True))
    sample = materialize(text.sample(share, seed=0).where(short), "quality-sample")
    gain = {}
    for name, rule in rules.items():
        seconds = []
        for _ in range(2):  # the first run compiles
            begun = time.perf_counter()
            rejects = let(words_of(F.col("text")), lambda words: rule(F.col("text"), words))
            rejected = sample.agg(F.count_if(rejects).alias("n")).first()["n"]
            seconds.append(time.perf_counter() - begun)
        gain[name] = rejected / min(seconds)
    return sorted(gain, key=lambda name: (-gain[name], name))


def passes(text: Column, words: Column, order: list[str], rules: Mapping[str, Rule] | None = None) -> Column:
    """False as soon as one rule rejects the text; later rules are then not evaluated."""
    rules = RULES if rules is None else rules
    chain = F
    for name in order:
        chain = chain.when(rules[name](text, words), False)
    return F.lit(True) if chain is F else chain.otherwise(True)


def measure_quality(
    docs: DataFrame, order: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text",
    least_words: int = 50, most_repeat_percent: int = 50,
) -> DataFrame:
    """One row per document: id, base measures, base_failed and kept.

    base_failed: fewer than `least_words` words, or more than `most_repeat_percent` percent of them in
    repeated windows. kept: base passed and no rule of the cascade rejects. Null text: no words, so
    base fails. Null ids and repeated rows are rows like others; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    order = rule_order(docs, text_column) if order is None else order
    df = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.select(
        "_id", "_text", "_words", F.size("_words").cast("long").alias("n_words"),
        _word_chars(F.col("_words")).cast("long").alias("word_chars"),
        symbols_of(F.col("_text")).cast("long").alias("n_symbols"),
        dup_lines_of(F.col("_text")).cast("long").alias("n_dup_lines"),
        repeat_words_of(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(passes(F.col("_text"), F.col("_words"), order)).alias("kept"),
    )


def quality_filter(
    docs: DataFrame, order: list[str] | None = None, text_column: str = "text", least_words: int = 50, most_repeat_percent: int = 50,
) -> DataFrame:
    """The documents that pass, with all their columns. The first condition that rejects a text ends the work on it."""
    order = rule_order(docs, text_column) if order is None else order
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.where(let(words_of(text), lambda words: (
        F.when(F.size(words) < least_words, False)
        .when(~passes(text, words, order), False)
        .otherwise(100 * repeat_words_of(words) <= most_repeat_percent * F.size(words))
    )))
