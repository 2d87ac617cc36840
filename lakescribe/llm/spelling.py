"""Spelling variant grouping: generated edits, probed against broadcast Bloom filters, then joined exactly.

1. The vocabulary: words of all texts with their number of occurrences.
2. A blocked Bloom filter for every word length: a word sets one bit in each of the eight lanes of one
   block. Tasks set bits, Spark joins the blocks by OR, and the filters are broadcast. Their size is bounded:
   what does not fit into FILTER_BYTES is dealt by word name into parts, one pass each.
3. Every word's edits are generated as names (a rolling sum changes by two terms per edit) and probed.
   A pair of words is generated once: a deletion from the longer one, a replacement from the one with
   the smaller code point.
4. Only positives leave as strings; an equi-join with the vocabulary removes the false ones.
5. Words follow their near word of largest count to a root by pointer doubling.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .words import mix

LETTERS = "A-Za-zÀ-ÿ"
#: Bytes of the filters of one pass; words a block of 256 bits; length from which words share a shard.
FILTER_BYTES, BLOCK_WORDS, LONG = 64 << 20, 16, 48
#: Words a block of the shard of long words, which have many more edits each.
LONG_BLOCK_WORDS = 4
#: Elements of the arrays of one step; words that one task probes.
STEP, TASK_WORDS = 1 << 20, 1 << 15
_BASE, _LENGTH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd numbers; any would do
_LANES = np.random.default_rng(20260101).integers(0, 1 << 31, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def vocabulary(
    docs: DataFrame, least_length: int = 7, least_count: int = 2, id_column: str = "doc_id", text_column: str = "text",
    spelled: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): the longest runs of letters, A-Z lower-cased, of least_length and least_count at least.

    spelled(id, run): another spelling of a run; its result is counted instead. Null text: no words.
    Every row counts, repeated ones too; an empty table gives an empty vocabulary.
    """
    runs = docs.select(
        F.col(id_column).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_column), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    run = lower_ascii(F.col("run"))
    words = runs.select((spelled(F.col("id"), run) if spelled else run).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class _Names:
    """Names of equally long words and of their edits, 64 bits each."""

    def __init__(self, words: list[str]) -> None:
        self.length = len(words[0])
        self.codes = np.array(words, dtype=f"<U{self.length}").view(np.uint32).reshape(len(words), self.length)
        self.powers = np.full(self.length + 1, _BASE, dtype=np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.terms = self.value(self.codes) * self.powers[:-1]
        self.sums = self.terms.sum(axis=1)

    @staticmethod
    def value(codes: np.ndarray) -> np.ndarray:
        return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))

    @staticmethod
    def _name(sums: np.ndarray, length: int) -> np.ndarray:
        return mix(sums + np.uint64((length * _LENGTH) % (1 << 64)))

    def own(self) -> np.ndarray:
        return self._name(self.sums, self.length)

    def deletions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, name) of all words with a letter less; of a run of equal letters one deletion."""
        ends = np.cumsum(self.terms, axis=1)
        behind = (self.sums[:, None] - ends) * np.uint64(pow(_BASE, -1, 1 << 64))
        fresh = np.ones(self.codes.shape, dtype=bool)
        fresh[:, 1:] = self.codes[:, 1:] != self.codes[:, :-1]
        row, place = np.nonzero(fresh)
        return row, place, self._name((ends - self.terms + behind)[row, place], self.length - 1)

    def replacements(self, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place, letter, name) of all words with a larger letter at one place, in steps."""
        values = self.value(alphabet)
        width = max(1, STEP // max(1, len(self.codes) * len(alphabet)))
        for at in range(0, self.length, width):
            part = slice(at, min(at + width, self.length))
            row, place, letter = np.nonzero(alphabet > self.codes[:, part, None])
            place += at
            sums = self.sums[row] - self.terms[row, place] + values[letter] * self.powers[place]
            yield row, place, letter, self._name(sums, self.length)


def _shard(length: int) -> int:
    return min(length, LONG)


def _place(names: np.ndarray, blocks: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(names: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane, 0 to 31, from the lower half of the names."""
    return (((names & np.uint64(0xFFFFFFFF)) * _LANES[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


def _found(names: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Indexes of the names that may be in a filter; a name leaves at the first lane that lacks its bit."""
    block = _place(names, len(lanes)).astype(np.int64)
    left = np.arange(len(names))
    for lane in range(8):
        bits = lanes[block[left], lane] >> _bit(names[left], lane).astype(np.uint32)
        left = left[(bits & 1).astype(bool)]
    return left


def _same_lengths(words: list[str], alphabet: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(indexes, words) of equal length, in steps of bounded size."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        width = max(1, STEP // (int(length) * max(1, alphabet)) * 8)
        for a in range(0, len(rows), width):
            yield rows[a: a + width], [words[i] for i in rows[a: a + width]]


def _set_bits(blocks: dict[int, int], parts: int, part: int):
    """Words as (shard, block, four numbers of two lanes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _same_lengths([w for w in batch.column("word").to_pylist() if w], 1):
                names = _Names(words).own()
                names = names[names % np.uint64(parts) == part]
                shard = _shard(len(words[0]))
                lanes = [np.uint64(1) << (_bit(names, k) + np.uint64(32 * (k % 2))) for k in range(8)]
                made = [pa.array((lanes[k] | lanes[k + 1]).view(np.int64)) for k in range(0, 8, 2)]
                place = pa.array(_place(names, blocks[shard]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), shard, np.int32)), place, *made], ["shard", "block", "a", "b", "c", "d"])

    return run


def _probe(filters, alphabet: np.ndarray, parts: int, part: int):
    """(word, n, other) for edits that may be words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = filters.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n")
            for rows, group in _same_lengths(words, len(alphabet)):
                made, of = [], []
                edits = _Names(group)

                def hits(names: np.ndarray, length: int) -> np.ndarray:
                    if _shard(length) not in lanes:
                        return np.zeros(0, np.int64)
                    own = np.flatnonzero(names % np.uint64(parts) == part) if parts > 1 else np.arange(len(names))
                    return own[_found(names[own], lanes[_shard(length)])]

                row, place, names = edits.deletions()
                for k in hits(names, edits.length - 1):
                    word, i = group[row[k]], place[k]
                    made.append(word[:i] + word[i + 1:])
                    of.append(row[k])
                for row, place, letter, names in edits.replacements(alphabet):
                    for k in hits(names, edits.length):
                        word, i = group[row[k]], place[k]
                        made.append(word[:i] + chr(alphabet[letter[k]]) + word[i + 1:])
                        of.append(row[k])
                at = pa.array(rows[np.array(of, dtype=np.int64)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(at), counts.take(at), pa.array(made, pa.string())], ["word", "n", "other"])

    return run


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): pairs that differ by one inserted, deleted or replaced code point, each once.

    words: (word, n), every word once, read several times. Letters are replaced by all those of the
    vocabulary, so this suits alphabets. Null and empty words have no pairs.
    """
    spark = words.sparkSession
    words = words.where(F.char_length("word") > 0).select("word", "n")
    size = F.least(F.char_length("word"), F.lit(LONG)).alias("shard")
    counts = {r["shard"]: r["n"] for r in words.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}  # LONG rows at most
    letters = words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect()  # an alphabet
    alphabet = np.array(sorted(ord(r[0]) for r in letters if r[0]), dtype=np.uint32)

    whole = {shard: math.ceil(n / (LONG_BLOCK_WORDS if shard == LONG else BLOCK_WORDS)) for shard, n in counts.items()}
    # a task's work is its words, few bytes each
    probed = words.repartition(math.ceil(sum(counts.values()) / TASK_WORDS), "word") if counts else words
    parts = max(1, math.ceil(32 * sum(whole.values()) / filter_bytes))
    blocks = {shard: math.ceil(n / parts) for shard, n in whole.items()}
    found = None
    for part in range(parts):
        bits = words.select("word").mapInArrow(
            _set_bits(blocks, parts, part), "shard int, block long, a long, b long, c long, d long")
        joined = bits.groupBy("shard", "block").agg(*[F.bit_or(c).alias(c) for c in "abcd"]).toArrow()  # filter_bytes, twice
        shards, block = joined.column("shard").to_numpy(), joined.column("block").to_numpy()
        values = np.stack([joined.column(c).to_numpy() for c in "abcd"], axis=1) if len(joined) else np.zeros((0, 4), np.int64)
        lanes = {}
        for shard in np.unique(shards):
            filled = np.zeros((blocks[int(shard)], 4), dtype=np.int64)
            filled[block[shards == shard]] = values[shards == shard]
            lanes[int(shard)] = filled.view("<u4")
        shared = spark.sparkContext.broadcast(lanes)
        hits = probed.mapInArrow(_probe(shared, alphabet, parts, part), "word string, n long, other string")
        hits = materialize(hits, "edits") if parts > 1 else hits
        found = hits if found is None else found.union(hits)
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select(
        "word", "n", "other", "other_n")


def spelling_forms(words: DataFrame, ratio: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    words: (word, n), every word once, n at least 1, more columns ignored. n_near: words that differ by one
    code point. form: the near word of largest n (ties: the smallest in code-point order) if its n is ratio
    times the word's or more, else null; form_n: its n. root: where forms end, the word itself without one.
    Null words have no row. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 at least, so that counts grow from form to form")
    words = materialize(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = materialize(near_pairs(words, filter_bytes), "pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other"))).alias("best"))
    near = words.join(best, "word", "left")
    fits = -F.col("best.minus_n") >= ratio * F.col("n")
    formed = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"),
        F.when(fits, -F.col("best.minus_n")).alias("form_n")), "forms")

    # counts grow by the ratio at every step, so this many steps lead to a root
    edge = formed.agg(F.max("form_n"), F.min("n")).first()
    steps = math.floor(math.log(edge[0] / max(1, edge[1]), ratio) + 1e-9) if edge[0] else 0
    jumps = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = materialize(jumps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))
