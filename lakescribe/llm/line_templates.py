"""Line dedup by a log-template tree: lines of recurring templates leave all documents but the first.

The tree has a fixed depth: the number of tokens, then the leading tokens; tokens with a digit are
variable fields. What a leaf holds is generalised by position: a token stays part of the template if
enough of the leaf's lines have it there, else its place is a field. A template recurs if enough
different texts have it; copies of one text count once, so copies alone make nothing recur.

Lines are counted by name, in map tasks first. Tokens are looked at for one example of each different
line of a frequent leaf. Each text moves once, to meet its own line numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .substring_dedup import NULL_ID
from .words import Words, find_words, mix, pieces

FIELD = np.uint64(0x5BD1E9955BD1E995)  #: the name of every variable field
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """Lines of a few documents that hold a token; line i of document d is first[d] + i."""

    def __init__(self, words: Words, lead: int) -> None:
        raw = words.raw
        digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
        self.token = np.where(digits[words.end] > digits[words.start], FIELD, words.name)
        breaks = np.flatnonzero(raw == 10)
        before = np.searchsorted(breaks, words.start)  # line breaks in front of a word, over all documents
        doc = np.repeat(np.arange(len(words.first) - 1), words.count)
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(doc))
        self.doc = doc[self.start]
        self.first = np.searchsorted(self.doc, np.arange(len(words.first)))
        self._before = before[self.start]
        n = (self.end - self.start).astype(np.uint64)
        self.leaf = mix(n)
        for k in range(lead):
            at = np.minimum(self.start + k, len(doc) - 1)
            self.leaf = mix(self.leaf * _STEP + np.where(n > k, self.token[at], np.uint64(k)))
        words.name = self.token
        self.literal = words.names_of(self.start, self.end)

    def number(self, d: int, text_start: int, breaks: np.ndarray) -> np.ndarray:
        """Line numbers within document d, whose text starts at this byte."""
        own = self._before[self.first[d]: self.first[d + 1]]
        return own - np.searchsorted(breaks, text_start)


def _texts_at(texts: pa.Array) -> np.ndarray:
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes)))


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    at = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat).cast(kind))


def _outline(lead: int):
    """Per document the numbers of its lines, their leaves and their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = find_words(piece.column("text"))
                lines, at = Lines(words, lead), _texts_at(piece.column("text"))
                breaks, spans = np.flatnonzero(words.raw == 10), list(zip(lines.first[:-1], lines.first[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc"), piece.column("text_name"),
                        _lists([lines.number(d, at[d], breaks) for d in range(piece.num_rows)], pa.int32()),
                        _lists([lines.leaf[a:b].view(np.int64) for a, b in spans], pa.int64()),
                        _lists([lines.literal[a:b].view(np.int64) for a, b in spans], pa.int64()),
                    ],
                    ["doc", "text_name", "number", "leaf", "literal"],
                )

    return run


def _tokens(lead: int):
    """Tokens of the wanted lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines = Lines(find_words(piece.column("text")), lead)
                out = []
                for d, wanted in enumerate(piece.column("wanted").to_pylist()):
                    a, b = lines.first[d], lines.first[d + 1]
                    where = {int(x): i for i, x in zip(range(b - 1, a - 1, -1), lines.literal[a:b][::-1].view(np.int64))}
                    for want in wanted:
                        if (i := where.get(want["literal"])) is not None:
                            out.append((want["leaf"], want["literal"], want["texts"], want["total"],
                                        lines.token[lines.start[i]: lines.end[i]].view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([r[i] for r in out], pa.int64()) for i in range(4)], _lists([r[4] for r in out], pa.int64())],
                        ["leaf", "literal", "texts", "total", "tokens"],
                    )

    return run


def _generalised(lines: DataFrame, least_texts: int, least_share: int, least_fixed: int) -> DataFrame:
    """(leaf, literal, template) of lines whose template recurs; lines: leaf, literal, texts, total, tokens."""
    keys = ["leaf", "place", "token"]
    each = lines.select("leaf", "literal", "texts", "total", F.posexplode("tokens").alias("place", "token"))
    fixed = (
        each.groupBy(*keys).agg(F.sum("texts").alias("n"), F.max("total").alias("total"))
        .where((F.col("n") >= least_texts) & (100 * F.col("n") >= least_share * F.col("total"))).select(*keys)
    )
    fixed = fixed.where(F.col("token") != F.lit(int(FIELD.view(np.int64))))
    templates = (
        each.join(fixed.withColumn("fixed", F.lit(True)), keys, "left")
        .groupBy("leaf", "literal").agg(  # the tokens of one line come together again
            F.max("texts").alias("texts"), F.count(F.lit(1)).alias("n"), F.count("fixed").alias("n_fixed"),
            F.xxhash64(F.sort_array(F.collect_list(F.when(F.col("fixed"), F.struct("place", "token"))))).alias("template"))
        .where(100 * F.col("n_fixed") >= least_fixed * F.col("n"))
    )
    recurring = templates.groupBy("leaf", "template").agg(F.sum("texts").alias("n")).where(F.col("n") >= least_texts)
    return templates.join(recurring.drop("n"), ["leaf", "template"]).select("leaf", "literal", "template")


def line_dedup(
    docs: DataFrame, least_texts: int = 6, lead: int = 4, least_share: int = 30, least_fixed: int = 70,
    id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_lines, n_removed, kept_text and the input columns named by `keep`.

    Leaves: token count and the first `lead` tokens. A token is fixed in its place if at least
    `least_texts` lines and `least_share` percent of the leaf's lines have it there (a line counts once
    per text). A template recurs with at least `least_fixed` percent fixed tokens and `least_texts`
    texts; so does any line that `least_texts` texts have, digits aside. Such lines go from all
    documents but the one of the smallest id that has the template. n_lines counts lines with a token;
    others are never removed.

    Null text: stays null, no lines. Null id: the smallest id. Empty table: no rows. Rows that repeat
    id and text get the same result; rows that share an id only are separate documents, which all
    count as the first if their id is.
    """
    source = docs.select(
        F.coalesce(F.col(id_column), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col(text_column)).alias("text_name"),
        F.col(text_column).alias("text"), *([F.struct(*keep).alias("_kept")] if keep else []),
    )
    outline = materialize(source.select("doc", "text_name", "text").mapInArrow(
        _outline(lead), "doc long, text_name long, number array<int>, leaf array<long>, literal array<long>"), "lines")
    each = outline.select("doc", "text_name", F.explode(F.arrays_zip("number", "leaf", "literal")).alias("l")).select(
        "doc", "text_name", "l.*")
    counted = (
        each.groupBy("text_name", "leaf", "literal").agg(F.min("doc").alias("doc"))
        .groupBy("leaf", "literal").agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("doc"))
    )
    counted = materialize(counted, "line-counts")
    leaves = counted.groupBy("leaf").agg(F.sum("texts").alias("total"), F.count(F.lit(1)).alias("n"))
    open_leaves = leaves.where((F.col("total") >= least_texts) & (F.col("n") > 1)).drop("n")
    wanted = counted.join(open_leaves, "leaf").groupBy("doc").agg(
        F.collect_list(F.struct("leaf", "literal", "texts", "total")).alias("wanted"))  # lines of one document
    examples = source.select("doc", "text_name", "text").join(wanted, "doc").select("text", "wanted")
    tokens = materialize(
        examples.mapInArrow(_tokens(lead), "leaf long, literal long, texts long, total long, tokens array<long>"), "tokens")
    # rows that share an id can both have the line that is wanted
    tokens = tokens.dropDuplicates(["leaf", "literal"])
    found = materialize(_generalised(tokens, least_texts, least_share, least_fixed), "templates")

    # a line's template is the generalised one where that recurs, else the line itself
    own = counted.join(found, ["leaf", "literal"], "left").where(F.col("template").isNotNull() | (F.col("texts") >= least_texts))
    own = own.select("leaf", "literal", F.coalesce("template", "literal").alias("template"), "doc")
    first = own.groupBy("leaf", "template").agg(F.min("doc").alias("first_doc"))
    own = own.drop("doc").join(first, ["leaf", "template"]).select("leaf", "literal", "first_doc")
    gone = (
        each.join(own, ["leaf", "literal"]).where("doc <> first_doc")
        .groupBy("doc", "text_name").agg(F.collect_set("number").alias("gone"))  # lines of one document
    )
    sizes = outline.select("doc", "text_name", F.size("number").cast("long").alias("n_lines")).distinct()
    left = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    joined = source.join(sizes.join(gone, ["doc", "text_name"], "left"), ["doc", "text_name"], "left")
    return joined.select(
        F.nullif("doc", F.lit(NULL_ID)).alias(id_column), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("kept_text"),
        *[F.col("_kept")[c].alias(c) for c in keep],
    )
