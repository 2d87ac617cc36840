"""Substring dedup by recompression: words covered by a window that also starts earlier are removed.

1. Every document is recompressed (`recompress.elect`): rounds of global names for runs and pairs of
   words. Each window elects one symbol; equal windows elect equal symbols. About one symbol in
   eight words is left, which is all that is shuffled.
2. Documents of one word sequence are one symbol; its first document stands for all of them.
3. Symbols that two documents share, or that stand twice in one, reveal where repeats can be. Only
   texts with such symbols are looked at again: their windows are named by two independent 64-bit
   digests, counted, and the first document of each is found.

Counting aggregates in the map tasks and joins have one row per name on one side, so a passage in a
third of all documents is one row per task on one side and split by skew handling on the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .recompress import elect
from .words import Words, find_words, pieces

NULL_ID = -(1 << 63)  #: a null id counts as the smallest one
_TAG = (1 << 24) - 1  #: bits of a text's name that tell rows of one id apart
_NOTHING = hashlib.sha256(b"").hexdigest()


def _signed(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.array([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))


def _ranges(firsts: np.ndarray, words: Words) -> np.ndarray:
    """Where the windows of each document begin in the sorted array of all windows' first words."""
    return np.searchsorted(firsts, words.first)


def _outline(size: int, rounds: int):
    """Per document: word count, two names of the whole, digest, elected symbols and repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = find_words(piece.column("text"))
                first, low, name = elect(words, size, rounds)
                at, found, twice = _ranges(first, words), [], []
                for a, b in zip(at[:-1], at[1:]):
                    # one row for each place of a symbol: neighbouring windows often elect the same
                    if a == b:
                        found.append(np.zeros(0, np.int64)), twice.append(np.zeros(0, np.int64))
                        continue
                    own, place = _signed(name[a:b]), low[a:b]
                    new = np.ones(b - a, dtype=bool)
                    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1])
                    pairs = np.unique(np.stack((own[new], place[new])), axis=1)[0] if new.sum() > 1 else own[new]
                    values, counts = np.unique(pairs, return_counts=True)
                    found.append(values), twice.append(values[counts > 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc"), pa.array(words.count),
                        pa.array(_signed(words.names_of(words.first[:-1], words.first[1:]))),
                        pa.array(_signed(words.second_names_of(words.first[:-1], words.first[1:]))),
                        pa.array([hashlib.sha256(words.text_of(d)).hexdigest() for d in range(piece.num_rows)]),
                        _lists(found), _lists(twice),
                    ],
                    ["doc", "n_words", "whole", "whole2", "sha", "symbols", "repeated"],
                )

    return run


_OUTLINE = "doc long, n_words long, whole long, whole2 long, sha string, symbols array<long>, repeated array<long>"


def _candidates(piece: pa.RecordBatch, size: int, rounds: int):
    """For each document: (index, tag of its text, words, windows' first words, their two names)."""
    words = find_words(piece.column("text"))
    whole = _signed(words.names_of(words.first[:-1], words.first[1:]))
    first, _, name = elect(words, size, rounds)
    at, name = _ranges(first, words), _signed(name)
    for d, symbols in enumerate(piece.column("symbols")):
        a, b = at[d], at[d + 1]
        own = first[a:b][np.isin(name[a:b], symbols.values.to_numpy())]
        one, two = words.names_of(own, own + size), words.second_names_of(own, own + size)
        yield d, int(whole[d]) & _TAG, words, own, one, two


def _first_places(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A mask of the windows that stand for the first time in their document."""
    order = np.lexsort((np.arange(len(one)), two, one))
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    mask = np.zeros(len(one), dtype=bool)
    mask[order[new]] = True
    return mask


def _windows(size: int, rounds: int):
    """The windows that may repeat, each once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                doc = piece.column("doc").to_pylist()
                out = [[], [], [], []]
                for d, tag, words, own, one, two in _candidates(piece, size, rounds):
                    mask = _first_places(one, two)
                    n = int(mask.sum())
                    for column, values in zip(out, (
                        _signed(one[mask]), _signed(two[mask]), np.full(n, doc[d]), (own[mask] - words.first[d]) << 24 | tag,
                    )):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x), pa.int64()) for x in out], ["one", "two", "doc", "place"]
                    )

    return run


def _cut(size: int, rounds: int, with_text: bool):
    """What is left of each document; `later` are its windows that stand in earlier documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                doc, later = (piece.column(c).to_pylist() for c in ("doc", "later"))
                rows = []
                for d, tag, words, own, one, two in _candidates(piece, size, rounds):
                    gone = own[~_first_places(one, two)] - words.first[d]
                    places = np.array(later[d] or [], dtype=np.int64)
                    gone = np.concatenate((gone, places[places & _TAG == tag] >> 24))
                    steps = np.zeros(words.count[d] + 1, dtype=np.int64)
                    np.add.at(steps, gone, 1)
                    np.add.at(steps, gone + size, -1)
                    keep = np.cumsum(steps)[:-1] == 0
                    left = words.text_of(d, keep)
                    rows.append((
                        doc[d], tag, int((~keep).sum()), hashlib.sha256(left).hexdigest(),
                        left.decode() if with_text else None,
                    ))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[i] for r in rows], kind)
                        for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))
                    ],
                    ["doc", "tag", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def substring_dedup(
    docs: DataFrame, size: int = 20, rounds: int = 3, id_column: str = "doc_id", text_column: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, on request, kept_text.

    A window is `size` consecutive words of one document. Removed is each word of a window whose
    words also start earlier, in a document of a smaller id or earlier in the same one, judged on
    the input. kept_text is null where nothing was removed (the text's own words stay).

    Null text: no words. Null id: the smallest id. Empty table: no rows. Other columns are ignored.
    Rows that repeat id and text are one document and get the same result. Rows that share only
    the id are documents of the same rank: neither is earlier than the other.
    """
    source = docs.select(F.coalesce(F.col(id_column), F.lit(NULL_ID)).alias("doc"), F.col(text_column).alias("text"))
    outline = materialize(source.mapInArrow(_outline(size, rounds), _OUTLINE), "outline")
    firsts = materialize(outline.groupBy("whole", "whole2").agg(F.min("doc").alias("doc")), "firsts")
    unique = outline.join(firsts, ["whole", "whole2", "doc"], "left_semi").where("n_words >= {}".format(size))

    places = unique.select("doc", F.explode("symbols").alias("symbol"))
    shared = places.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol")
    in_one = unique.select("doc", F.explode("repeated").alias("symbol"))
    hints = places.join(shared, "symbol").select("doc", "symbol").unionByName(in_one)
    # bounded by the length of a document; rows that share an id come together here
    hints = hints.groupBy("doc").agg(F.collect_set("symbol").alias("symbols"))
    suspects = materialize(source.join(hints, "doc"), "suspects")

    columns = ["doc", "text", "symbols"]
    # read twice rather than written: the names of all windows would be the largest table here
    windows = suspects.select(columns).mapInArrow(_windows(size, rounds), "one long, two long, doc long, place long")
    earliest = windows.groupBy("one", "two").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        windows.join(earliest.drop("n"), ["one", "two"]).where("doc > first")
        .groupBy("doc").agg(F.collect_list("place").alias("later"))
    )
    cut = (
        suspects.join(later, "doc", "left").select(*columns, "later")
        .mapInArrow(_cut(size, rounds, with_text), "doc long, tag long, n_removed long, kept_sha256 string, kept_text string")
        .where("n_removed > 0").dropDuplicates(["doc", "tag"])
    )
    copy = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= size)
    result = (
        outline.drop("symbols", "repeated").withColumn("tag", F.col("whole").bitwiseAND(F.lit(_TAG)))
        .join(firsts.withColumnRenamed("doc", "first_doc"), ["whole", "whole2"])
        .join(cut, ["doc", "tag"], "left")
        .select(
            F.nullif("doc", F.lit(NULL_ID)).alias(id_column), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )
    return result if with_text else result.drop("kept_text")
