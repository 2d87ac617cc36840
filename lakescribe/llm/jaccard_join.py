"""N-gram Jaccard join: documents whose word shingles agree to 80 percent, by PartEnum signatures.

1. Documents of equal shingle sets form a class; its smallest id stands for it from here on. A filter
   of these ids keeps copies from offering signatures.
2. Signatures meet once, 48 bits of each; those of one document alone go. Of the others each document
   leaves out the most frequent ones, as many as `partenum.py` shows that it can. The smallest class of
   a signature leads it; all its classes join the leader's cluster, so each similar pair is in a common
   cluster.
3. Texts of cluster members alone meet in tasks, others are filtered out where they are read. A cluster
   above a bound of words is dealt into blocks, and each pair of blocks is a unit of its own. Inside a
   unit, intersections are counted by an inverted index; exact links leave it as a spanning forest,
   never as all pairs of a group.
4. Components of the forest, then of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .components import connected_components
from .key_filter import key_filter, only, passing
from .partenum import offers
from .substring_dedup import NULL_ID
from .words import find_words, mix, pieces

#: Shingles that one block of a cluster holds, about.
BLOCK_WORDS = 1_000_000


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text its distinct shingles of n words as rising names; a shorter text is one shingle."""
    words = find_words(texts, lower=True)
    first, count = words.first, words.count
    n_windows = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    total = np.concatenate(([0], np.cumsum(n_windows)))
    start = np.arange(total[-1]) - np.repeat(total[:-1] - first[:-1], n_windows)
    end = np.minimum(start + n, np.repeat(first[1:], n_windows))
    name = words.names_of(start, end)
    out = []
    for a, b in zip(total[:-1], total[1:]):
        own = np.sort(name[a:b])
        new = np.ones(b - a, dtype=bool)
        new[1:] = own[1:] != own[:-1]
        out.append(own[new])
    return out


def _outline(n: int):
    """Per document the size of its set and two 64-bit digests of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(piece.column("text"), n)
                with np.errstate(over="ignore"):
                    one = np.array([mix(s).sum() for s in sets], dtype=np.uint64)
                    two = np.array([mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum() for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), piece.column("text_name"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc", "text_name", "n_shingles", "one", "two"],
                )

    return run


def _offers(n: int, percent: int, wanted):
    """Signatures of the documents in the filter; may_drop: how many of its band each document may leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(passing(batch, "doc", wanted.value), "text"):
                docs = piece.column("doc").to_numpy(zero_copy_only=False)
                own = zip(docs.tolist(), shingle_sets(piece.column("text"), n))
                found = [(doc, *each) for doc, elements in own for each in offers(elements, percent)]
                if not found:
                    continue
                doc, band, may_drop, names = zip(*found)
                size = [len(x) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.concatenate(names) >> np.uint64(16)).view(np.int64)), pa.array(np.repeat(doc, size), pa.int64()),
                     pa.array(np.repeat(band, size), pa.int32()), pa.array(np.repeat(may_drop, size), pa.int32())],
                    ["signature", "doc", "band", "may_drop"],
                )

    return run


def _forest(docs: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (document, smallest linked document) that span all links of a unit.

    sides: 0 in the first block of the unit, 1 in the second, 2 where both are the same block.
    """
    order = np.argsort(docs, kind="stable")
    docs, sides, sets = docs[order], sides[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    by_name = np.argsort(flat, kind="stable")
    flat, owner = flat[by_name], owner[by_name]
    head = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    length = np.diff(np.append(head, len(flat)))
    shared = length > 1
    names, head, length = flat[head][shared], head[shared], length[shared]
    root = np.arange(len(sets))
    for i in np.flatnonzero(sides != 1):
        at = np.searchsorted(names, sets[i])
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[i])] if len(names) else at[:0]
        if 100 * len(at) < percent * size[i]:
            continue  # too few of its shingles are anywhere else
        spans = length[at]
        where = np.repeat(head[at] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.bincount(owner[where], minlength=len(sets))
        linked = 100 * common >= percent * (size + size[i] - common)
        linked &= (sides == 1) if sides[i] == 0 else (np.arange(len(sets)) > i)
        groups = np.unique(root[np.append(np.flatnonzero(linked), i)])
        if len(groups) > 1:
            root[np.isin(root, groups)] = groups[0]
    moved = np.flatnonzero(root != np.arange(len(sets)))
    return list(zip(docs[moved].tolist(), docs[root[moved]].tolist()))


def _compare(n: int, percent: int):
    """Reads rows sorted by unit; holds one unit at a time."""
    keys = ("leader", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, docs, sides, sets = None, [], [], []

        def done():
            if len(set(docs)) > 1:
                return _forest(np.array(docs), np.array(sides), sets, percent)
            return []

        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                rows = zip(*(piece.column(c).to_pylist() for c in (*keys, "doc", "block")), shingle_sets(piece.column("text"), n))
                for leader, left, right, doc, block, own in rows:
                    if (leader, left, right) != unit:
                        out += done()
                        unit, docs, sides, sets = (leader, left, right), [], [], []
                    docs.append(doc), sets.append(own)
                    sides.append(2 if left == right else int(block == right))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def _links(source: DataFrame, firsts: DataFrame, n: int, percent: int, block_words: int) -> DataFrame:
    """Edges that span the links between classes; firsts: (doc, n_shingles) of each class."""
    offered = source.mapInArrow(
        _offers(n, percent, key_filter(firsts, "doc")), "signature long, doc long, band int, may_drop int")
    all_of = Window.partitionBy("signature")
    shared = materialize(
        offered.withColumns({"n": F.count(F.lit(1)).over(all_of), "one": F.min("doc").over(all_of), "last": F.max("doc").over(all_of)})
        .where("one < last").drop("one", "last"), "offers"
    )
    # documents of one id count as one here; what they leave out together each of them may leave out
    of_doc = Window.partitionBy("doc", "band")
    place = F.row_number().over(of_doc.orderBy(F.desc("n"), "signature"))
    kept = materialize(
        shared.withColumns({"place": place, "may_drop": F.min("may_drop").over(of_doc)})
        .where("place > may_drop").select("signature", "doc"), "offers"
    )
    leaders = kept.groupBy("signature").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"))
    members = (
        kept.join(leaders.where("leader < last").drop("last"), "signature")
        .groupBy("leader", "doc").agg(F.count(F.lit(1)).alias("n")).join(firsts.select("doc", "n_shingles"), "doc")
        .select("leader", "doc", "n_shingles")
    )
    members = materialize(members, "members")
    blocks = members.groupBy("leader").agg(
        F.ceil(F.sum("n_shingles") / block_words).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = members.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("other", other).select(
        "leader", "doc", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    texts = only(source, "doc", key_filter(members, "doc")).join(units, "doc").select("leader", "left", "right", "block", "doc", "text")
    return (
        texts.repartition("leader", "left", "right").sortWithinPartitions("leader", "left", "right")
        .mapInArrow(_compare(n, percent), "a long, b long")
    )


def jaccard_groups(
    docs: DataFrame, percent: int = 80, n: int = 5, id_column: str = "doc_id", text_column: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, copy_of (its class) and text_name (xxhash64 of the text).

    A document's set: the distinct runs of n words of its text with A-Z as a-z; a shorter text is one
    run of all its words. Two documents link when 100 * intersection >= percent * union. component_id
    is the smallest id reachable by links, its own included; copy_of the smallest id of the same set.

    Null text or no word: empty set, no links. Null id: the smallest id. Empty table: no rows. Other
    columns are ignored. Rows that repeat an id are documents of their own with that id.
    """
    source = docs.select(F.coalesce(F.col(id_column), F.lit(NULL_ID)).alias("doc"), F.col(text_column).alias("text"))
    outline = materialize(
        source.withColumn("text_name", F.xxhash64("text"))
        .mapInArrow(_outline(n), "doc long, text_name long, n_shingles long, one long, two long"), "sets"
    )
    classes = materialize(
        outline.where("n_shingles > 0").groupBy("one", "two").agg(F.min("doc").alias("copy_of"), F.max("n_shingles").alias("n")),
        "classes",
    )
    firsts = classes.groupBy(F.col("copy_of").alias("doc")).agg(F.max("n").alias("n_shingles"))
    links = _links(source, firsts, n, percent, block_words)
    groups = connected_components(links, "a", "b")
    named = outline.join(classes.drop("n"), ["one", "two"], "left").withColumn("copy_of", F.coalesce("copy_of", "doc"))
    return named.join(groups.withColumnRenamed("node", "copy_of"), "copy_of", "left").select(
        F.nullif("doc", F.lit(NULL_ID)).alias(id_column), "n_shingles",
        F.nullif(F.coalesce("component", "copy_of"), F.lit(NULL_ID)).alias("component_id"),
        F.nullif("copy_of", F.lit(NULL_ID)).alias("copy_of"), "text_name",
    )
