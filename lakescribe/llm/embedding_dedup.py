"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

1. Equal vectors are one, with a count of copies.
2. Centroids are fitted on a bounded sample; every vector is at home in the cell of its closest
   centroid and a guest where a link could cross the border of two cells, so no link is lost (`reach`).
3. Cells are dealt into blocks of bounded rows; each pair of blocks is one product, without guests
   against guests. A pair that meets in two cells is counted in one. Links leave a block as counts and
   as a spanning forest.
4. Components of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .components import connected_components
from .substring_dedup import NULL_ID

#: Bounds: cells, rows of the sample per cell, rows of a block.
MOST_CELLS, SAMPLE_PER_CELL, BLOCK_ROWS = 1024, 64, 8192


def is_usable(vector: Column) -> Column:
    """Not null, nothing null or infinite in it, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component first, against overflow."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def spherical_k_means(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows. The start is rows far from those taken before."""
    rows = sample[np.lexsort(sample.T)]
    best = rows @ rows[0]
    chosen = [0]
    while len(chosen) < min(cells, len(rows)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        cell = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def reach(least: float) -> float:
    """Half the length of the longest link between unit vectors, with room for rounding.

    For x at home with centroid c and y with d, x.(c - d) >= 0 >= y.(c - d); the two differ by at most
    |x - y| |c - d|. So one of them lies within half of that from the border: x with
    x.d >= x.c - reach |c - d|, or y likewise. It is a guest of the other's home.
    """
    return float(np.sqrt(max(0.0, 2 - 2 * least)) / 2) + 1e-6


def _assign(shared, least: float):
    width = reach(least)
    gaps = {}  # of each length: reach times the distances between the centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vector"))
            for dim in sizes.unique().to_pylist():
                own = batch.filter(pa.compute.equal(sizes, dim))
                near = unit_rows(_matrix(own.column("vector"))) @ shared.value[dim].T if dim in shared.value else np.ones((own.num_rows, 1))
                home, top = near.argmax(axis=1), near.max(axis=1)
                if dim in shared.value and dim not in gaps:
                    centroids = shared.value[dim]
                    gaps[dim] = width * np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0)) + 1e-9
                row, cell = np.nonzero(near >= top[:, None] - (gaps[dim][home] if dim in gaps else 0))
                starts = np.searchsorted(row, np.arange(own.num_rows + 1))
                probes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(cell, pa.int32()))
                taken = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(row), pa.int32()), pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()),
                     probes.take(pa.array(row)), taken.column("id"), taken.column("copies"), taken.column("vector")],
                    ["dim", "cell", "home", "probes", "id", "copies", "vector"])

    return run


def _probes(probes: pa.ListArray, cells: np.ndarray) -> np.ndarray:
    """Whether row i probes cells[j]."""
    out = np.zeros((len(probes), len(cells)), dtype=bool)
    flat = probes.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(probes)), pa.compute.list_value_length(probes).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
    hit = cells[at] == flat
    out[row[hit], at[hit]] = True
    return out


def _linked(units: np.ndarray, narrow: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right with a cosine of `least` or more: found in single, judged in double precision."""
    room = 1e-5 + units.shape[1] * 2.0**-22
    step = max(1, (1 << 21) // max(1, len(right)))
    other, found = narrow[right].T, []
    for a in range(0, len(left), step):
        i, j = np.nonzero(narrow[left[a: a + step]] @ other >= least - room)
        found.append((left[a + i], right[j]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (left[:0], right[:0])
    keep = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 1 << 14):
        part = slice(a, a + (1 << 14))
        keep[part] = np.einsum("ij,ij->i", units[i[part]], units[j[part]]) >= least
    return i[keep], j[keep]


def _block_links(cell: int, rows: pa.Table, same: bool, right_block: int, least: float) -> list[tuple[int, int, int]]:
    """(id, smallest linked id here, vectors linked) for rows of one unit; same: its two blocks are one."""
    rows = rows.sort_by("id").combine_chunks()
    ids, copies, home, block = (rows.column(c).to_numpy() for c in ("id", "copies", "home", "block"))
    units = unit_rows(_matrix(rows.column("vector").combine_chunks()))
    everyone = np.arange(len(rows))
    left, right = (everyone, everyone) if same else (np.flatnonzero(block != right_block), np.flatnonzero(block == right_block))
    i, j = _linked(units, units.astype(np.float32), left, right, least)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    # one of the two is at home here; if both cells see the pair, the smaller one counts it
    homes = np.unique(home)
    probes, at_home = _probes(rows.column("probes").combine_chunks(), homes), home == cell
    guest, host = np.where(at_home[i], j, i), np.where(at_home[i], i, j)
    both = at_home[i] & at_home[j]
    elsewhere = probes[host, np.searchsorted(homes, home[guest])] & (home[guest] < cell)
    keep = both | (at_home[host] & ~at_home[guest] & ~elsewhere)
    i, j = i[keep], j[keep]
    total = np.bincount(i, weights=copies[j], minlength=len(rows)).astype(np.int64)
    total += np.bincount(j, weights=copies[i], minlength=len(rows)).astype(np.int64)
    root = np.arange(len(rows))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for k, linked in zip(i[starts], np.split(j, starts[1:])) if len(i) else ():
        groups = np.unique(root[np.append(linked, k)])
        if len(groups) > 1:
            root[np.isin(root, groups)] = groups[0]
    return [(int(ids[k]), int(ids[root[k]]), int(total[k])) for k in np.flatnonzero(total)]


def _compare(least: float):
    """Reads rows sorted by unit (dim, cell, left, right); holds the rows of one unit."""
    keys = ("dim", "cell", "left", "right")

    def out(unit, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held) if held else []
        if len(rows) > 1 and (links := _block_links(unit[1], rows, unit[2] == unit[3], unit[3], least)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["id", "root", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                if (own := tuple(key[a].tolist())) != unit:
                    yield from out(unit, held)
                    unit, held = own, []
                held.append(batch.slice(a, b - a))
        yield from out(unit, held)

    return run


def embedding_groups(
    vectors: DataFrame, least: float = 0.95, cell_rows: int = 2000,
    id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Linked are vectors of one length with a cosine of `least` or more, in double precision. Cells hold
    about `cell_rows` different vectors, MOST_CELLS at most; they save comparisons and lose no link.
    component_id: the smallest id reachable by links, its own included; kept: it is its own.

    Vectors that are null, all zero, or hold a null or non-finite component link with nothing. Null
    id: the smallest id, returned as null; it is kept if its component has no other id. Rows that
    repeat id and vector are copies; rows that share an id only are one node whose links add up.
    Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.coalesce(F.col(id_column), F.lit(NULL_ID)).alias("id"), F.col(vector_column).alias("vector"))
    named = source.select("id", "vector", is_usable(F.col("vector")).alias("usable")).withColumn(
        "one", F.when(F.col("usable"), F.xxhash64("vector"))).withColumn("two", F.when(F.col("usable"), F.hash("vector")))
    classes = materialize(
        named.where("usable").groupBy("one", "two").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = named.where("usable").join(classes, ["one", "two"]).where("id = first").dropDuplicates(["one", "two"])
    firsts = materialize(firsts.select("id", "copies", "vector"), "vectors")

    models = {}
    for r in firsts.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect():
        cells = min(MOST_CELLS, max(1, round(r["n"] / cell_rows)))
        share = min(1.0, cells * SAMPLE_PER_CELL * 4 / r["n"])
        sample = firsts.where((F.size("vector") == r["dim"]) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        rows = sample.select("vector").limit(cells * SAMPLE_PER_CELL * 8).toArrow().column("vector").combine_chunks()
        if len(rows):
            models[r["dim"]] = spherical_k_means(unit_rows(_matrix(rows)), cells)
    shared = spark.sparkContext.broadcast(models)  # 16 models of MOST_CELLS rows at most

    schema = "dim int, cell int, home int, probes array<int>, id long, copies long, vector {}".format(
        vectors.schema[vector_column].dataType.simpleString())
    placed = materialize(firsts.mapInArrow(_assign(shared, least), schema), "cells")
    at_home = F.col("home") == F.col("cell")
    blocks = placed.groupBy("dim", "cell").agg(*[
        F.ceil(F.count_if(which) / block_rows).cast("int").alias(name) for which, name in ((at_home, "blocks"), (~at_home, "guest_blocks"))])
    placed = placed.join(blocks, ["dim", "cell"])
    # blocks of vectors at home meet all blocks, blocks of guests those only; guests come last
    name = F.xxhash64("vector")
    placed = placed.withColumn(
        "block", F.when(at_home, F.pmod(name, "blocks")).otherwise(F.col("blocks") + F.pmod(name, "guest_blocks")).cast("int")
    ).withColumn("others", F.col("blocks") + F.when(at_home, F.col("guest_blocks")).otherwise(0)).where("others > 0").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    units = placed.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    keys = ["dim", "cell", "left", "right"]
    links = materialize(
        units.repartition(*keys).sortWithinPartitions(*keys)
        .select(*keys, "block", "home", "probes", "id", "copies", "vector").mapInArrow(_compare(least), "id long, root long, n long"),
        "links")
    counts = links.groupBy(F.col("id").alias("first")).agg(F.sum("n").alias("others"))
    groups = connected_components(links, "id", "root").withColumnRenamed("node", "first")
    joined = named.drop("vector").join(classes, ["one", "two"], "left").join(counts, "first", "left").join(groups, "first", "left")
    component = F.coalesce("component", "first", "id")
    return joined.select(
        F.nullif("id", F.lit(NULL_ID)).alias(id_column),
        (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (F.col("id") == component).alias("kept"),
    )
