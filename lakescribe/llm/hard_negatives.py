"""Hard-negative mining: angles to reference directions bound scores; only overlapping windows are scored.

1. Vectors become whole numbers. Reference directions are fitted on a bounded sample; every row stores its
   angles to all of them and lies in the cell of its two closest ones.
2. The angle between two rows is at least the difference and at most the sum of their angles to any
   reference. Cosines of that interval times the norms bound the score, with room for rounding.
3. Rows and anchors are dealt into blocks of bounded size, large cells over several, small ones together.
   Blocks whose score interval misses what an anchor block asks for do not meet. Where blocks meet, the rows
   of a cell are sorted by their angle to its direction, so every anchor has a window of them; only windows
   are scored, in whole numbers.
4. An anchor first meets its own cell; what it finds there raises the lower end of what it asks from others.
   Positives are found so first, then negatives between the bounds that the positives set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .embedding_dedup import spherical_k_means, unit_rows

#: Bounds: reference directions, rows of the sample for each, rows of a block, anchors of a block.
MOST_REFERENCES, SAMPLE_PER_REFERENCE, BLOCK_ROWS, BLOCK_ANCHORS = 32, 256, 4096, 512
#: Lengths of vectors with fitted references; parts of the meeting of blocks.
FITTED_LENGTHS, SALTS = 16, 32
#: Room for rounding of angles (arccos of a cosine near 1 is good to 1e-8) and of scores, relative.
ROOM, SCORE_ROOM = 1e-6, 1e-9
#: Rows of this norm or longer take no part: their scores would leave 64 bits.
MOST_NORM = 2**31
_NONE = np.iinfo(np.int64).min


def whole_rows(vectors: DataFrame, id_column: str, vector_column: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, anchor, vector): usable rows with whole-number vectors."""
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(squares < float(MOST_NORM) ** 2)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _fit(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """Unit reference directions from a bounded sample of rows of one length."""
    want = max(4, min(MOST_REFERENCES, math.ceil(n / BLOCK_ROWS)))
    share = min(1.0, 4 * want * SAMPLE_PER_REFERENCE / n)
    drawn = rows.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    sample = _matrix(drawn.select("vector").limit(want * SAMPLE_PER_REFERENCE).toArrow().column("vector"))
    sample = sample[(sample != 0).any(axis=1)]
    return spherical_k_means(unit_rows(sample), want) if len(sample) else np.eye(1, dim)


def _angles(shared):
    """Rows with their angles to the references of their length, and their cell; all-zero rows have cell -1.

    Lengths without fitted references take one axis.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector"))
            for dim in sizes.unique().to_pylist():
                own = batch.filter(pc.equal(sizes, dim))
                whole = _matrix(own.column("vector")).astype(np.float64)
                norm = np.sqrt((whole * whole).sum(axis=1))
                units = whole / np.where(norm > 0, norm, 1)[:, None]
                directions = shared.value[dim] if dim in shared.value else np.eye(1, dim)
                angle = np.arccos(np.clip(units @ directions.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")
                second = order[:, min(1, order.shape[1] - 1)]
                cell = np.where(norm > 0, order[:, 0] * MOST_REFERENCES + second, -1)
                m = angle.shape[1]
                angles = pa.ListArray.from_arrays(pa.array(np.arange(len(angle) + 1) * m, pa.int32()), pa.array(angle.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("label"), own.column("anchor"), own.column("vector"), pa.array(np.full(len(angle), dim, np.int32)),
                     pa.array(cell.astype(np.int32)), pa.array(norm), angles],
                    ["id", "label", "anchor", "vector", "dim", "cell", "norm", "angles"])

    return run


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """The rows with a block of at most about `most` rows of one length: a part of a cell, or small cells together.

    Long vectors have smaller blocks. The driver sees one count per length and cell.
    """
    made, base, filled, last = [], 0, 0, None
    counts = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    for dim, cell, n in sorted((r["dim"], r["cell"], r["n"]) for r in counts.collect()):
        bound = max(16, min(most, (1 << 22) // max(1, dim)))
        if dim == last and filled + n <= bound:
            filled += n
            made.append((dim, cell, base - 1, 1))
            continue
        buckets = math.ceil(n / bound)
        made.append((dim, cell, base, buckets))
        base, filled, last = base + buckets, n if buckets == 1 else bound, dim
    numbers = rows.sparkSession.createDataFrame(made, "dim int, cell int, base int, buckets int")
    block = (F.col("base") + F.pmod(F.xxhash64("id", "vector"), F.col("buckets"))).cast("int")
    return rows.join(numbers, ["dim", "cell"]).withColumn("block", block).drop("base", "buckets")


def _extent(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per block: norms and the smallest and largest angle to every reference."""
    single = rows.select("*", F.posexplode("angles").alias("k", "angle")).groupBy("dim", "block", "k").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"), *more)
    names = [c for c in single.columns if c not in ("dim", "block", "k", "low", "high")]
    ends = F.transform(F.array_sort(F.collect_list(F.struct("k", "low", "high"))), lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))
    return single.groupBy("dim", "block").agg(ends.alias("ends"), *[F.first(c).alias(c) for c in names])


def _meeting(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor_block, block) whose score interval overlaps what the anchors ask for."""
    gap = F.array_max(F.zip_with("a_ends", "ends", lambda a, x: F.greatest(F.lit(0.0), a["low"] - x["high"], x["low"] - a["high"])))
    span = F.array_min(F.zip_with("a_ends", "ends", lambda a, x: F.least(
        F.lit(math.pi), a["high"] + x["high"], F.lit(2 * math.pi) - a["low"] - x["low"])))
    near, far = F.cos(F.greatest(F.lit(0.0), gap - ROOM)), F.cos(F.least(F.lit(math.pi), span + ROOM))
    most = F.when(near >= 0, F.col("a_norm_high") * F.col("norm_high")).otherwise(F.col("a_norm_low") * F.col("norm_low")) * near
    least = F.when(far >= 0, F.col("a_norm_low") * F.col("norm_low")).otherwise(F.col("a_norm_high") * F.col("norm_high")) * far
    room = 1 + SCORE_ROOM * F.col("a_norm_high") * F.col("norm_high")
    # dealt by a salt, as one length would be one key
    rows = rows.withColumn("salt", F.pmod("block", F.lit(SALTS)))
    left = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("block").alias("anchor_block"), F.col("ends").alias("a_ends"), F.col("norm_low").alias("a_norm_low"),
                          F.col("norm_high").alias("a_norm_high"), "low_asked", "high_asked")
    return left.join(rows, ["dim", "salt"]).where((most + room >= F.col("low_asked")) & (least - room <= F.col("high_asked"))).select("anchor_block", "block")


@dataclass
class Asked:
    """What anchors ask for: up to `most` rows in [low, high] of the same or of other labels."""

    same: bool
    most: int


def _windows(a_angle: np.ndarray, a_norm: np.ndarray, low: np.ndarray, high: np.ndarray, x_angle: np.ndarray, x_norm: np.ndarray) -> tuple:
    """First and last index of the sorted rows whose score with an anchor can lie in [low, high]."""
    least, most = x_norm.min(), x_norm.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        # the smallest cosine that reaches `low`, and the largest that stays at `high` or below
        reach = np.where(low > 0, low / (a_norm * most), low / (a_norm * least))
        stay = np.where(high > 0, high / (a_norm * least), high / (a_norm * most))
    open_end = (a_norm * least == 0)
    widest = np.where(open_end | np.isnan(reach), math.pi, np.arccos(np.clip(reach - SCORE_ROOM, -1, 1)) + ROOM)
    widest = np.where(reach - SCORE_ROOM > 1, np.where(open_end & (low <= 0), math.pi, -1.0), widest)
    nearest = np.where(open_end | np.isnan(stay), 0.0, np.arccos(np.clip(stay + SCORE_ROOM, -1, 1)) - ROOM)
    first = np.searchsorted(x_angle, np.maximum(a_angle - widest, nearest - a_angle), side="left")
    last = np.searchsorted(x_angle, np.where(widest < 0, -1.0, a_angle + widest), side="right")
    return first, np.maximum(first, last)


def _scores(left: np.ndarray, right: np.ndarray, exact_in_double: bool) -> np.ndarray:
    if exact_in_double:  # every partial sum is a whole number below 2**53
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best entries of each row that are not _NONE: score, then smaller id; equal ones once."""
    if scores.shape[1] > most and len(np.unique(ids)) == len(ids):
        bar = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        row, column = np.nonzero((scores >= bar[:, None]) & (scores != _NONE))
    else:
        row, column = np.nonzero(scores != _NONE)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    value, name = scores[row, column], ids[column]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (name[1:] != name[:-1])
    row, column = row[fresh], column[fresh]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], column[place < most]


def _block_scores(anchors: pa.Table, rows: pa.Table, asked: Asked, own_cell: bool) -> Iterator[tuple]:
    """(key, slot, score, id) arrays: the best rows of one block for every anchor and request, cell by cell."""
    x_cells = rows.column("cell").to_numpy()
    x_home = _matrix(rows.column("angles"))[np.arange(len(x_cells)), np.maximum(x_cells, 0) // MOST_REFERENCES]
    order = np.lexsort((x_home, x_cells))
    rows, x_cells, x_home = rows.take(pa.array(order)), x_cells[order], x_home[order]
    x_angles, x_norm, whole = _matrix(rows.column("angles")), rows.column("norm").to_numpy(), _matrix(rows.column("vector"))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    # one entry per request of an anchor
    requests = anchors.column("requests").combine_chunks()
    of = np.repeat(np.arange(len(anchors)), pc.list_value_length(requests).to_numpy(zero_copy_only=False))
    slots, low, high = (c.to_numpy(zero_copy_only=False) for c in requests.flatten().flatten())
    a_cells, a_norm, a_labels, keys = (anchors.column(c).to_numpy() for c in ("cell", "norm", "label", "key"))
    a_angles, a_whole = _matrix(anchors.column("angles")), _matrix(anchors.column("vector"))

    edges = np.flatnonzero(np.append(True, x_cells[1:] != x_cells[:-1]))
    for start, stop in zip(edges, np.append(edges[1:], len(x_cells))):
        cell, part = x_cells[start], slice(start, stop)
        mine = np.flatnonzero((a_cells[of] == cell) == own_cell)
        if not len(mine):
            continue
        # the whole cell against every anchor, by all references; then a window of it by its own
        least, most = x_norm[part].min(), x_norm[part].max()
        ends = x_angles[part].min(axis=0), x_angles[part].max(axis=0)
        gap = np.maximum(0, np.maximum(a_angles - ends[1], ends[0] - a_angles)).max(axis=1)
        near = np.cos(np.maximum(0, gap - ROOM))
        bound = near * a_norm * np.where(near >= 0, most, least) + 1 + SCORE_ROOM * a_norm * most
        mine = mine[bound[of[mine]] >= low[mine]]
        if not len(mine):
            continue
        home = a_angles[of[mine], max(int(cell), 0) // MOST_REFERENCES]
        first, last = _windows(home, a_norm[of[mine]], low[mine].astype(np.float64), high[mine].astype(np.float64), x_home[part], x_norm[part])
        chosen = np.flatnonzero(first < last)
        chosen = chosen[np.lexsort((last[chosen], first[chosen]))]
        double = float(a_norm.max()) * float(most) * (1 + 1e-6) < 2.0**53
        step = max(1, (1 << 20) // (stop - start))
        for a in range(0, len(chosen), step):
            now = chosen[a: a + step]
            asks, window = mine[now], slice(start + int(first[now].min()), start + int(last[now].max()))
            scores = _scores(a_whole[of[asks]], whole[window], double)
            fits = (scores >= low[asks, None]) & (scores <= high[asks, None]) & (ids[window] != keys[of[asks], None])
            fits &= (labels[window] == a_labels[of[asks], None]) == asked.same
            scores[~fits] = _NONE
            row, column = _best(scores, ids[window], asked.most)
            if len(row):
                yield keys[of[asks[row]]], slots[asks[row]], scores[row, column], ids[window][column]


def _meet(asked: Asked, own_cell: bool):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = list(_block_scores(anchors, rows, asked, own_cell)) if len(anchors) and len(rows) else []
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "slot", "score", "id"])

    return run


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best rows of every anchor and request, numbered by `rank`."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    unique = found.repartition("key", "slot").dropDuplicates(["key", "slot", "score", "id"])
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


class _Search:
    """Rows in blocks, and the best of them for anchors with requests."""

    def __init__(self, rows: DataFrame, anchors: DataFrame) -> None:
        self.rows, self.anchors = rows, anchors
        self.extents = materialize(_extent(rows), "extents")
        self.cells = rows.select("dim", "cell", "block").distinct()

    def _round(self, requests: DataFrame, asked: Asked, own_cell: bool) -> DataFrame:
        asked_of = requests.groupBy("key").agg(
            F.collect_list(F.struct("slot", "low", "high")).alias("requests"), F.min("low").alias("low"), F.max("high").alias("high"))
        asking = self.anchors.join(asked_of, "key")
        if own_cell:
            cells = asking.select("dim", "cell", F.col("block").alias("anchor_block")).distinct()
            units = cells.join(self.cells, ["dim", "cell"]).select("anchor_block", "block").distinct()
        else:
            ends = _extent(asking, F.min("low").alias("low_asked"), F.max("high").alias("high_asked"))
            units = _meeting(ends, self.extents)
        units = materialize(units, "units")
        left = asking.withColumnRenamed("block", "anchor_block").join(units, "anchor_block")
        right = self.rows.join(units, "block")
        pairs = left.groupBy("anchor_block", "block").cogroup(right.groupBy("anchor_block", "block"))
        return pairs.applyInArrow(_meet(asked, own_cell), "key long, slot int, score long, id long")

    def best(self, requests: DataFrame, asked: Asked) -> DataFrame:
        """requests: (key, slot, low, high). Result: (key, slot, rank, score, id)."""
        requests = materialize(requests, "requests")
        own = materialize(_top(self._round(requests, asked, True), asked.most), "own_cells")
        bar = own.where(F.col("rank") == asked.most).select("key", "slot", F.col("score").alias("bar"))
        raised = materialize(requests.join(bar, ["key", "slot"], "left").select(
            "key", "slot", F.greatest("low", "bar").alias("low"), "high"), "raised")
        others = self._round(raised, asked, False)
        return _top(own.drop("rank").union(others), asked.most)


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """Per anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which rows are anchors, an expression of the columns of vectors; label: the label, the column
    `label` if not given. Components become floor(scale * x). The score of two rows is their inner
    product; higher ones come first, ties by smaller id. Positives of an anchor are its first other rows
    of the same label; negatives of a positive the first rows of another label whose score is
    low_percent to high_percent of the positive's (none for a negative score).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do rows
    whose norm in whole numbers is 2**31 or more. Vectors of different length are not compared. An all-zero
    vector scores 0 with every row. Ids are whole numbers. Of rows that share an anchor's id the smallest
    (label, vector) asks, and none of them is an answer; answers of equal id and score count once.
    Empty table: no rows. Other columns are ignored.
    """
    if not 0 < low_percent <= high_percent:
        raise ValueError("0 < low_percent <= high_percent")
    rows = materialize(whole_rows(vectors, id_column, vector_column, F.col("label") if label is None else label, anchors, scale), "whole")
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim")
    models = {r["dim"]: _fit(rows, r["dim"], r["n"]) for r in sizes.limit(FITTED_LENGTHS).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(models)  # MOST_REFERENCES rows per length
    schema = "id long, label long, anchor boolean, vector array<long>, dim int, cell int, norm double, angles array<double>"
    placed = materialize(rows.mapInArrow(_angles(shared), schema), "angles")
    asking = placed.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector", "dim", "cell", "norm", "angles")).alias("a"))
    search = _Search(
        materialize(_in_blocks(placed.drop("anchor"), BLOCK_ROWS), "rows"),
        materialize(_in_blocks(asking.select("id", "a.*"), BLOCK_ANCHORS).withColumnRenamed("id", "key"), "anchors"))

    every = search.anchors.select("key", F.lit(0).alias("slot"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    near = materialize(search.best(every, Asked(True, positives)).select(
        "key", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the bounds of a score, taken apart by hundreds as its multiples could leave 64 bits
    tens, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    between = near.where("positive_score >= 0").select(
        "key", "slot", (low_percent * tens + F.ceil(low_percent * rest / 100)).cast("long").alias("low"),
        (high_percent * tens + F.floor(high_percent * rest / 100)).cast("long").alias("high"))
    return near.join(search.best(between, Asked(False, negatives)), ["key", "slot"]).select(
        F.col("key").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
