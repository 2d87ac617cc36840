"""Packing: length buckets of least padding, and batches of a token budget inside each bucket.

The histogram of all lengths (its bins are bounded by a rule, not by the rows) goes to a dynamic
programme that places the bucket boundaries. Documents are then numbered inside bucket and shard;
shards bound what one task sorts, so a bucket that holds most rows is many shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize

from .quality import words_of

#: Lengths up to here are bins of their own; above, each doubling has 64 bins.
EXACT = 1024


def length_bin(length: str) -> Column:
    """The largest length of the bin of a length column: itself up to EXACT, then 64 steps a doubling."""
    step = f"shiftleft(1L, greatest(0, cast(floor(log2(greatest({length}, 1))) AS int) - 6))"
    return F.expr(f"CASE WHEN {length} <= {EXACT} THEN {length} ELSE cast(ceil({length} / {step}) AS bigint) * {step} END")


def best_boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Boundaries of at most `buckets` buckets with the least padding; lengths rise.

    A document is padded to its bucket's boundary. least[j]: the least number of padded tokens of the
    first j lengths with the buckets used so far; each further bucket tries every last cut.
    """
    n = len(length)
    if not n:
        return []
    before = np.concatenate(([0], np.cumsum(count.astype(np.int64))))
    length = length.astype(np.int64)
    least = np.concatenate(([0], before[1:] * length))
    cuts: list[np.ndarray] = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        following, cut = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = least[:j] + (before[j] - before[:j]) * length[j - 1]
            cut[j] = cost.argmin()
            following[j] = cost[cut[j]]
        cuts.append(cut)
        least = following
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(int(length[j - 1]))
            j = int(cut[j])
    return out[::-1]


def word_tokens(text: Column) -> Column:
    """Words of a text and one end mark."""
    return (F.size(words_of(text)) + 1).cast("long")


def pack(
    docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536, shard_rows: int = 50_000,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, n_tokens, bucket_tokens, shard, batch and place in the batch.

    A document is padded to bucket_tokens, the smallest boundary that holds it. A batch is (bucket_tokens,
    shard, batch); it has as many documents as fit into `budget` padded tokens, and one at least.
    Boundaries have the least padding that `buckets` boundaries among the bins of the histogram allow.

    length: tokens of a row, by default its words and an end mark; null counts as 0, so a null text is
    one end mark. Nothing is cut or dropped. Null ids and repeated rows are packed like others; an
    empty table gives no rows; other columns are ignored.
    """
    length = word_tokens(F.col(text_column)) if length is None else length
    df = docs.select(F.col(id_column).alias("_id"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    df = materialize(df.withColumn("_bin", length_bin("n_tokens")), "lengths")
    histogram = df.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).orderBy("_bin").collect()  # bounded by the bins
    bounds = best_boundaries(np.array([r["_bin"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    if not bounds:
        bounds = [1]
    sizes = dict.fromkeys(bounds, 0)
    for r in histogram:
        sizes[next(b for b in bounds if b >= r["_bin"])] += r["n"]
    bucket, shards = F.lit(bounds[-1]), F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("_bin") <= b, b).otherwise(bucket)
        shards = F.when(F.col("bucket_tokens") == b, max(1, -(-sizes[b] // shard_rows))).otherwise(shards)
    df = df.withColumn("bucket_tokens", bucket.cast("long"))
    df = df.withColumn("shard", F.pmod(F.xxhash64("_id", "n_tokens"), shards.cast("long")).cast("int"))
    number = F.row_number().over(Window.partitionBy("bucket_tokens", "shard").orderBy("_id", "n_tokens")) - 1
    held = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1))
    df = df.withColumn("_number", number)
    return df.select(
        F.col("_id").alias(id_column), "n_tokens", "bucket_tokens", "shard",
        F.floor(F.col("_number") / held).cast("long").alias("batch"), (F.col("_number") % held).cast("long").alias("place"),
    )
