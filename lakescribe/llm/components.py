"""Connected components of an edge table in Spark rounds (large star, small star).

Each round hangs nodes on the smallest node they know of; a hub is a minimum that map tasks
aggregate and a join with one row per node on one side. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.sources.shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has an edge to another, with the smallest node it reaches.

    Loops and repeated edges do not matter; edges with a null end are ignored.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    # each edge once, from the larger to the smaller node
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # large star: larger neighbours of a node go to its least neighbour
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("least").alias("b")).distinct()
        # small star: smaller neighbours of a node, and itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        following = materialize(moved.unionByName(least.withColumnRenamed("least", "b")).distinct(), "edges")
        after = _state(following)
        edges = following
        if after == state:
            break
        state = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
