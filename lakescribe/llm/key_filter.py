"""A Bloom filter of 64-bit keys: tasks leave out rows that an exact join would drop after a shuffle.

A key sets four bits of one 64-bit word. Tasks set bits, Spark joins the words by OR, and the filter is
broadcast. Its size is bounded: with more keys than fit, more rows pass it in vain and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: Bits of a filter for each key, and bytes of a filter at most.
KEY_BITS, FILTER_BYTES = 12, 16 << 20


def _places(keys: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and the bits that it sets there."""
    with np.errstate(over="ignore"):
        name = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bits = np.zeros(len(name), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((name >> np.uint64(6 * k)) & np.uint64(63))
    return ((name >> np.uint64(32)) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64), bits


def _set_bits(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, bits = _places(batch.column(0).to_numpy(zero_copy_only=False), n_words)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits.view(np.int64))], ["place", "bits"])

    return run


def key_filter(keys: DataFrame, column: str, filter_bytes: int = FILTER_BYTES):
    """A broadcast filter of a column of 64-bit numbers without null; keys are read twice."""
    n_words = max(1, min(filter_bytes // 8, -(-keys.count() * KEY_BITS // 64)))
    made = keys.select(F.col(column).cast("long")).mapInArrow(_set_bits(n_words), "place long, bits long")
    joined = made.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # filter_bytes, twice
    words = np.zeros(n_words, np.uint64)
    words[joined.column("place").to_numpy()] = joined.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def passing(batch: pa.RecordBatch, column: str, words: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose key may be in the filter."""
    place, bits = _places(batch.column(column).to_numpy(zero_copy_only=False), len(words))
    return batch.filter(pa.array(words[place] & bits == bits))


def only(rows: DataFrame, column: str, wanted) -> DataFrame:
    """The rows whose key may be in the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (found := passing(batch, column, wanted.value)).num_rows:
                yield found

    return rows.mapInArrow(run, rows.schema)
