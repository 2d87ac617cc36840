"""Distinct counts and value frequencies of all columns of a table in one shuffle each.

All work on the long form (column position, value). The long form is pre-aggregated in the map
tasks, so a value that holds a third of all rows leaves each task once. Where only columns of few
values are wanted, a task stops counting a column at its first value too many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.types import col_of, is_profiled, text_form

# Longer texts are counted by digest: the shuffle then carries 65 characters, not the text.
DIGEST_ABOVE = 64


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_profiled(f.dataType)]


def _long_form(values: list[tuple[int, Column]], df: DataFrame) -> DataFrame:
    pairs = [part for position, value in values for part in (F.lit(position), value)]
    return df.select(F.stack(F.lit(len(values)), *pairs).alias("position", "value"))


def _count_key(name: str, data_type: T.DataType) -> tuple[str, Column]:
    """The type a column's values are counted under, and the values in it."""
    column = col_of(name)
    if isinstance(data_type, T.IntegralType):
        return "bigint", column.cast("bigint")
    if not isinstance(data_type, T.StringType):
        return data_type.simpleString(), column
    text = text_form(column, data_type)
    digest = F.concat(F.lit("#"), F.sha2(text, 256))
    return "string", F.when(F.length(text) > DIGEST_ABOVE, digest).otherwise(text)


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, extrema: bool = False
) -> DataFrame:
    """(position, distinct_count) per column; a column without values has no row.

    Columns are counted in groups of one type, so numbers and times are shuffled as they are. Each
    group reads its own columns only. ``extrema`` adds the lowest and highest text form of the
    columns that are not text, converting every distinct value once.
    """
    columns = list(columns) if columns is not None else profiled_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    groups: dict[str, list[tuple[int, Column]]] = {}
    for position, name in enumerate(columns):
        kind, key = _count_key(name, types[name])
        groups.setdefault(kind, []).append((position, key))
    counted = []
    for kind, keys in groups.items():
        distinct = _long_form(keys, df).where(F.col("value").isNotNull()).distinct()
        if extrema and kind != "string":
            # without a grouping, extrema of text need no sort of the distinct values
            text = text_form(F.col("value"), distinct.schema["value"].dataType)
            rows = [_extremes_of(position, text) for position, _ in keys]
            counted.append(distinct.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("distinct_count > 0"))
            continue
        none = F.lit(None).cast("string")
        extremes = [none.alias("lowest"), none.alias("highest")] if extrema else []
        counts = distinct.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))
        counted.append(counts.select("position", "distinct_count", *extremes))
    return reduce(DataFrame.unionAll, counted)


def _extremes_of(position: int, text: Column) -> Column:
    own = F.col("position") == position
    return F.struct(
        F.lit(position).alias("position"), F.count_if(own).alias("distinct_count"),
        F.min(F.when(own, text)).alias("lowest"), F.max(F.when(own, text)).alias("highest"),
    )


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, value_count), NULL being a value of its own."""
    columns = list(columns) if columns is not None else profiled_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [text_form(col_of(name), types[name]) for name in columns]
    names = F.array(*[F.lit(name) for name in columns])
    return (
        _long_form(list(enumerate(texts)), df)
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("value_count"))
        .select(F.get(names, F.col("position")).alias("column_name"), "value", "value_count")
    )


#: Rows read in front of the scan; a column with too many values among them is left out of it.
PROOF_ROWS = 4096


def not_proven_above(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """The columns of which the first PROOF_ROWS rows show no more than ``limit`` distinct values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [_count_key(name, types[name])[1].alias(f"c{i}") for i, name in enumerate(columns)]
    # collected, a limit reads one partition after another until it has its rows
    rows = df.select(*keys).limit(PROOF_ROWS).collect() if keys else []
    # not-a-number is one value, though unequal to itself
    seen = [{v if v == v else "nan" for row in rows if (v := row[i]) is not None} for i in range(len(columns))]
    return [name for name, values in zip(columns, seen) if len(values) <= limit]


def _bounded_counts(width: int, limit: int):
    """Rows of ``width`` texts as (position, value, value_count) of the task; a count of -1: too many values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[str | None, int] | None] = [{} for _ in range(width)]
        for batch in batches:
            for position, seen in enumerate(counts):
                if seen is None:
                    continue
                found = pc.value_counts(batch.column(position))
                if len(found) > limit + 1:
                    counts[position] = None
                    continue
                for value, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                    seen[value] = seen.get(value, 0) + n
                if len(seen) - (None in seen) > limit:
                    counts[position] = None
        rows = [(i, v, n) for i, seen in enumerate(counts) for v, n in ({None: -1} if seen is None else seen).items()]
        kinds = (pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["position", "value", "value_count"])

    return run


def bounded_frequencies(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """(column_name, value, value_count) of the columns with at most ``limit`` distinct values, NULL apart.

    One scan: every task counts at most ``limit`` + 1 values a column, and only those counts are shuffled;
    a column that exceeds the limit in a task sends one row. Columns that the first rows prove to
    exceed it are not read. Values are told apart by their text form.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = not_proven_above(df, list(columns), limit)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, value_count bigint")
    texts = df.select(*[text_form(col_of(name), types[name]).cast("string").alias(f"c{i}") for i, name in enumerate(names)])
    counted = texts.mapInArrow(_bounded_counts(len(names), limit), "position int, value string, value_count bigint")
    flagged = F.min("value_count") < 0
    merged = counted.groupBy("position", "value").agg(F.sum("value_count").alias("value_count"), flagged.alias("too_many"))
    # a column has at most limit + 1 rows from each task here
    own = Window.partitionBy("position")
    few = merged.select(
        "*", F.max("too_many").over(own).alias("flagged"), F.count("value").over(own).alias("distinct_count"),
    ).where(~F.col("flagged") & (F.col("distinct_count") <= limit))
    listed = F.array(*[F.lit(name) for name in names])
    return few.select(F.get(listed, F.col("position")).alias("column_name"), "value", "value_count")
