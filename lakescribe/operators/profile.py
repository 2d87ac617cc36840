"""Column profiles, value distributions, table shapes and the gates in front of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import fixed_values as fixed
from ..functions.types import (
    base_type_name, col_of, family_of, family_of_name, is_profiled, text_form, of_tables,
)
from ..policy import Policy
from .frequency import bounded_frequencies, distinct_counts, profiled_columns

PROFILE_COLUMNS = (
    "table_name", "column_name", "data_type", "profile_status", "total_rows", "non_null_count",
    "null_count", "null_percent", "distinct_count", "distinct_percent", "minimum_value",
    "maximum_value", "empty_string_count", "whitespace_string_count", "zero_count",
    "negative_count", "minimum_length", "maximum_length", "average_numeric",
    "standard_deviation_numeric", "true_count", "false_count", "candidate_unique", "all_null",
    "constant_value",
)
# One aggregate stays within the 100 fields up to which Spark generates code for it; wider tables
# are measured in several, each reading its own columns.
COLUMNS_PER_SCAN = 8


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 4)


def _measures(name: str, data_type: T.DataType, approx: bool, extrema: bool) -> list[Column]:
    column = col_of(name)
    family = family_of(data_type)
    text = text_form(column, data_type)
    boolean = isinstance(data_type, T.BooleanType)
    numeric = family == "NUMERIC" and not boolean

    def only(applies: bool, measure: Column, cast: str) -> Column:
        return (measure if applies else F.lit(None)).cast(cast)

    string = family == "STRING"
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count(column).alias("non_null_count"),
        only(extrema, F.min(text), "string").alias("minimum_value"),
        only(extrema, F.max(text), "string").alias("maximum_value"),
        only(string, F.count_if(column == ""), "bigint").alias("empty_string_count"),
        only(string, F.count_if(F.trim(column) == ""), "bigint").alias("whitespace_string_count"),
        only(boolean, F.count_if(~column), "bigint").alias("zero_count") if boolean
        else only(numeric, F.count_if(column == 0), "bigint").alias("zero_count"),
        only(numeric, F.count_if(column < 0), "bigint").alias("negative_count"),
        only(string, F.min(F.length(column)), "int").alias("minimum_length"),
        only(string, F.max(F.length(column)), "int").alias("maximum_length"),
        only(numeric, F.avg(column.cast("double")), "double").alias("average_numeric"),
        only(numeric, F.stddev_samp(column.cast("double")), "double").alias(
            "standard_deviation_numeric"
        ),
        only(boolean, F.count_if(column), "bigint").alias("true_count"),
        only(boolean, F.count_if(~column), "bigint").alias("false_count"),
        only(approx, F.approx_count_distinct(column), "bigint").alias("approx_distinct"),
    ]


def _measure_scan(
    df: DataFrame, fields: Sequence[tuple[int, T.StructField]], approx: bool, extrema: bool = True
) -> DataFrame:
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            *_measures(field.name, field.dataType, approx, extrema),
        )
        for position, field in fields
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _measured(df: DataFrame, fields: Sequence[T.StructField], approx: bool) -> DataFrame:
    """All measures that need no shuffle, a few columns per aggregate.

    Text columns are kept apart: extrema of text rule out hash aggregation with generated code,
    which numbers and times keep (their extrema come from the distinct values instead).
    """
    numbered = list(enumerate(fields))
    text = [item for item in numbered if family_of(item[1].dataType) == "STRING" or approx]
    other = [item for item in numbered if item not in text]
    scans = [
        _measure_scan(df, group[i : i + COLUMNS_PER_SCAN], approx, extrema)
        for group, extrema in ((text, True), (other, False))
        for i in range(0, len(group), COLUMNS_PER_SCAN)
    ]
    return reduce(DataFrame.unionAll, scans)


def column_profile(
    df: DataFrame,
    table_name: str,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    status: str | None = None,
) -> DataFrame:
    """One row of measures per column, values unmasked.

    One scan takes all measures that combine without a shuffle (counts, lengths, moments). A
    second scan finds the distinct values of each column, which give the distinct count and the
    extrema of the text form; ``approx=True`` replaces it by sketches in the first. Columns of unprofiled types get a row
    with their status only, and so do all columns when ``status`` names a reason to skip.
    """
    spark = df.sparkSession
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    fields = [] if status else [f for f in chosen if is_profiled(f.dataType)]
    parts = []
    if fields:
        measured = _measured(df, fields, approx)
        if approx:
            measured = measured.withColumn("distinct_count", F.col("approx_distinct"))
        else:
            # one row per column of the table at most: safe to broadcast
            counts = F.broadcast(distinct_counts(df, [f.name for f in fields], extrema=True))
            measured = measured.join(counts, "position", "left").withColumns(
                {
                    "distinct_count": F.coalesce("distinct_count", F.lit(0).cast("bigint")),
                    "minimum_value": F.coalesce("minimum_value", "lowest"),
                    "maximum_value": F.coalesce("maximum_value", "highest"),
                }
            )
        total, filled, distinct = (F.col(c) for c in ("total_rows", "non_null_count", "distinct_count"))
        parts.append(
            measured.withColumns(
                {
                    "table_name": F.lit(table_name),
                    "profile_status": F.lit("PROFILED"),
                    "null_count": total - filled,
                    "null_percent": F.coalesce(percent(total - filled, total), F.lit(0.0)),
                    "distinct_percent": percent(distinct, filled),
                    "candidate_unique": (filled == distinct) & (total == filled),
                    "all_null": filled == 0,
                    "constant_value": (distinct <= 1) & (filled > 0),
                }
            ).select(*PROFILE_COLUMNS)
        )
    skipped = [f for f in chosen if f not in fields]
    if skipped or not parts:
        rows = [
            (table_name, f.name, f.dataType.simpleString(), status or "SKIPPED_FOR_SAFETY_OR_TYPE")
            for f in skipped
        ]
        empty = spark.createDataFrame(
            rows, "table_name string, column_name string, data_type string, profile_status string"
        )
        parts.append(
            empty.select(
                *[F.col(c) if c in empty.columns else F.lit(None).cast(_profile_type(c)).alias(c)
                  for c in PROFILE_COLUMNS]
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _profile_type(name: str) -> str:
    if name in ("candidate_unique", "all_null", "constant_value"):
        return "boolean"
    if name in ("minimum_length", "maximum_length"):
        return "int"
    if name.endswith("_percent") or name.endswith("_numeric"):
        return "double"
    return "string" if name.endswith("_value") else "bigint"


def string_profile(df: DataFrame, table_name: str, columns: Sequence[str] | None = None):
    """Empty, blank-only and length measures of the text columns."""
    return _one_family(
        df, table_name, columns, "STRING",
        ("empty_string_count", "whitespace_string_count", "minimum_length", "maximum_length"),
    )


def numeric_profile(df: DataFrame, table_name: str, columns: Sequence[str] | None = None):
    """Zeros, negatives, mean and sample deviation of the number columns."""
    return _one_family(
        df, table_name, columns, "NUMERIC",
        ("zero_count", "negative_count", "average_numeric", "standard_deviation_numeric"),
    )


def boolean_profile(df: DataFrame, table_name: str, columns: Sequence[str] | None = None):
    """True and false counts of the boolean columns."""
    return _one_family(
        df, table_name, columns, "BOOLEAN", ("true_count", "false_count", "zero_count")
    )


def _one_family(df, table_name, columns, family, measures) -> DataFrame:
    def belongs(field: T.StructField) -> bool:
        boolean = isinstance(field.dataType, T.BooleanType)
        return boolean if family == "BOOLEAN" else family_of(field.dataType) == family and not boolean

    fields = [
        (i, f) for i, f in enumerate(df.schema.fields)
        if belongs(f) and (columns is None or f.name in columns)
    ]
    if not fields:
        raise ValueError(f"{table_name} has no {family.lower()} columns")
    return _measure_scan(df, fields, False, False).select(
        F.lit(table_name).alias("table_name"), "column_name", "data_type", *measures
    )


def low_cardinality_columns(df: DataFrame, limit: int, columns: Sequence[str] | None = None) -> list[str]:
    """Names of the columns with at most ``limit`` distinct values (a result of schema width).

    A column without any row is not listed.
    """
    columns = list(columns) if columns is not None else profiled_columns(df)
    found = bounded_frequencies(df, columns, limit).select("column_name").distinct().collect()
    listed = {r["column_name"] for r in found}
    return [name for name in columns if name in listed]


def low_cardinality_values(
    df: DataFrame,
    table_name: str,
    limit: int = 50,
    columns: Sequence[str] | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """The full distribution of every column with at most ``limit`` distinct values.

    One scan counts and decides (:func:`bounded_frequencies`); with ``profile`` it reads the columns
    that qualify only.
    """
    names = list(columns) if columns is not None else profiled_columns(df)
    if profile is not None:
        rows = profile.where(
            (F.col("profile_status") == "PROFILED") & (F.col("distinct_count") <= limit)
        ).select("column_name").collect()
        listed = {r["column_name"] for r in rows}
        names = [c for c in profiled_columns(df) if c in listed]
    # a column has at most limit + 1 rows here, so its window is small
    total = F.sum("value_count").over(Window.partitionBy("column_name"))
    return (
        bounded_frequencies(df, names, limit)
        .withColumn("total_rows", total)
        .select(
            F.lit(table_name).alias("table_name"), "column_name", "value", "value_count",
            "total_rows", percent(F.col("value_count"), F.col("total_rows")).alias("value_percent"),
        )
        .orderBy("column_name", F.desc("value_count"), F.asc_nulls_first("value"))
    )


def exact_row_count(
    df: DataFrame, table_name: str, estimate: int | None = None, ceiling: int | None = None
) -> DataFrame:
    """(table_name, row_count, row_count_type). Above a ceiling the estimate stands.

    A plain count of a Parquet or ORC table is answered from the file footers.
    """
    if ceiling is None or (estimate is not None and 0 <= estimate <= ceiling):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table_name).alias("table_name"), "row_count", F.lit("EXACT").alias("row_count_type")
        )
    return df.sparkSession.createDataFrame(
        [(table_name, estimate, "ESTIMATED")],
        "table_name string, row_count bigint, row_count_type string",
    )


def exact_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [exact_row_count(df, name) for name, df in tables.items()])


def known_row_estimate(row_count: Column) -> Column:
    """A non-negative whole number, or NULL for anything else."""
    text = F.trim(row_count.cast("string"))
    value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(value >= 0, value)


def within_threshold(row_count: Column, limit: int | None) -> Column:
    """Whether a table is known to be small enough; an unknown size never is."""
    estimate = known_row_estimate(row_count)
    allowed = estimate.isNotNull() if limit is None else estimate <= limit
    return F.coalesce(allowed, F.lit(False))


def profile_status(
    columns: DataFrame, sizes: DataFrame, policy: Policy = Policy(),
    keys: Sequence[str] = ("schema_name", "object_name"),
) -> DataFrame:
    """Each catalogue column with the reason it is skipped, or PROFILED.

    ``sizes`` has one row per table with ``row_count`` in any type.
    """
    sized = columns.join(sizes.select(*keys, "row_count"), list(keys), "left")
    estimate = known_row_estimate(F.col("row_count"))
    limit = policy.profile_row_limit
    over = F.lit(False) if limit is None else estimate > limit
    return sized.withColumn("estimated_table_rows", estimate).withColumn(
        "profile_status",
        F.when(estimate.isNull(), "SKIPPED_ROW_ESTIMATE_UNAVAILABLE")
        .when(over, "SKIPPED_FOR_SAFETY_LARGE_TABLE")
        .when(base_type_name(F.col("data_type")).isin(*fixed.UNPROFILED_TYPES), "SKIPPED_FOR_SAFETY_OR_TYPE")
        .when(F.coalesce(F.col("is_computed"), F.lit(False)), "SKIPPED_COMPUTED")
        .otherwise("PROFILED"),
    ).drop("row_count")


def table_shape(
    columns: DataFrame, sizes: DataFrame | None = None,
    keys: Sequence[str] = ("schema_name", "object_name"),
) -> DataFrame:
    """Per table: how many columns of which kind, and its row count where it is known; no views."""
    columns = of_tables(columns)
    family = family_of_name(F.col("data_type"))

    def total(test: Column, name: str) -> Column:
        return F.count_if(test).cast("int").alias(name)

    shape = columns.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("column_count"),
        total(F.col("is_nullable"), "nullable_columns"),
        total(F.col("is_identity"), "identity_columns"),
        total(F.col("is_computed"), "computed_columns"),
        total(F.col("column_name").rlike(fixed.IDENTIFIER_NAME), "identifier_columns"),
        total(family == "STRING", "string_columns"),
        total(family == "NUMERIC", "numeric_columns"),
        total(family == "DATE_TIME", "date_time_columns"),
        total(family == "BINARY", "binary_columns"),
        total(family == "OTHER", "other_type_columns"),
        total(base_type_name(F.col("data_type")).isin(*fixed.UNPROFILED_TYPES), "large_object_columns"),
    )
    if sizes is None:
        return shape
    kind = F.col("row_count_type") if "row_count_type" in sizes.columns else F.lit("ESTIMATED")
    known = sizes.select(
        *keys, known_row_estimate(F.col("row_count")).alias("row_count"),
        kind.alias("row_count_type"),
    )
    return shape.join(known, list(keys), "left")


def data_type_histogram(columns: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("data_type"), F.lit("")), F.lit("UNKNOWN"))
    return columns.groupBy(name.alias("data_type")).agg(F.count(F.lit(1)).alias("column_count"))
