"""Comparison of whole snapshots, one category of row sets after the other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.compare import (
    CompareSpec, compare, comparison_warnings, delta_columns, run_columns, summarize_comparison, with_databases,
)
from ..operators.profile import data_type_histogram

OBJECT = ("schema_name", "object_name")
SOURCE = ("source_schema", "source_object")
TARGET = ("target_schema", "target_object")
COLUMN = (*OBJECT, "column_name")
SOURCE_COLUMN, TARGET_COLUMN = (*SOURCE, "source_column"), (*TARGET, "target_column")

#: What identifies a row of each category. All its other columns are compared (or those that
#: COMPARED names), and subtracted where their type is a number.
KEYS: dict[str, tuple[str, ...]] = {
    "tables": OBJECT, "columns": COLUMN, "row_counts": OBJECT, "table_shapes": OBJECT, "table_roles": OBJECT,
    "column_profiles": COLUMN, "low_cardinality_values": (*COLUMN, "value"), "sensitivity": COLUMN,
    "primary_keys": (*OBJECT, "constraint_name", "key_ordinal"),
    "foreign_keys": (*SOURCE, "constraint_name", "constraint_column_id"),
    "indexes": (*OBJECT, "index_name", "column_ordinal"),
    "inferred_relationships": (*SOURCE_COLUMN, *TARGET_COLUMN),
    "views": OBJECT, "procedures": OBJECT, "functions": OBJECT, "triggers": OBJECT,
    "definition_hashes": ("object_type", *OBJECT), "documents": ("document",),
    "dependencies": (*SOURCE, *TARGET_COLUMN), "lineage": (*SOURCE_COLUMN, *TARGET_COLUMN),
    "flows": ("origin", "source", "destination"), "job_steps": ("job_name", "step_id"),
    "risks": ("category", "object_context", "observation"),
    "source_availability": ("source_name",), "database_summary": ("metric",), "data_types": ("data_type",),
}
#: A profile is compared by what it says of the values; row counts have a category of their own.
COMPARED = {
    "column_profiles": ("null_percent", "distinct_count", "minimum_value", "maximum_value", "profile_status"),
}
#: Columns with whole texts: carried, and compared by the hash beside them.
DEFINITIONS = {
    **dict.fromkeys(("views", "procedures", "functions", "triggers", "definition_hashes"), "definition_sanitized"),
    "documents": "text",
}


def spec_of(category: str, sides: Sequence[DataFrame], keys: Sequence[str] | None = None) -> CompareSpec:
    """What is compared in a category, from the columns that its row sets have.

    A row set without one of the keys would match rows of different objects, so it is refused.
    """
    keys = tuple(keys or KEYS[category])
    for df in sides:
        if absent := [k for k in keys if k not in df.columns]:
            raise ValueError(f"{category}: no column {', '.join(absent)} to tell rows apart")
    kinds = {f.name: f.dataType for df in reversed(sides) for f in df.schema.fields}
    names = list(dict.fromkeys(c for df in sides for c in df.columns))
    definition = DEFINITIONS.get(category)
    fields = tuple(
        n for n in names
        if n not in keys and n != definition and n in COMPARED.get(category, names) and not isinstance(kinds[n], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    )
    numeric = tuple(n for n in fields if isinstance(kinds[n], T.NumericType))
    return CompareSpec(keys, fields, numeric, definition if definition in names else None)


def definition_records(statements: DataFrame) -> DataFrame:
    """Statement rows of all types under the identity that their hashes are compared by."""
    return statements.select(
        F.col("source_type").alias("object_type"), *OBJECT, "definition_sha256", "definition_sanitized"
    )


def document_records(texts: DataFrame, name_column: str, text_column: str) -> DataFrame:
    return texts.select(
        F.col(name_column).alias("document"), F.sha2(text_column, 256).alias("sha256"),
        F.col(text_column).alias("text"),
    )


def with_derived(row_sets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds the categories that follow from others: the histogram of data types."""
    out = dict(row_sets)
    if "columns" in out and "data_types" not in out:
        out["data_types"] = data_type_histogram(out["columns"])
    return out


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def compare_category(runs: Sequence[DataFrame | None], spec: CompareSpec) -> DataFrame:
    """One category of two or three runs; a run without the row set is unavailable.

    Fields that a run lacks are NULL in it.
    """
    given = next(df for df in runs if df is not None)
    names = [*spec.fields, *spec.numeric, *([spec.definition] if spec.definition else [])]
    sides = [_complete(given.limit(0) if df is None else df, names) for df in runs]
    return compare(
        sides, spec.keys, spec.fields, spec.numeric, spec.definition,
        availability=[df is not None for df in runs],
    )


def _generic(compared: DataFrame, category: str, spec: CompareSpec) -> DataFrame:
    """A category under the common schema: identity, run values, deltas and definitions as maps."""
    three = "b_to_c" in compared.columns

    def as_map(names: Sequence[str], kind: str) -> Column:
        if not names:
            return F.create_map().cast(f"map<string,{kind}>")
        return F.create_map(*[part for n in names for part in (F.lit(n), F.col(n).cast(kind))])

    missing = F.lit(None).cast("string")
    texts = [f"{spec.definition}_{x}" for x in ("abc" if three else "ab")] if spec.definition else []
    return compared.select(
        F.lit(category).alias("category"), as_map(spec.keys, "string").alias("identity"), "status",
        "a_to_b", (F.col("b_to_c") if three else missing).alias("b_to_c"),
        (F.col("a_to_c") if three else missing).alias("a_to_c"),
        (F.col("timeline_events") if three else F.array().cast("array<string>")).alias("timeline_events"),
        "present_in", as_map(run_columns(compared, spec), "string").alias("run_values"),
        as_map(delta_columns(compared, spec), "double").alias("numeric_deltas"),
        as_map(texts, "string").alias("definitions"),
    )


def compare_catalogues(
    runs: Sequence[Mapping[str, DataFrame]], keys: Mapping[str, Sequence[str]] = KEYS,
    databases: Sequence[str] | None = None,
) -> DataFrame:
    """All categories that any run has, under one schema with a ``category`` column.

    ``databases`` names the database of each run; rows then list those in which they exist.
    """
    complete = [with_derived(run) for run in runs]
    parts = []
    for category, own in keys.items():
        sides = [run.get(category) for run in complete]
        if given := [df for df in sides if df is not None]:
            spec = spec_of(category, given, own)
            parts.append(_generic(compare_category(sides, spec), category, spec))
    if not parts:
        raise ValueError("the runs share no known category")
    rows = reduce(DataFrame.unionAll, parts)
    return with_databases(rows, databases) if databases else rows


def compare_snapshots(
    runs: Sequence[Mapping[str, DataFrame]], metadata: DataFrame
) -> dict[str, DataFrame]:
    """Rows, totals and warnings of a comparison; ``metadata`` has database and mode per run."""
    rows = compare_catalogues(runs)
    return {
        "rows": rows,
        "summary": summarize_comparison(rows),
        "warnings": comparison_warnings(metadata),
    }
