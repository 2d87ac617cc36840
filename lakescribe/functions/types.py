"""Type families, for Spark types and for type names found in a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import fixed_values as fixed


def family_of(data_type: T.DataType) -> str:
    """STRING, NUMERIC, DATE_TIME, BINARY or OTHER for a Spark type."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "NUMERIC"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE_TIME"
    if isinstance(data_type, T.BinaryType):
        return "BINARY"
    return "OTHER"


def family_of_name(type_name: Column) -> Column:
    """The same families for a type name; ``decimal(10,2)`` counts as ``decimal``."""
    base = base_type_name(type_name)
    return (
        F.when(base.isin(*fixed.STRING_TYPES), "STRING")
        .when(base.isin(*fixed.NUMERIC_TYPES), "NUMERIC")
        .when(base.isin(*fixed.DATE_TYPES), "DATE_TIME")
        .when(base.isin(*fixed.BINARY_TYPES), "BINARY")
        .otherwise("OTHER")
    )


def base_type_name(type_name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(type_name, r"[(<].*$", "")))


def is_profiled(data_type: T.DataType) -> bool:
    return family_of(data_type) in ("STRING", "NUMERIC", "DATE_TIME")


def text_form(column: Column, data_type: T.DataType) -> Column:
    """The text under which a value is listed, compared and masked.

    Floating point values go through ``+ 0.0`` first: -0.0 and 0.0 are one value but two texts.
    """
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0).cast(data_type)
    if isinstance(data_type, T.StringType):
        return column
    return column.cast("string")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col_of(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def of_tables(columns: DataFrame) -> DataFrame:
    """Catalogue rows of tables; views and others go where ``object_type`` tells them apart."""
    return columns.where(F.col("object_type") == "USER_TABLE") if "object_type" in columns.columns else columns
