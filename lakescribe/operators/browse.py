"""Paging and searching of tables and text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import col_of, text_form


def _any_contains(df: DataFrame, search: str) -> Column:
    tests = [
        F.lower(F.coalesce(text_form(col_of(f.name), f.dataType), F.lit(""))).contains(search.lower())
        for f in df.schema.fields
    ]
    return reduce(Column.__or__, tests)


def matching_rows(df: DataFrame, search: str = "") -> DataFrame:
    return df.where(_any_contains(df, search)) if search else df


def page_of(page: int, per_page: int) -> tuple[int, int]:
    """(offset, size) of a page; pages and sizes start at 1."""
    size = max(1, per_page)
    return (max(1, page) - 1) * size, size


def browse_rows(
    df: DataFrame, search: str = "", sort: str = "", descending: bool = False, page: int = 1,
    per_page: int = 50, tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """One page of the rows in which any column contains the text, sorted without regard to case."""
    rows = matching_rows(df, search)
    if sort:
        types = {f.name: f.dataType for f in df.schema.fields}
        key = F.lower(F.coalesce(text_form(col_of(sort), types[sort]), F.lit("")))
        rows = rows.orderBy(key.desc() if descending else key.asc(), *[col_of(c) for c in tiebreak])
    elif tiebreak:
        rows = rows.orderBy(*[col_of(c) for c in tiebreak])
    offset, size = page_of(page, per_page)
    return rows.offset(offset).limit(size)


def browse_total(df: DataFrame, search: str = "") -> DataFrame:
    return matching_rows(df, search).agg(F.count(F.lit(1)).alias("total"))


def text_lines(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, line_number, text): the numbered lines of a text column."""
    lines = F.split(F.regexp_replace(F.col(text_column), r"\r?\n\z", ""), r"\r?\n")
    return df.select(id_column, F.posexplode(lines).alias("line_number", "text")).withColumn(
        "line_number", F.col("line_number") + 1
    )


def search_lines(
    df: DataFrame, id_column: str, text_column: str, search: str = ""
) -> DataFrame:
    """The numbered lines that contain the text, whatever its case."""
    lines = text_lines(df, id_column, text_column)
    return lines.where(F.lower("text").contains(search.lower())) if search else lines
