"""Profiles, distributions, gates and shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakescribe.functions.types import family_of
from lakescribe.operators import profile
from lakescribe.policy import Policy
from lakescribe.sources.workspace import Workspace, catalogue_columns, catalogue_tables

from .inputs import TABLES, Registry, derived, table, with_inputs

registry = Registry()

# Column kinds of the given tables, for the SQL side only.
KINDS = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "bigint"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "blank_orders": {"o_orderkey": "bigint", "label": "string", "digit": "bigint", "status": "string",
                     "even": "boolean", "negative": "bigint", "constant": "string", "missing": "string"},
}
NUMBERS = ("bigint", "int", "double")


def measures_sql(name: str, column: str, kind: str) -> dict[str, str]:
    """SQL of every measure of one column."""
    c = f'"{column}"'
    text = f"CAST({c} AS VARCHAR)"
    null = {"b": "CAST(NULL AS BIGINT)", "d": "CAST(NULL AS DOUBLE)", "i": "CAST(NULL AS INTEGER)"}
    is_text, is_number, is_bool = kind == "string", kind in NUMBERS, kind == "boolean"
    distinct = f"count(DISTINCT {c})"
    return {
        "table_name": f"'{name}'", "column_name": f"'{column}'", "data_type": f"'{kind}'",
        "profile_status": "'PROFILED'", "total_rows": "count(*)", "non_null_count": f"count({c})",
        "null_count": f"count(*) - count({c})",
        "null_percent": f"coalesce(round((count(*) - count({c})) * 100.0::DOUBLE / nullif(count(*), 0), 4), 0.0)",
        "distinct_count": distinct,
        "distinct_percent": f"round({distinct} * 100.0::DOUBLE / nullif(count({c}), 0), 4)",
        "minimum_value": f"min({text})", "maximum_value": f"max({text})",
        "empty_string_count": f"count(*) FILTER ({c} = '')" if is_text else null["b"],
        "whitespace_string_count": f"count(*) FILTER (trim({c}) = '')" if is_text else null["b"],
        "zero_count": f"count(*) FILTER ({c} = 0)" if is_number
        else f"count(*) FILTER (NOT {c})" if is_bool else null["b"],
        "negative_count": f"count(*) FILTER ({c} < 0)" if is_number else null["b"],
        "minimum_length": f"CAST(min(length({c})) AS INTEGER)" if is_text else null["i"],
        "maximum_length": f"CAST(max(length({c})) AS INTEGER)" if is_text else null["i"],
        "average_numeric": f"round(avg(CAST({c} AS DOUBLE)), 4)" if is_number else null["d"],
        "standard_deviation_numeric": f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)" if is_number else null["d"],
        "true_count": f"count(*) FILTER ({c})" if is_bool else null["b"],
        "false_count": f"count(*) FILTER (NOT {c})" if is_bool else null["b"],
        "candidate_unique": f"count({c}) = {distinct} AND count(*) = count({c})",
        "all_null": f"count({c}) = 0", "constant_value": f"{distinct} <= 1 AND count({c}) > 0",
    }


def profile_sql(name: str, kinds: dict[str, str], measures: tuple[str, ...] = profile.PROFILE_COLUMNS) -> str:
    """UNION ALL of one aggregate per column; unprofiled types get their status only."""
    parts = []
    for column, kind in kinds.items():
        sql = measures_sql(name, column, kind)
        if kind.startswith("array"):
            types = {m: "BOOLEAN" if m in ("candidate_unique", "all_null", "constant_value") else
                     "VARCHAR" if m.endswith("_value") else "DOUBLE" if m.endswith(("_percent", "_numeric"))
                     else "INTEGER" if m.endswith("_length") else "BIGINT" for m in sql}
            sql = {m: sql[m] if m in ("table_name", "column_name", "data_type")
                   else "'SKIPPED_FOR_SAFETY_OR_TYPE'" if m == "profile_status"
                   else f"CAST(NULL AS {types[m]})" for m in sql}
            parts.append("SELECT " + ", ".join(f"{sql[m]} AS {m}" for m in measures))
        else:
            parts.append("SELECT " + ", ".join(f"{sql[m]} AS {m}" for m in measures) + f" FROM {name}")
    return "\nUNION ALL\n".join(parts)


def rounded(df: DataFrame) -> DataFrame:
    """Moments to four places: engines add doubles in different orders."""
    names = [c for c in ("average_numeric", "standard_deviation_numeric") if c in df.columns]
    return df.withColumns({c: F.round(c, 4) for c in names})


def _profile_query(name: str):
    return lambda spark, sf: rounded(profile.column_profile(table(spark, sf, name), name))


for _name in ("orders", "lineitem", "customer", "part", "events", "documents", "embeddings", "pages", "conversations"):
    registry.add(profile_sql(_name, KINDS[_name]), f"column_profile_{_name}")(_profile_query(_name))


@registry.add(with_inputs("blank_orders", profile_sql("blank_orders", KINDS["blank_orders"])))
def column_profile_blank_orders(spark, sf):
    return rounded(profile.column_profile(derived(spark, sf, "blank_orders"), "blank_orders"))


@registry.add(
    with_inputs(
        "blank_orders",
        profile_sql(
            "blank_orders", {c: k for c, k in KINDS["blank_orders"].items() if k == "string"},
            ("table_name", "column_name", "data_type", "empty_string_count", "whitespace_string_count",
             "minimum_length", "maximum_length"),
        ),
    )
)
def string_profile(spark, sf):
    return profile.string_profile(derived(spark, sf, "blank_orders"), "blank_orders")


@registry.add(
    profile_sql(
        "lineitem", {c: k for c, k in KINDS["lineitem"].items() if k in NUMBERS},
        ("table_name", "column_name", "data_type", "zero_count", "negative_count", "average_numeric",
         "standard_deviation_numeric"),
    )
)
def numeric_profile(spark, sf):
    return rounded(profile.numeric_profile(table(spark, sf, "lineitem"), "lineitem"))


@registry.add(
    with_inputs(
        "blank_orders",
        profile_sql("blank_orders", {"even": "boolean"},
                    ("table_name", "column_name", "data_type", "true_count", "false_count", "zero_count")),
    )
)
def boolean_profile(spark, sf):
    return profile.boolean_profile(derived(spark, sf, "blank_orders"), "blank_orders")


def distribution_sql(name: str, kinds: dict[str, str], limit: int) -> str:
    parts = []
    for column, kind in kinds.items():
        if kind.startswith("array"):
            continue
        c = f'"{column}"'
        parts.append(
            f"SELECT '{name}' AS table_name, '{column}' AS column_name, CAST({c} AS VARCHAR) AS value, "
            f"count(*) AS value_count, CAST(sum(count(*)) OVER () AS BIGINT) AS total_rows, "
            f"round(count(*) * 100.0::DOUBLE / CAST(sum(count(*)) OVER () AS BIGINT), 4) AS value_percent "
            f"FROM {name} WHERE (SELECT count(DISTINCT {c}) FROM {name}) <= {limit} GROUP BY {c}"
        )
    return "\nUNION ALL\n".join(parts)


for _name in ("orders", "lineitem", "events", "documents"):
    registry.add(distribution_sql(_name, KINDS[_name], 50), f"low_cardinality_values_{_name}")(
        lambda spark, sf, name=_name: profile.low_cardinality_values(table(spark, sf, name), name)
    )


@registry.add(with_inputs("blank_orders", distribution_sql("blank_orders", KINDS["blank_orders"], 10)))
def low_cardinality_values_blank_orders(spark, sf):
    return profile.low_cardinality_values(derived(spark, sf, "blank_orders"), "blank_orders", 10)


def all_tables(spark, sf) -> dict[str, DataFrame]:
    return {name: table(spark, sf, name) for name in TABLES}


COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, 'EXACT' AS row_count_type FROM {t}" for t in TABLES
)


@registry.add(COUNTS)
def exact_row_count(spark, sf):
    return profile.exact_row_counts(all_tables(spark, sf))


def _workspace(spark, sf) -> Workspace:
    return Workspace(spark, all_tables(spark, sf), schema_name="main")


def _sizes(spark, sf) -> DataFrame:
    return profile.exact_row_counts(all_tables(spark, sf)).select(
        F.lit("main").alias("schema_name"), F.col("table_name").alias("object_name"), "row_count",
        "row_count_type",
    )


@registry.add(
    "SELECT 'main' AS schema_name, table_name AS object_name, 'USER_TABLE' AS object_type, row_count, "
    f"row_count_type FROM ({COUNTS})"
)
def catalogue_tables_with_counts(spark, sf):
    return catalogue_tables(_workspace(spark, sf)).join(_sizes(spark, sf), ["schema_name", "object_name"])


_COLUMN_ROWS = ", ".join(
    f"('{t}', '{c}', {i}, '{k}')" for t in TABLES for i, (c, k) in enumerate(KINDS[t].items(), 1)
)


@registry.add(
    f"SELECT 'main' AS schema_name, t AS object_name, c AS column_name, CAST(i AS INTEGER) AS column_id, "
    f"k AS data_type, true AS is_nullable, row_count FROM (VALUES {_COLUMN_ROWS}) AS v(t, c, i, k) "
    f"JOIN ({COUNTS}) ON table_name = t"
)
def catalogue_columns_with_counts(spark, sf):
    columns = catalogue_columns(_workspace(spark, sf))
    return columns.join(_sizes(spark, sf), ["schema_name", "object_name"]).select(
        "schema_name", "object_name", "column_name", "column_id", "data_type", "is_nullable", "row_count"
    )


def _family_sql(column: str) -> str:
    base = f"lower(trim(regexp_replace({column}, '[(<].*$', '')))"
    return (
        f"CASE WHEN {base} IN ('char','varchar','nchar','nvarchar','text','ntext','xml','string') THEN 'STRING' "
        f"WHEN {base} IN ('tinyint','smallint','int','bigint','decimal','numeric','money','smallmoney','float','real','bit','double','boolean') THEN 'NUMERIC' "
        f"WHEN {base} IN ('date','datetime','datetime2','smalldatetime','datetimeoffset','time','timestamp','timestamp_ntz','timestamp_ltz') THEN 'DATE_TIME' "
        f"WHEN {base} IN ('binary','varbinary','image','rowversion') THEN 'BINARY' ELSE 'OTHER' END"
    )


def shape_sql(columns: str, extra: str = "", join: str = "") -> str:
    def count(test: str, alias: str) -> str:
        return f"CAST(count(*) FILTER ({test}) AS INTEGER) AS {alias}"

    families = ", ".join(
        count(f"family = '{f}'", a) for f, a in (
            ("STRING", "string_columns"), ("NUMERIC", "numeric_columns"), ("DATE_TIME", "date_time_columns"),
            ("BINARY", "binary_columns"), ("OTHER", "other_type_columns"),
        )
    )
    large = (
        "lower(trim(regexp_replace(data_type, '[(<].*$', ''))) IN ('binary','varbinary','image','text','ntext',"
        "'xml','sql_variant','rowversion','hierarchyid','geography','geometry','variant')"
    )
    return (
        f"SELECT s.*{extra} FROM (SELECT schema_name, object_name, CAST(count(*) AS INTEGER) AS column_count, "
        f"{count('is_nullable', 'nullable_columns')}, {count('is_identity', 'identity_columns')}, "
        f"{count('is_computed', 'computed_columns')}, "
        + count("regexp_matches(column_name, '(?i)(^id$|id$|_id$)')", "identifier_columns")
        + f", {families}, {count(large, 'large_object_columns')} "
        f"FROM (SELECT *, {_family_sql('data_type')} AS family FROM {columns}) GROUP BY schema_name, object_name) s {join}"
    )


KNOWN = (
    "CASE WHEN regexp_matches(trim(row_count), '^[+-]?[0-9]+$') AND CAST(trim(row_count) AS BIGINT) >= 0 "
    "THEN CAST(trim(row_count) AS BIGINT) END"
)


@registry.add(
    with_inputs(
        ("cat_columns", "cat_tables"),
        shape_sql(
            "cat_columns", ", t.row_count, t.row_count_type",
            f"LEFT JOIN (SELECT schema_name, object_name, {KNOWN} AS row_count, 'ESTIMATED' AS row_count_type "
            "FROM cat_tables) t ON t.schema_name = s.schema_name AND t.object_name = s.object_name",
        ),
    )
)
def table_shape(spark, sf):
    return profile.table_shape(derived(spark, sf, "cat_columns"), derived(spark, sf, "cat_tables"))


@registry.add(with_inputs("cat_columns", "SELECT data_type, count(*) AS column_count FROM cat_columns GROUP BY 1"))
def data_type_histogram(spark, sf):
    return profile.data_type_histogram(derived(spark, sf, "cat_columns"))


@registry.add(
    with_inputs(
        "cat_tables",
        f"SELECT object_name, row_count, {KNOWN} AS estimate, coalesce({KNOWN} <= 5000, false) AS within_limit FROM cat_tables",
    )
)
def known_row_estimate(spark, sf):
    return derived(spark, sf, "cat_tables").select(
        "object_name", "row_count", profile.known_row_estimate(F.col("row_count")).alias("estimate"),
        profile.within_threshold(F.col("row_count"), 5000).alias("within_limit"),
    )


@registry.add(
    with_inputs(
        ("cat_columns", "cat_tables"),
        f"""SELECT c.object_name, c.column_name, e.estimate AS estimated_table_rows,
  CASE WHEN e.estimate IS NULL THEN 'SKIPPED_ROW_ESTIMATE_UNAVAILABLE'
    WHEN e.estimate > 5000 THEN 'SKIPPED_FOR_SAFETY_LARGE_TABLE'
    WHEN c.data_type IN ('varbinary', 'text', 'geometry') THEN 'SKIPPED_FOR_SAFETY_OR_TYPE'
    WHEN c.is_computed THEN 'SKIPPED_COMPUTED' ELSE 'PROFILED' END AS profile_status
FROM cat_columns c LEFT JOIN (SELECT object_name, {KNOWN} AS estimate FROM cat_tables) e USING (object_name)""",
    )
)
def profile_status(spark, sf):
    gated = profile.profile_status(
        derived(spark, sf, "cat_columns"), derived(spark, sf, "cat_tables"),
        Policy(profile_row_limit=5000),
    )
    return gated.select("object_name", "column_name", "estimated_table_rows", "profile_status")


def profile_of(spark, sf, names) -> DataFrame:
    """Profiles of several tables under one another."""
    parts = [profile.column_profile(table(spark, sf, n), n) for n in names]
    return reduce(DataFrame.unionByName, parts)


def kinds_of(df: DataFrame) -> dict[str, str]:
    return {f.name: family_of(f.dataType) for f in df.schema.fields}
