"""A workspace: named tables and what can be said about them without reading their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fixed
from ..functions.text import contains_any
from ..functions.types import quoted

SYSTEM_SCHEMAS = ("sys", "information_schema")


class Workspace:
    """Name -> DataFrame. Everything stays lazy; only schemas are looked at."""

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame], name: str = "workspace",
        schema_name: str = "",
    ) -> None:
        self.spark, self.tables = spark, dict(tables)
        self.name, self.schema_name = name, schema_name

    @classmethod
    def load(cls, spark: SparkSession, root: str, names: Iterable[str], file_format: str = "parquet", **kw):
        """Tables stored as ``<root>/<name>.<format>``."""
        reader = spark.read.format(file_format)
        return cls(spark, {n: reader.load(f"{root}/{n}.{file_format}") for n in names}, **kw)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Workspace":
        """All tables of a database of the session catalog."""
        names = [t.name for t in spark.catalog.listTables(database)]
        tables = {n: spark.table(f"{quoted(database)}.{quoted(n)}") for n in names}
        return cls(spark, tables, name=database, schema_name=database)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def catalogue_tables(workspace: Workspace) -> DataFrame:
    rows = [(workspace.schema_name, name, "USER_TABLE") for name in workspace.tables]
    return workspace.spark.createDataFrame(
        rows, "schema_name string, object_name string, object_type string"
    )


COLUMN_SCHEMA = (
    "schema_name string, object_name string, object_type string, column_name string, column_id int, "
    "data_type string, max_length int, precision int, scale int, is_nullable boolean, "
    "is_identity boolean, is_computed boolean, default_definition string, description string"
)


def catalogue_columns(workspace: Workspace, nested: bool = False) -> DataFrame:
    """One row per column; ``nested`` adds the fields of structs under dotted names."""
    rows = []

    def add(table: str, field: T.StructField, ordinal: int, prefix: str = "") -> int:
        kind, meta = field.dataType, field.metadata or {}
        precision, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (None, None)
        rows.append(
            (
                workspace.schema_name, table, "USER_TABLE", prefix + field.name, ordinal,
                kind.simpleString(), getattr(kind, "length", None), precision, scale, field.nullable,
                "identity.start" in meta, "generationExpression" in meta or "delta.generationExpression" in meta,
                meta.get("CURRENT_DEFAULT"), meta.get("comment"),
            )
        )
        if nested and isinstance(kind, T.StructType):
            for child in kind.fields:
                ordinal = add(table, child, ordinal + 1, prefix + field.name + ".")
        return ordinal

    for table, df in workspace.tables.items():
        ordinal = 0
        for field in df.schema.fields:
            ordinal = add(table, field, ordinal + 1)
    return workspace.spark.createDataFrame(rows, COLUMN_SCHEMA)


def catalogue_schemas(spark: SparkSession) -> DataFrame:
    """Namespaces of the session catalog with a system flag."""
    rows = [
        (d.name, d.locationUri, d.description, d.name.lower() in SYSTEM_SCHEMAS)
        for d in spark.catalog.listDatabases()
    ]
    return spark.createDataFrame(
        rows, "schema_name string, location string, description string, is_system boolean"
    )


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per file-based table: files, bytes and rows, the largest first.

    Rows and file sizes come from one pass over the files' metadata column; no data column is read.
    """
    per_table = []
    for name, df in tables.items():
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
            F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        per_table.append(
            files.agg(
                F.count(F.lit(1)).alias("file_count"),
                F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return reduce(DataFrame.unionAll, per_table).orderBy(F.desc("total_bytes"), "table_name")


def partition_row_counts(df: DataFrame, table_name: str) -> DataFrame:
    """Rows per file of a table and the compression its name tells."""
    path = F.col("file_path")
    file_name = F.element_at(F.split(path, "/"), -1)
    codec = F.regexp_extract(file_name, r"\.(snappy|gz|gzip|zstd|lz4|lz4raw|brotli)\.", 1)
    return (
        df.select("_metadata.file_path")
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(table_name).alias("table_name"), file_name.alias("file_name"), "row_count",
            F.coalesce(F.nullif(codec, F.lit("")), F.lit("UNKNOWN")).alias("compression"),
        )
    )


def column_descriptions(properties: DataFrame) -> DataFrame:
    """All descriptions of a column in one text, from a table of (table, column, value) rows.

    Equal texts of one column count once, so a column's list is as long as its different notes.
    """
    keys = [c for c in ("schema_name", "object_name", "column_name") if c in properties.columns]
    return (
        properties.select(*keys, "property_value").where("property_value IS NOT NULL").distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.sort_array(F.collect_list("property_value")), " ").alias("description"))
    )


PRIMARY_KEY_SCHEMA = (
    "schema_name string, object_name string, constraint_name string, key_ordinal int, "
    "column_name string, is_descending_key boolean"
)
FOREIGN_KEY_SCHEMA = (
    "source_schema string, source_object string, constraint_name string, constraint_column_id int, "
    "source_column string, target_schema string, target_object string, target_column string, "
    "delete_action string, update_action string, is_disabled boolean, is_not_trusted boolean"
)
INDEX_SCHEMA = (
    "schema_name string, object_name string, index_id int, index_name string, column_ordinal int, "
    "column_name string, key_ordinal int, is_unique boolean, is_included_column boolean, "
    "has_filter boolean, is_disabled boolean"
)
CONSTRAINT_SCHEMA = (
    "schema_name string, object_name string, constraint_name string, constraint_type string, "
    "column_name string, definition string, is_disabled boolean, is_not_trusted boolean"
)


def project_declared(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Exactly the declared columns in the declared types; absent ones are NULL."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    present = {c.lower(): c for c in df.columns}

    def column(field: T.StructField) -> Column:
        name = present.get(field.name.lower())
        value = F.lit(None) if name is None else F.col(quoted(name))
        return value.try_cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in wanted.fields])


def declared_keys(primary: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary and foreign keys as the user lists them (Spark enforces none), typed."""
    return project_declared(primary, PRIMARY_KEY_SCHEMA), project_declared(foreign, FOREIGN_KEY_SCHEMA)


def unique_index_columns(indexes: DataFrame) -> DataFrame:
    return project_declared(indexes, INDEX_SCHEMA)


def constraint_catalogue(checks: DataFrame, defaults: DataFrame, keys: DataFrame) -> DataFrame:
    """CHECK, DEFAULT and KEY constraints under one schema."""
    parts = [
        project_declared(df.withColumn("constraint_type", F.lit(kind)), CONSTRAINT_SCHEMA)
        for df, kind in ((checks, "CHECK"), (defaults, "DEFAULT"), (keys, "KEY"))
    ]
    return reduce(DataFrame.unionByName, parts)


AVAILABILITY_SCHEMA = (
    "source_name string, status string, row_count bigint, evidence string, detail string"
)


def availability_of_error(message: Column) -> Column:
    """UNSUPPORTED when a catalogue does not exist here, INACCESSIBLE when it could not be read."""
    missing = contains_any(message, fixed.UNSUPPORTED_MARKERS + ("path_not_found", "table_or_view_not_found"))
    return F.when(missing, "UNSUPPORTED").otherwise("INACCESSIBLE")


#: Sources that are opened, or counted one by one, at a time.
OPENERS = 8


def _error_row(name: str, error: Exception) -> tuple:
    text = str(error)
    gone = any(m in text.lower() for m in fixed.UNSUPPORTED_MARKERS + ("path_not_found", "table_or_view_not_found"))
    status = "UNSUPPORTED" if gone else "INACCESSIBLE"
    return name, status, 0, "CATALOG_NOT_SUPPORTED" if gone else "CATALOG_QUERY_ACCESS_ERROR", text


def _attempt(action: Callable):
    """(result, None) or (None, error) of an access to a source."""
    try:
        return action(), None
    except (PySparkException, OSError) as error:  # an error is part of the answer
        return None, error


def source_availability(
    spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame] | None]
) -> DataFrame:
    """PRESENT, ABSENT, INACCESSIBLE, UNSUPPORTED or DISABLED for each named source.

    A source is a function that opens it, or None where it is switched off. ABSENT takes a
    successful read of zero rows. OPENERS threads open the sources; those that open are counted
    in one job. Only if that fails are they counted one by one, to tell which cannot be read.
    """
    rows = [(name, "DISABLED", 0, "EXPLICIT_CONFIGURATION", "") for name, opener in sources.items() if opener is None]
    opened = {}
    with ThreadPoolExecutor(OPENERS) as pool:
        named = [(name, opener) for name, opener in sources.items() if opener is not None]
        for (name, _), (df, error) in zip(named, pool.map(lambda item: _attempt(item[1]), named)):
            if error is None:
                opened[name] = df
            else:
                rows.append(_error_row(name, error))
        counts, error = _attempt(lambda: _counted(opened))
        if error is not None:
            counts = {}
            for name, (count, error) in zip(opened, pool.map(lambda df: _attempt(df.count), opened.values())):
                if error is None:
                    counts[name] = count
                else:
                    rows.append(_error_row(name, error))
    for name, count in counts.items():
        found = ("PRESENT", count, "CATALOG_QUERY_RETURNED_ROWS") if count else ("ABSENT", 0, "CATALOG_QUERY_RETURNED_ZERO_ROWS")
        rows.append((name, *found, ""))
    return spark.createDataFrame(rows, AVAILABILITY_SCHEMA)


def _counted(opened: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of every source, by one job."""
    if not opened:
        return {}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in opened.items()]
    return {r["name"]: r["n"] for r in reduce(DataFrame.unionAll, parts).collect()}  # a row per source
