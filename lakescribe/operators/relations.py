"""Unique targets, inferred relationships, their validation and orphan analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import fixed_values as fixed
from ..functions.text import is_true, normalized_name
from ..functions.types import col_of, is_profiled, of_tables
from ..sources.shared import materialize
from .frequency import distinct_counts
from .profile import percent, within_threshold

#: Targets listed for each source unless the caller asks for more.
TARGETS_PER_SOURCE = 3


def declared_unique_targets(primary_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Single-column primary keys and single-column unique indexes, one row per column.

    A column that is both appears once, as the primary key.
    """
    table = ("schema_name", "object_name")
    keys = (
        primary_keys.groupBy(*table, "constraint_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column_name"))
        .select(*table, "column_name", F.lit("PRIMARY_KEY").alias("unique_evidence"), "n")
    )
    unique = (
        indexes.where(is_true(F.col("is_unique")) & (F.col("key_ordinal") > 0))
        .groupBy(*table, "index_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column_name"))
        .select(*table, "column_name", F.lit("UNIQUE_INDEX").alias("unique_evidence"), "n")
    )
    return (
        keys.unionAll(unique)
        .where("n = 1")
        .groupBy(*table, "column_name")
        .agg(F.min("unique_evidence").alias("unique_evidence"))
    )


def measured_unique_targets(profile: DataFrame, schema_name: str = "") -> DataFrame:
    """Columns whose values a profile found complete and unique."""
    return profile.where("candidate_unique AND total_rows > 0").select(
        F.lit(schema_name).alias("schema_name"), F.col("table_name").alias("object_name"),
        "column_name", F.lit("MEASURED_UNIQUE").alias("unique_evidence"),
    )


def measure_unique(
    df: DataFrame, table_name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """(table_name, column_name, total_rows, candidate_unique), as a profile would find them.

    A first scan without a shuffle rules out columns with nulls and whole-number columns with more
    rows than numbers between their extrema. Only the rest are counted by distinct values.
    """
    fields = [
        f for f in df.schema.fields
        if is_profiled(f.dataType) and (columns is None or f.name in columns)
    ]
    measures = [F.count(F.lit(1)).alias("total")]
    for i, field in enumerate(fields):
        column = col_of(field.name)
        measures.append(F.count(column).alias(f"n{i}"))
        if isinstance(field.dataType, T.IntegralType):
            span = F.max(column).cast("decimal(20,0)") - F.min(column).cast("decimal(20,0)") + 1
            measures.append(span.alias(f"span{i}"))
    first = df.agg(*measures).first().asDict()
    total = first["total"]
    possible = [
        f.name for i, f in enumerate(fields)
        if first[f"n{i}"] == total and (first.get(f"span{i}") is None or first[f"span{i}"] >= total)
    ]
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(f.name, possible.index(f.name) if f.name in possible else None) for f in fields],
        "column_name string, position int",
    )
    if possible and total:
        # one row per column
        counts = F.broadcast(distinct_counts(df, possible))
        listed = listed.join(counts, "position", "left")
        unique = F.coalesce(F.col("distinct_count") == total, F.lit(False))
    else:
        unique = F.lit(total == 0)
    return listed.select(
        F.lit(table_name).alias("table_name"), "column_name",
        F.lit(total).cast("bigint").alias("total_rows"), unique.alias("candidate_unique"),
    )


def infer_relationships(
    columns: DataFrame,
    unique_targets: DataFrame,
    declared: DataFrame | None = None,
    name_pattern: str = fixed.RELATION_NAME,
    strip_affix: str | None = None,
    targets_per_source: int = TARGETS_PER_SOURCE,
) -> DataFrame:
    """Likely references: identifier-like columns against unique columns of other tables.

    Scores: 2 for the equal type, 4 for the equal normalized name, 5 when the name is the target
    table (or its singular) plus ``id``, else 3 when it contains the table name. At least 6 is
    needed, which the last rule cannot reach without the name being equal: so two equi-joins find
    all candidates. The score depends on a source only through its type and name. Targets are
    therefore ranked once per (type, name), and twice ``targets_per_source`` of them kept: a
    source's own table holds at most half of them (:func:`_best_targets`), so enough others remain.
    They are written as a list a name, small beside the sources: a name that most columns have is
    never gathered in one task, and a source picks its targets from the list in its own row.
    Only columns of tables are sources; ``columns`` tells by ``object_type`` where it has one.

    ``strip_affix`` is a regex dropped from names before they are compared.
    """

    def plain(name: Column) -> Column:
        return normalized_name(F.regexp_replace(name, strip_affix, "") if strip_affix else name)

    key = ["schema_name", "object_name", "column_name"]
    # read by the names, the targets and the sources: derived once
    typed = materialize(
        columns.select(*key, *[c for c in ("object_type",) if c in columns.columns], F.lower("data_type").alias("type_key")),
        "typed-columns",
    )
    # a fixed number of tasks: adaptive execution would merge them by their compressed size, and names compress well
    tasks = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = of_tables(typed).where(F.col("column_name").rlike(name_pattern))
    names = materialize(
        sources.select("type_key", plain(F.col("column_name")).alias("source_name")).distinct(), "source-names"
    )
    sources = sources.repartition(tasks, *key)
    if declared is not None:
        known = declared.select(
            F.col("source_schema").alias("schema_name"), F.col("source_object").alias("object_name"),
            F.col("source_column").alias("column_name"),
        ).distinct()
        sources = sources.join(known, key, "left_anti")
    # a column that is listed several times shares its targets
    sources = sources.groupBy(*key).agg(F.collect_list("type_key").alias("types")).select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        F.col("column_name").alias("source_column"), "types", plain(F.col("column_name")).alias("source_name"),
    )
    targets = typed.select(*key, "type_key").repartition(tasks, *key).join(unique_targets, key).select(
        F.col("schema_name").alias("target_schema"), F.col("object_name").alias("target_object"),
        F.col("column_name").alias("target_column"), "type_key", "unique_evidence",
        plain(F.col("column_name")).alias("target_name"),
        normalized_name(F.col("object_name")).alias("table_key"),
    )
    best = materialize(_best_targets(names, targets, targets_per_source, tasks), "best-targets")

    def others(type_key: Column) -> Column:
        own = lambda x: (x["target_schema"] == F.col("source_schema")) & (x["target_object"] == F.col("source_object"))
        return F.filter("targets", lambda x: (x["type_key"] == type_key) & ~own(x))

    picked = F.slice(F.sort_array(F.flatten(F.transform("types", others))), 1, targets_per_source)
    score = F.col("inference_score")
    return (
        sources.join(best, "source_name")
        .select("source_schema", "source_object", "source_column", F.inline(picked))
        .select(
            "source_schema", "source_object", "source_column",
            "target_schema", "target_object", "target_column",
            F.lit("SCHEMA_INFERRED").alias("classification"),
            F.when(score >= 10, "HIGH").when(score >= 8, "MEDIUM").otherwise("LOW").alias("confidence"),
            "evidence", F.lit("INFERENCE").alias("evidence_class"), "inference_score",
        )
    )


def _best_targets(names: DataFrame, targets: DataFrame, wanted: int, tasks: int) -> DataFrame:
    """(source_name, targets): the best targets of each type, with their place, one row a name."""
    singular = F.regexp_replace("table_key", "s+$", "")
    id_names = F.array_distinct(
        F.array("target_name", F.concat("table_key", F.lit("id")), F.concat(singular, F.lit("id")))
    )
    reachable = targets.withColumn("source_name", F.explode(id_names))
    same_name = F.col("source_name") == F.col("target_name")
    table_id = F.col("source_name").isin(
        F.concat("table_key", F.lit("id")), F.concat(singular, F.lit("id"))
    )
    overlap = (F.col("table_key") != "") & F.contains(F.col("source_name"), F.col("table_key"))
    scored = (
        reachable.join(names, ["type_key", "source_name"])
        .withColumn(
            "inference_score",
            (
                F.lit(2) + F.when(same_name, 4).otherwise(0)
                + F.when(table_id, 5).when(overlap, 3).otherwise(0)
            ).cast("int"),
        )
        .where("inference_score >= 6")
        .withColumn(
            "evidence",
            F.array_join(
                F.array_compact(
                    F.array(
                        F.lit("compatible type"), F.lower("unique_evidence"),
                        F.when(same_name, "matching column name"),
                        F.when(table_id, "table-name identifier pattern").when(
                            overlap, "table-name overlap"
                        ),
                    )
                ),
                "; ",
            ),
        )
    )
    order = [
        F.desc("inference_score"), F.asc("unique_evidence"),
        F.asc("target_schema"), F.asc("target_object"), F.asc("target_column"),
    ]
    in_table = Window.partitionBy("type_key", "source_name", "target_schema", "target_object").orderBy(*order)
    overall = Window.partitionBy("type_key", "source_name").orderBy(*order)
    return (
        scored.repartition(tasks, "type_key", "source_name", "target_schema", "target_object")
        .withColumn("in_table", F.row_number().over(in_table))
        .where(F.col("in_table") <= wanted)
        .withColumn("place", F.row_number().over(overall))
        .where(F.col("place") <= 2 * wanted)
        .groupBy("source_name")
        .agg(
            F.collect_list(
                F.struct(
                    "place", "type_key", "target_schema", "target_object", "target_column",
                    "inference_score", "evidence",
                )
            ).alias("targets")
        )
    )


def all_relationships(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Declared references, marked as facts, and inferred ones under one schema."""
    facts = declared.withColumns(
        {
            "classification": F.lit("DECLARED_FK"), "confidence": F.lit("HIGH"),
            "evidence": F.lit("declared foreign key"), "evidence_class": F.lit("FACT"),
        }
    )
    return facts.unionByName(inferred, allowMissingColumns=True)


def _key_counts(source: DataFrame, column: str) -> DataFrame:
    return source.groupBy(col_of(column).alias("key")).agg(F.count(F.lit(1)).alias("rows"))


def validate_relationship(
    source: DataFrame, source_column: str, target: DataFrame, target_column: str,
    strict_fanout: bool = False,
) -> DataFrame:
    """One row: source rows, null values, distinct values, rows without a target.

    The source is counted per key before the join, so hot keys cost one row each. A target key
    that repeats is joined once; ``strict_fanout`` counts every joined row instead, as a plain
    LEFT JOIN would.
    """
    keys = _key_counts(source, source_column)
    target_keys = (
        target.where(col_of(target_column).isNotNull())
        .groupBy(col_of(target_column).alias("key"))
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    rows = F.col("rows")
    if strict_fanout:
        rows = rows * F.coalesce("matches", F.lit(1))
    filled = F.col("key").isNotNull()

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, rows)), F.lit(0).cast("bigint"))

    return keys.join(target_keys, "key", "left").agg(
        total(F.lit(True)).alias("source_rows"),
        total(~filled).alias("null_source_values"),
        F.count("key").alias("source_distinct_values"),
        total(filled & F.col("matches").isNull()).alias("orphan_rows"),
    )


RELATION_FIELDS = (
    "source_table", "source_column", "target_table", "target_column", "classification",
    "confidence", "evidence", "evidence_class",
)


COUNTS = ("source_rows", "null_source_values", "source_distinct_values", "orphan_rows")


def validate_relationships(
    tables: Mapping[str, DataFrame],
    relationships: Sequence[Mapping[str, str]],
    sizes: Mapping[str, int | None] | None = None,
    row_limit: int | None = None,
) -> DataFrame:
    """J1 for a list of relationships (RELATION_FIELDS), one row each, in the order of the list.

    Relationships between whole numbers, and those between texts, are validated together: every table is
    read once as a source and once as a target of each kind, and one join meets all keys. The plan
    grows with the tables, not with the relationships. Other pairs of types are joined by themselves.

    Relationships marked ``composite`` and tables not known to be within ``row_limit`` are not
    scanned; their counts stay NULL under the status that says why.
    """
    spark = next(iter(tables.values())).sparkSession
    listed, scanned = [], []
    for number, relation in enumerate(relationships):
        within = row_limit is None or all(
            (sizes or {}).get(relation[side]) is not None and sizes[relation[side]] <= row_limit
            for side in ("source_table", "target_table")
        )
        known = relation["source_table"] in tables and relation["target_table"] in tables
        if relation.get("composite"):
            status = "COMPOSITE_RELATIONSHIP_NOT_SCANNED_PER_COLUMN"
        else:
            status = "DATA_VALIDATED" if within and known else "SKIPPED_FOR_SAFETY_OR_ACCESS"
        if status == "DATA_VALIDATED":
            scanned.append((number, relation))
        listed.append((number, *[relation.get(f) for f in RELATION_FIELDS], status))
    names = ", ".join(f"{f} string" for f in RELATION_FIELDS)
    labels = spark.createDataFrame(listed, f"number int, {names}, validation_status string")
    empty = spark.createDataFrame([], "number int, " + ", ".join(f"{c} long" for c in COUNTS))
    # one row per relationship
    counts = reduce(DataFrame.unionByName, [empty, *_counted_together(tables, scanned)])
    joined = labels.join(F.broadcast(counts), "number", "left").orderBy("number")
    return _validated(joined.select(*RELATION_FIELDS, *COUNTS, "validation_status"))


def _kind(data_type: T.DataType) -> str:
    """Columns of one kind are compared in one form: whole numbers, texts; others by themselves."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    return "string" if isinstance(data_type, T.StringType) else ""


def _counted_together(
    tables: Mapping[str, DataFrame], relations: Sequence[tuple[int, Mapping[str, str]]]
) -> list[DataFrame]:
    parts, groups = [], {}
    for number, relation in relations:
        kinds = {
            _kind(tables[relation[f"{side}_table"]].schema[relation[f"{side}_column"]].dataType) for side in ("source", "target")}
        if len(kinds) == 1 and "" not in kinds:
            groups.setdefault(kinds.pop(), []).append((number, relation))
        else:
            counts = validate_relationship(
                tables[relation["source_table"]], relation["source_column"], tables[relation["target_table"]], relation["target_column"])
            parts.append(counts.select(F.lit(number).alias("number"), *COUNTS))
    return [*parts, *[_counted_group(tables, kind, group) for kind, group in groups.items()]]


def _counted_group(
    tables: Mapping[str, DataFrame], kind: str, relations: Sequence[tuple[int, Mapping[str, str]]]
) -> DataFrame:
    """Counts of relationships whose keys are of one kind."""
    targets: dict[tuple[str, str], int] = {}
    for _, relation in relations:
        targets.setdefault((relation["target_table"], relation["target_column"]), len(targets))

    def long_form(entries: Sequence[tuple[str, str, tuple[int, ...]]], fields: tuple[str, ...]) -> DataFrame:
        """Every table once: its columns as rows (fields, key), counted by key."""
        parts = []
        for table in dict.fromkeys(t for t, _, _ in entries):
            own = [(column, ids) for t, column, ids in entries if t == table]
            values = [v for column, ids in own for v in (*map(F.lit, ids), col_of(column).cast(kind))]
            parts.append(tables[table].select(F.stack(F.lit(len(own)), *values).alias(*fields, "key")))
        return reduce(DataFrame.unionAll, parts).groupBy(*fields, "key")

    sources = [
        (r["source_table"], r["source_column"], (number, targets[r["target_table"], r["target_column"]])) for number, r in relations]
    keys = long_form(sources, ("number", "target")).agg(F.count(F.lit(1)).alias("rows"))
    known = long_form([(t, c, (i,)) for (t, c), i in targets.items()], ("target",)).agg(F.lit(True).alias("found")).where("key IS NOT NULL")
    rows, filled = F.col("rows"), F.col("key").isNotNull()

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, rows)), F.lit(0).cast("bigint"))

    # a table without rows has no key: its relationships count nothing
    numbers = tables[relations[0][1]["source_table"]].sparkSession.createDataFrame([(n,) for n, _ in relations], "number int")
    counted = keys.join(known, ["target", "key"], "left").groupBy("number").agg(
        F.sum("rows").alias("source_rows"), total(~filled).alias("null_source_values"), F.count("key").alias("source_distinct_values"),
        total(filled & F.col("found").isNull()).alias("orphan_rows"))
    return numbers.join(counted, "number", "left").select("number", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def _validated(rows: DataFrame) -> DataFrame:
    """Inferred relationships that were checked against the data say so."""
    upgraded = (F.col("validation_status") == "DATA_VALIDATED") & (
        F.coalesce("classification", F.lit("")) != "DECLARED_FK"
    )
    return rows.withColumns(
        {
            "classification": F.when(upgraded, "DATA_VALIDATED").otherwise(F.col("classification")),
            "confidence": F.when(
                upgraded, F.when(F.col("orphan_rows") == 0, "HIGH").otherwise("MEDIUM")
            ).otherwise(F.col("confidence")),
            "evidence": F.when(
                upgraded,
                F.concat(F.coalesce("evidence", F.lit("")), F.lit("; value-domain join validation")),
            ).otherwise(F.col("evidence")),
            "evidence_class": F.when(upgraded, "DATA_VALIDATION").otherwise(F.col("evidence_class")),
        }
    )


def relationship_cardinality(validated: DataFrame) -> DataFrame:
    """1:1 or N:1 and whether the reference is optional, from validated relationships."""
    scanned = F.col("validation_status") == "DATA_VALIDATED"
    composite = F.col("validation_status").startswith("COMPOSITE")
    filled = F.col("source_rows") - F.col("null_source_values")
    return validated.select(
        *RELATION_FIELDS,
        F.when(scanned & (filled == F.col("source_distinct_values")), "1:1")
        .when(composite, "UNKNOWN").otherwise("N:1").alias("likely_cardinality"),
        F.when(~scanned, "UNKNOWN").when(F.col("null_source_values") > 0, "OPTIONAL")
        .otherwise("REQUIRED_IN_CURRENT_DATA").alias("optionality"),
        "validation_status",
    )


def orphan_analysis(validated: DataFrame) -> DataFrame:
    """Matched rows and the share of non-null references without a target."""
    filled = F.col("source_rows") - F.col("null_source_values")
    share = F.when(
        F.col("source_rows").isNotNull(), F.coalesce(percent(F.col("orphan_rows"), filled), F.lit(0.0))
    )
    return validated.select(
        *RELATION_FIELDS, "source_rows", "null_source_values", "orphan_rows",
        (filled - F.col("orphan_rows")).alias("matched_rows"), share.alias("orphan_percent"),
        F.col("validation_status").alias("analysis_status"),
    )


def orphan_rows(
    source: DataFrame, source_column: str, target: DataFrame, target_column: str
) -> DataFrame:
    """The source rows whose reference has no target.

    The anti join runs against distinct target keys; a hot source key is split by Spark's
    skew-join handling, which covers the left side of an anti join.
    """
    keys = target.select(col_of(target_column).alias("__key")).where("__key IS NOT NULL").distinct()
    filled = source.where(col_of(source_column).isNotNull())
    return filled.join(keys, col_of(source_column) == F.col("__key"), "left_anti")


def bridge_candidates(foreign_keys: DataFrame) -> DataFrame:
    """Tables that reference at least two distinct tables; targets listed in order.

    Pairs are made distinct first, so a table's list holds each target once however many
    reference rows there are.
    """
    target = F.concat_ws(".", "target_schema", "target_object")
    return (
        foreign_keys.select("source_schema", "source_object", target.alias("target"))
        .distinct()
        .groupBy("source_schema", "source_object")
        .agg(
            F.count(F.lit(1)).cast("int").alias("target_count"),
            F.array_join(F.sort_array(F.collect_list("target")), ", ").alias("target_objects"),
        )
        .where("target_count >= 2")
        .withColumn("likely_cardinality", F.lit("N:N_BRIDGE_CANDIDATE"))
    )


def within_row_limit(sizes: DataFrame, limit: int | None) -> DataFrame:
    return sizes.withColumn("within_limit", within_threshold(F.col("row_count"), limit))
