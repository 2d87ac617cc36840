"""Dependency, column and flow edges between objects, and what they add up to.

Dependencies have ``source_schema``, ``source_object``, ``source_type``, ``source_column_id``,
``target_server``, ``target_database``, ``target_schema``, ``target_object``, ``target_column``,
``referenced_id``, ``is_ambiguous`` and ``is_caller_dependent``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..sources.shared import by_parts, materialize
from ..functions.text import is_present, is_true

EDGE_KEY = ("source_schema", "source_object", "target_database", "target_schema", "target_object")
LINEAGE_TYPES = ("DIRECT", "DERIVED", "AGGREGATED", "CONDITIONAL", "UNKNOWN")
PROCEDURE_TYPES = ("SQL_STORED_PROCEDURE", "CLR_STORED_PROCEDURE")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Which of several operations on one target counts.
OPERATION_ORDER = ("WRITE", "READ", "CALL")


def hidden_server(name: Column) -> Column:
    """A linked server under the first 12 hex digits of its hash."""
    digest = F.substring(F.sha2(name, 256), 1, 12)
    return F.when(is_present(name), F.concat(F.lit("[EXTERNAL_SERVER:"), digest, F.lit("]"))).otherwise("")


def hash_of(*names: str) -> Column:
    """A leading key beside the names themselves: names that share their first letters, as a schema's do, sort slowly."""
    return F.xxhash64(*names).alias("__hash")


def _edge_keys() -> list[Column]:
    return [F.lower(text_of(name)).alias(f"__{name}") for name in EDGE_KEY]


def merge_dependencies(catalogue: DataFrame, references: DataFrame) -> DataFrame:
    """Catalogue edges, plus each static reference whose edge the catalogue lacks, once.

    Of several references of one edge a write counts before a read and a read before a call. They
    are reduced in the map tasks first, so an edge that most statements have stays one row a task.
    """
    keys = ["__hash", *[f"__{name}" for name in EDGE_KEY]]
    hashed = hash_of(*[f"__{name}" for name in EDGE_KEY])
    known = catalogue.select(*_edge_keys()).select(hashed, "*")
    place = F.lit(0)
    if "operation" in references.columns:
        place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OPERATION_ORDER)), F.col("operation")), F.lit(0)), F.lit(9))
    order = [F.col(c) for c in ("operation", "target_server") if c in references.columns]
    ranked = F.struct(place.alias("place"), *order, *[F.col(c) for c in EDGE_KEY])
    missing = (
        references.select("*", *_edge_keys()).select("*", hashed)
        .join(known, keys, "left_anti")
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*[F.col(c) for c in references.columns]), ranked).alias("__row"))
        .select("__row.*")
    )
    merged = catalogue.unionByName(missing, allowMissingColumns=True)
    return merged.withColumn("target_server", hidden_server(F.col("target_server")))


def _text_class(text: Column) -> Column:
    """The strongest thing a statement does with columns anywhere in its text."""
    return (
        F.when(text.rlike(r"(?i)\b(SUM|AVG|MIN|MAX|COUNT)\s*\("), "AGGREGATED")
        .when(text.rlike(r"(?i)\bCASE\b"), "CONDITIONAL")
        .when(text.rlike(r"[+*/-]"), "DERIVED").otherwise("UNKNOWN")
    )


def catalogue_column_lineage(
    dependencies: DataFrame, columns: DataFrame, definitions: DataFrame
) -> DataFrame:
    """Lineage rows of dependency edges; the source column is looked up by table and ordinal.

    What a text does is read off where it stands; edges are joined with that, not with texts. If an object
    has several texts, the one with the largest digest counts.
    """
    at = ["source_schema", "source_object", "__column_id"]
    names = columns.select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        F.col("column_id").cast("int").alias("__column_id"), F.col("column_name").alias("source_column"),
    ).select(hash_of(*at), "*")
    text = F.coalesce("definition_sanitized", F.lit(""))
    classes = definitions.select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        F.struct(F.sha2(text, 256).alias("digest"), _text_class(text).alias("kind")).alias("__text"),
    ).groupBy(hash_of("source_schema", "source_object"), "source_schema", "source_object").agg(
        F.max("__text").getField("kind").alias("__kind"))
    joined = (
        dependencies.withColumn("__column_id", F.col("source_column_id").try_cast("int"))
        .withColumn("__hash", hash_of(*at)).join(names, ["__hash", *at], "left")
        .withColumn("__hash", hash_of(*at[:2])).join(classes, ["__hash", *at[:2]], "left")
    )
    column = F.col("target_column")
    known = is_present(column)
    identified = is_present(F.col("referenced_id"))
    operation = F.col("operation") if "operation" in dependencies.columns else F.lit(None)
    evidence = F.col("evidence") if "evidence" in dependencies.columns else F.lit(None)
    return joined.withColumns(
        {
            "lineage_type": F.when(F.col("source_column").isNotNull() & known, "DIRECT")
            .when(known, F.coalesce("__kind", F.lit("UNKNOWN"))).otherwise("UNKNOWN"),
            "source_column": F.coalesce("source_column", F.lit("")),
            "relationship": F.coalesce(F.nullif(operation, F.lit("")), F.lit("REFERENCE")),
            "evidence": F.coalesce(F.nullif(evidence, F.lit("")), F.lit("CATALOGUE_DEPENDENCY")),
            "confidence": F.when(identified, "HIGH")
            .when(is_present(F.col("target_schema")), "MEDIUM").otherwise("LOW"),
            "evidence_class": F.when(identified, "FACT").otherwise("INFERENCE"),
        }
    ).select(*LINEAGE_COLUMNS)


#: Catalogue edges of one part of the lineage, about, and parts at most, as each task writes a file for each part.
EDGES_A_PART, MOST_PARTS = 4_000_000, 16


def merged_column_lineage(
    catalogue: DataFrame, references: DataFrame, columns: DataFrame, definitions: DataFrame, parts: int | None = None
) -> DataFrame:
    """catalogue_column_lineage of merge_dependencies, for one part of the source objects after another.

    Edges, references, columns and texts meet by source object only, so each part is whole in itself. ``catalogue`` is counted
    unless ``parts`` is given.
    """
    if parts is None:
        parts = min(MOST_PARTS, max(1, math.ceil(catalogue.count() / EDGES_A_PART)))
    used = [
        F.when(is_present(F.col(c)), "1").otherwise("").alias(c) if c == "referenced_id" else F.col(c) for c in catalogue.columns
        if c in ("source_column_id", "referenced_id", "operation", "evidence", *LINEAGE_COLUMNS)
    ]

    def of(*names: str) -> list[Column]:
        # names that differ in case alone are one edge to the merge
        return [F.lower(text_of(name)) for name in names]

    source, named = of("source_schema", "source_object"), of("schema_name", "object_name")
    tables = [
        (catalogue.select(*used), source), (references, source),
        (columns.select("schema_name", "object_name", "column_id", "column_name"), named),
        (definitions.select("schema_name", "object_name", "definition_sanitized"), named),
    ]
    return by_parts(
        lambda edges, found, names, texts: catalogue_column_lineage(merge_dependencies(edges, found), names, texts), tables, parts)


LINEAGE_COLUMNS = (
    "source_schema", "source_object", "source_type", "source_column", "target_server",
    "target_database", "target_schema", "target_object", "target_column", "relationship",
    "lineage_type", "evidence", "confidence", "evidence_class",
)


def lineage_edges(
    catalogue: DataFrame, column_refs: DataFrame | None = None, job_refs: DataFrame | None = None
) -> DataFrame:
    """All lineage under one schema: catalogue edges, column references, job step references."""
    parts = [catalogue.select(*LINEAGE_COLUMNS)]
    if column_refs is not None:
        once = column_refs.groupBy(
            "source_schema", "source_object", "source_type",
            F.lower("target_schema"), F.lower("target_object"), F.lower("target_column"), "lineage_type",
        ).agg(
            F.min(F.struct("target_schema", "target_object", "target_column", "evidence")).alias("first")
        )
        values = {
            "source_column": F.lit("EXPRESSION_OUTPUT_UNKNOWN"),
            "target_server": F.lit(""), "target_database": F.lit(""),
            "target_schema": F.col("first.target_schema"),
            "target_object": F.col("first.target_object"),
            "target_column": F.col("first.target_column"),
            "relationship": F.lit("COLUMN_REFERENCE"), "evidence": F.col("first.evidence"),
            "confidence": F.lit("MEDIUM"), "evidence_class": F.lit("INFERENCE"),
        }
        parts.append(
            once.select(*[values.get(c, F.col(c)).alias(c) for c in LINEAGE_COLUMNS])
        )
    if job_refs is not None:
        step = F.concat(F.lit("step "), F.col("step_id"), F.lit(": "), F.col("step_name"))
        values = {
            "source_schema": F.lit("SQL_AGENT"), "source_object": F.col("job_name"),
            "source_type": F.lit("SQL_AGENT_STEP"), "source_column": F.trim(step),
            "target_column": F.lit(""), "lineage_type": F.lit("UNKNOWN"),
            "relationship": F.coalesce(F.nullif(F.col("operation"), F.lit("")), F.lit("OPAQUE")),
        }
        parts.append(
            job_refs.select(*[values.get(c, F.col(c) if c in job_refs.columns else F.lit("")).alias(c)
                              for c in LINEAGE_COLUMNS])
        )
    return reduce(DataFrame.unionByName, parts)


def lineage_type_counts(lineage: DataFrame) -> DataFrame:
    """Edges per lineage type in one row per type, zero included."""
    counts = [F.count_if(F.col("lineage_type") == kind) for kind in LINEAGE_TYPES]
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("lineage_type"), count.alias("edges"))
            for kind, count in zip(LINEAGE_TYPES, counts)
        ]
    )
    return lineage.agg(rows.alias("rows")).select(F.inline("rows"))


def object_degrees(dependencies: DataFrame) -> DataFrame:
    """Edges in and out of every object, the most connected first."""

    def label(side: str) -> Column:
        return F.concat(text_of(f"{side}_schema"), F.lit("."), text_of(f"{side}_object"))

    ends = F.array(
        F.struct(label("source").alias("object_name"), F.lit(0).alias("inbound"), F.lit(1).alias("outbound")),
        F.struct(label("target").alias("object_name"), F.lit(1).alias("inbound"), F.lit(0).alias("outbound")),
    )
    return (
        dependencies.select(F.inline(ends))
        .groupBy("object_name")
        .agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
        .withColumn("total_edges", F.col("inbound") + F.col("outbound"))
        .withColumn("interpretation", F.lit("STRUCTURAL_CENTRALITY_NOT_BUSINESS_CRITICALITY"))
        .orderBy(F.desc("total_edges"), "object_name")
    )


def edges_of_type(dependencies: DataFrame, *source_types: str) -> DataFrame:
    return dependencies.where(F.col("source_type").isin(*source_types))


def edges_by_source_type(dependencies: DataFrame) -> DataFrame:
    """Edges per source type, with how many of them leave the database."""
    outside = is_present(F.col("target_server")) | is_present(F.col("target_database"))
    return dependencies.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(outside).alias("cross_database_edges")
    )


FLOW_COLUMNS = (
    "origin", "source", "transformation", "destination", "schedule", "read_write_evidence",
    "external_dependency", "classification", "confidence", "evidence_class",
)


#: Targets of one operation that one row of an object lists, about.
TARGETS_A_ROW = 5000


def flow_catalogue(
    references: DataFrame, flags: DataFrame, dependencies: DataFrame, job_edges: DataFrame | None = None,
    targets_a_row: int = TARGETS_A_ROW,
) -> DataFrame:
    """Where data flows from and to: per statement object its distinct sources, destinations and
    calls; edges of objects without static references; job step edges.

    References are made distinct before they are listed, so an object's row is as long as its
    different targets, not its mentions. An object with more than ``targets_a_row`` targets of one operation is
    a hub: its targets are dealt by a digest to several rows, each in order, so no row grows without
    bound. What a hub's row has none of, but the hub has, is empty; all else is said of the whole object.
    """
    source = ["source_schema", "source_object"]
    names = [F.nullif(text_of(f"target_{p}"), F.lit("")) for p in ("database", "schema", "object")]
    # read by the hubs, the rows and the objects left to the catalogue: searched for once
    distinct = materialize(
        references.select(*source, "operation", F.concat_ws(".", *names).alias("target")).distinct(), "targets")
    target = F.col("target")
    hubs = distinct.groupBy(*source, "operation").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > targets_a_row).groupBy(
        *source).agg(F.ceil(F.max("n") / targets_a_row).alias("__rows"))

    def listed(operation: str) -> Column:
        chosen = F.collect_list(F.when(F.col("operation") == operation, target))
        return F.nullif(F.array_join(F.sort_array(chosen), ", "), F.lit("")).alias(operation)

    def has(operation: str) -> Column:
        return F.max(F.col("operation") == operation).alias(f"has_{operation}")

    dots = F.length("target") - F.length(F.replace(target, F.lit("."), F.lit("")))
    dealt = distinct.join(hubs, source, "left").withColumn(
        "__row", F.when(F.col("__rows").isNotNull(), F.pmod(F.xxhash64("target"), "__rows")).otherwise(0))
    rows = dealt.groupBy(*source, "__row").agg(
        listed("READ"), listed("WRITE"), listed("CALL"), has("READ"), has("WRITE"), has("CALL"),
        F.max(dots >= 2).alias("external_dependency"), F.max(F.col("__rows").isNotNull()).alias("hub"),
    )
    whole = ["has_READ", "has_WRITE", "has_CALL", "external_dependency"]
    # rows of hubs only: few, as each stands for many targets
    of_hubs = rows.where("hub").groupBy(*source).agg(*[F.max(c).alias(f"whole_{c}") for c in whole])
    grouped = rows.join(of_hubs, source, "left").withColumns({c: F.coalesce(f"whole_{c}", c) for c in whole})
    dynamic_objects = flags.groupBy(
        F.col("schema_name").alias(source[0]), F.col("object_name").alias(source[1])
    ).agg(F.max("dynamic_sql_present").alias("dynamic"))
    dynamic = F.coalesce("dynamic", F.lit(False))
    unknown = F.lit("UNKNOWN")

    def shown(operation: str, nothing: str) -> Column:
        return F.coalesce(operation, F.when(F.col(f"has_{operation}"), "").otherwise(nothing))

    static = grouped.join(dynamic_objects, source, "left").select(
        F.concat_ws(".", *source).alias("origin"),
        shown("READ", "UNKNOWN").alias("source"),
        F.concat(F.lit("STATIC_SQL_OBJECT; calls="), shown("CALL", "none")).alias("transformation"),
        shown("WRITE", "UNKNOWN").alias("destination"),
        unknown.alias("schedule"),
        F.lit("STATIC DEFINITION TOKEN ANALYSIS").alias("read_write_evidence"),
        "external_dependency",
        F.when(dynamic, "DYNAMIC_SQL_OPAQUE").when(F.col("has_READ") & F.col("has_WRITE"), "LIKELY_PIPELINE")
        .otherwise("CONFIRMED_DEPENDENCY").alias("classification"),
        F.when(dynamic, "LOW").otherwise("MEDIUM").alias("confidence"),
        F.lit("INFERENCE").alias("evidence_class"),
    )
    identified = is_present(F.col("referenced_id"))
    catalogued = dependencies.join(distinct.select(*source), source, "left_anti").select(
        F.concat(text_of("source_schema"), F.lit("."), text_of("source_object")).alias("origin"),
        F.concat(text_of("target_schema"), F.lit("."), text_of("target_object")).alias("source"),
        F.col("source_type").alias("transformation"), unknown.alias("destination"),
        unknown.alias("schedule"),
        F.lit("CATALOG REFERENCE; DIRECTION UNKNOWN").alias("read_write_evidence"),
        (is_present(F.col("target_server")) | is_present(F.col("target_database"))).alias("external_dependency"),
        F.lit("HISTORICAL_OR_UNKNOWN").alias("classification"),
        F.when(identified, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(identified, "FACT").otherwise("INFERENCE").alias("evidence_class"),
    )
    parts = [static, catalogued]
    if job_edges is not None:
        parts.append(job_edges.select(*FLOW_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


EXTERNAL_COLUMNS = (
    "source_schema", "source_object", "source_type", "target_server", "target_database",
    "target_schema", "target_object", "reference_kind", "queried_external_system",
)


def external_references(dependencies: DataFrame, synonyms: DataFrame, definitions: DataFrame) -> DataFrame:
    """References that leave the database: edges, synonyms of three parts and more, and calls
    that open another server."""
    server, database = F.col("target_server"), F.col("target_database")
    edges = dependencies.where(is_present(server) | is_present(database)).select(
        *EXTERNAL_COLUMNS[:7],
        F.when(is_present(server), "FOUR_PART").otherwise("THREE_PART").alias("reference_kind"),
    )
    parts = F.transform(F.split("base_object_name", r"\."), lambda p: F.btrim(p, F.lit("[]")))
    hidden = F.transform(
        parts, lambda p, i: F.when((i == 0) & (F.size(parts) >= 4), hidden_server(p)).otherwise(p)
    )
    blank = [F.lit("").alias(c) for c in ("target_server", "target_database", "target_schema")]
    named = synonyms.where(F.size(F.split("base_object_name", r"\.")) >= 3).select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        F.lit("SYNONYM").alias("source_type"), *blank,
        F.array_join(hidden, ".").alias("target_object"),
        F.lit("SYNONYM_EXTERNAL").alias("reference_kind"),
    )
    text = F.coalesce("definition_sanitized", F.lit(""))
    called = F.array_compact(
        F.array(*[F.when(text.rlike(rf"(?i)\b{c}\s*\("), c) for c in fixed.EXTERNAL_CALLS])
    )
    calls = definitions.select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        F.col("source_type"), F.lit("[STATIC_TEXT_REDACTED]").alias("target_server"),
        F.lit("").alias("target_database"), F.lit("").alias("target_schema"),
        F.lit("").alias("target_object"), F.explode(called).alias("reference_kind"),
    )
    return edges.unionByName(named).unionByName(calls).withColumn(
        "queried_external_system", F.lit(False)
    )


ALLOWED = "ELIGIBLE_LOCAL_ONLY_VIEW"
DENIED = "SKIPPED_EXTERNAL_OR_OPAQUE_VIEW_DEPENDENCY"
VIEW_KEY = ["schema_key", "object_key"]
OPAQUE_FLAGS = (
    "dynamic_sql_present", "dynamic_sql_opaque", "definition_opaque",
    "dependency_resolution_opaque", "is_encrypted",
)


def view_sample_eligibility(
    views: DataFrame, wanted: DataFrame, dependencies: DataFrame, references: DataFrame,
    synonyms: DataFrame, database: str, dependencies_complete: bool = True,
) -> DataFrame:
    """Which of the ``wanted`` views may be sampled because all they read is local.

    Every rule yields (view, reason) rows; a view without any is eligible. Reasons are made
    distinct per view before they are listed, so there are at most as many as rules.
    """
    key = lambda df, s, o: df.withColumns({VIEW_KEY[0]: F.lower(s), VIEW_KEY[1]: F.lower(o)})
    asked = key(wanted.select("schema_name", "object_name").distinct(), "schema_name", "object_name")
    known = key(views, "schema_name", "object_name")
    text = F.coalesce("definition_sanitized", F.lit(""))
    available = is_true(F.col("definition_available")) if "definition_available" in views.columns else text != ""
    opaque = reduce(
        Column.__or__, [is_true(F.col(c)) for c in OPAQUE_FLAGS if c in views.columns], F.lit(False)
    )
    local = database.strip("[]").lower()

    def reasons(df: DataFrame, rules: list[Column]) -> DataFrame:
        return df.select(*VIEW_KEY, F.explode(F.array_compact(F.array(*rules))).alias("reason"))

    of_view = reasons(
        known,
        [
            F.when(~available, "VIEW_DEFINITION_UNAVAILABLE_OR_ENCRYPTED"),
            F.when(opaque, "VIEW_DEFINITION_DYNAMIC_OR_OPAQUE"),
            *[
                F.when(text.rlike(rf"(?i)\b{c}\s*\("), f"EXTERNAL_QUERY_PRIMITIVE_{c}")
                for c in fixed.EXTERNAL_CALLS
            ],
        ],
    )
    missing = asked.join(known.select(*VIEW_KEY), VIEW_KEY, "left_anti").select(
        *VIEW_KEY, F.lit("VIEW_METADATA_UNAVAILABLE").alias("reason")
    )
    parts = F.filter(
        F.transform(
            F.split("base_object_name", r"\."), lambda p: F.btrim(F.trim(p), F.lit("[]"))
        ),
        lambda p: p != "",
    )
    outside = (F.size(parts) >= 4) | ((F.size(parts) == 3) & (F.lower(F.get(parts, F.lit(0))) != local))
    away = synonyms.where(outside).select(
        F.lower("schema_name").alias("away_schema"), F.lower("object_name").alias("away_object")
    ).distinct()
    away_names = away.select("away_object").distinct()
    rows = []
    for source, catalogued in ((dependencies, True), (references, False)):
        optional = lambda name: F.col(name) if name in source.columns else F.lit("")  # noqa: B023, E731
        target_database = F.lower(F.btrim(F.trim(text_of("target_database")), F.lit("[]")))
        unclear = reduce(
            Column.__or__,
            [
                is_true(optional(c)) for c in
                ("is_ambiguous", "is_caller_dependent", "dynamic_sql_opaque", "dependency_resolution_opaque")
            ],
        )
        unresolved = F.lit(catalogued) & ~is_present(optional("referenced_id")) & ~(
            (target_database != "") & (target_database == local)
        )
        keyed = source.select(
            F.lower("source_schema").alias(VIEW_KEY[0]), F.lower("source_object").alias(VIEW_KEY[1]),
            F.lower(text_of("target_schema")).alias("away_schema"),
            F.lower(text_of("target_object")).alias("away_object"),
            F.array_compact(
                F.array(
                    F.when(is_present(F.trim(text_of("target_server"))), "LINKED_SERVER_DEPENDENCY"),
                    F.when(
                        (target_database != "") & (target_database != local), "CROSS_DATABASE_DEPENDENCY"
                    ),
                    F.when(
                        F.upper(optional("reference_kind")).isin(
                            "FOUR_PART", "SYNONYM_EXTERNAL", *fixed.EXTERNAL_CALLS
                        ),
                        "EXTERNAL_OR_OPAQUE_REFERENCE_KIND",
                    ),
                    F.when(unclear, "AMBIGUOUS_OR_OPAQUE_DEPENDENCY"),
                    F.when(unresolved, "UNRESOLVED_CATALOG_DEPENDENCY"),
                )
            ).alias("reasons"),
        )
        rows.append(keyed.select(*VIEW_KEY, F.explode("reasons").alias("reason")))
        synonym = F.lit("EXTERNAL_SYNONYM_DEPENDENCY").alias("reason")
        rows.append(
            keyed.where("away_schema <> ''").join(away, ["away_schema", "away_object"], "left_semi")
            .select(*VIEW_KEY, synonym)
        )
        rows.append(
            keyed.where("away_schema = ''").join(away_names, "away_object", "left_semi")
            .select(*VIEW_KEY, synonym)
        )
    if not dependencies_complete:
        rows.append(asked.select(*VIEW_KEY, F.lit("DEPENDENCY_DISCOVERY_INCOMPLETE").alias("reason")))
    distinct = reduce(DataFrame.unionAll, [of_view, missing, *rows]).distinct()
    listed = distinct.groupBy(*VIEW_KEY).agg(
        F.array_join(F.sort_array(F.collect_list("reason")), ";").alias("reasons")
    )
    return (
        asked.join(listed, VIEW_KEY, "left")
        .select(
            "schema_name", "object_name",
            F.when(F.col("reasons").isNull(), ALLOWED).otherwise(DENIED).alias("status"),
            F.coalesce("reasons", F.lit("")).alias("eligibility_reason"),
        )
    )
