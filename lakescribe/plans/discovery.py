"""One discovery run over a workspace: everything the operators can say about its tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import (
    jobs, lineage, masking, profile, quality, relations, sampling, sensitivity, statements, structure,
)
from ..policy import Policy
from ..sources.shared import dealt, materialize
from ..sources.workspace import (
    CONSTRAINT_SCHEMA, FOREIGN_KEY_SCHEMA, INDEX_SCHEMA, PRIMARY_KEY_SCHEMA, Workspace, catalogue_columns, catalogue_tables,
)

TABLE = ("schema_name", "object_name")
STATEMENT_SCHEMA = "schema_name string, object_name string, source_type string, definition string"
DEPENDENCY_SCHEMA = (
    "source_schema string, source_object string, source_type string, source_column_id int, target_server string, "
    "target_database string, target_schema string, target_object string, target_column string, referenced_id string, "
    "is_ambiguous int, is_caller_dependent int"
)
SYNONYM_SCHEMA = "schema_name string, object_name string, base_object_name string"
JOB_STEP_SCHEMA = (
    "job_name string, step_id int, step_name string, subsystem string, command string, database_name string, schedule_name string"
)


@dataclass(frozen=True)
class Logic:
    """What is known of a workspace's programs; what is left out counts as empty."""

    statements: DataFrame | None = None  #: STATEMENT_SCHEMA, more columns allowed
    dependencies: DataFrame | None = None  #: DEPENDENCY_SCHEMA
    synonyms: DataFrame | None = None  #: SYNONYM_SCHEMA
    job_steps: DataFrame | None = None  #: JOB_STEP_SCHEMA


def discover_logic(workspace: Workspace, logic: Logic, literals: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Definitions, references, dependencies, lineage, flows, jobs and external references.

    Texts are read once for each kind of finding; what several results use is kept in the shared folder.
    ``literals`` are redacted wherever texts are shown. No statement is run.
    """
    spark, columns = workspace.spark, catalogue_columns(workspace)
    catalogued = _or_empty(spark, logic.dependencies, DEPENDENCY_SCHEMA)
    synonyms = _or_empty(spark, logic.synonyms, SYNONYM_SCHEMA)
    steps = dealt(_or_empty(spark, logic.job_steps, JOB_STEP_SCHEMA))
    flags = materialize(
        statements.definition_flags(dealt(_or_empty(spark, logic.statements, STATEMENT_SCHEMA)), literals=literals), "definitions")
    references = materialize(statements.object_references(flags), "references")
    edges = materialize(lineage.merge_dependencies(catalogued, references), "dependencies")
    used = materialize(statements.column_references(flags, columns), "column_references")
    job_references = materialize(jobs.job_step_references(steps, literals), "job_references")
    job_edges = jobs.flow_edges(steps, literals)
    every = materialize(
        lineage.lineage_edges(lineage.catalogue_column_lineage(edges, columns, flags), used, job_references), "lineage")
    views = flags.where("source_type = 'VIEW'")
    return {
        "definitions": flags, "object_references": references, "dependencies": edges, "column_references": used,
        "lineage": every, "lineage_types": lineage.lineage_type_counts(every), "object_degrees": lineage.object_degrees(edges),
        "edges_by_source_type": lineage.edges_by_source_type(edges),
        "flows": lineage.flow_catalogue(references, flags, catalogued, job_edges),
        "external_references": lineage.external_references(edges, synonyms, flags),
        "jobs": jobs.job_catalogue(steps, literals), "job_references": job_references, "job_flows": job_edges,
        "view_eligibility": lineage.view_sample_eligibility(
            views, views, catalogued, references, synonyms, workspace.name, dependencies_complete=logic.dependencies is not None),
    }


def discover(
    workspace: Workspace,
    salt: str,
    policy: Policy = Policy(),
    rules: Sequence[sensitivity.OverrideRule] = (),
    primary_keys: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    skip: Sequence[str] = (),
    logic: Logic | None = None,
    indexes: DataFrame | None = None,
    constraints: DataFrame | None = None,
    errors: DataFrame | None = None,
    **inference,
) -> dict[str, DataFrame]:
    """Catalogue, sizes, shapes, masked profiles and distributions, sensitivity, relationships,
    orphans, roles, samples, risks and summaries; with ``logic`` all of :func:`discover_logic`.

    Values are classified from raw data and masked once, before anything is returned. Profiles and
    distributions, which several results use, are computed once and kept in the shared folder.
    Rows carry ``schema_name`` and ``object_name``. ``policy`` decides which tables are profiled, joined
    and sampled; those named in ``skip`` are left unread as well. The sample of a table is the
    result named ``sample of <table>``.
    ``inference`` is passed to :func:`relations.infer_relationships`.
    """
    spark, schema = workspace.spark, workspace.schema_name
    columns, tables = catalogue_columns(workspace), catalogue_tables(workspace)
    counts = materialize(profile.exact_row_counts(workspace.tables), "row_counts")
    known = {r["table_name"]: r["row_count"] for r in counts.collect()}  # one row per table
    sizes = counts.select(
        F.lit(schema).alias("schema_name"), F.col("table_name").alias("object_name"), "row_count",
        "row_count_type",
    )
    primary = _or_empty(spark, primary_keys, PRIMARY_KEY_SCHEMA)
    foreign = _or_empty(spark, foreign_keys, FOREIGN_KEY_SCHEMA)
    indexed = _or_empty(spark, indexes, INDEX_SCHEMA)
    constrained = _or_empty(spark, constraints, CONSTRAINT_SCHEMA)
    gates = profile.profile_status(columns, sizes, policy)
    # a row per table of the workspace
    large = gates.where("profile_status = 'SKIPPED_FOR_SAFETY_LARGE_TABLE'").select("object_name").distinct().collect()
    skipped = set(skip) | {r["object_name"] for r in large}
    placed = lambda rows: rows.withColumns(
        {"schema_name": F.lit(schema), "object_name": F.col("table_name")}
    )

    profiles = materialize(
        _union(
            profile.column_profile(
                df, name, status="SKIPPED_FOR_SAFETY_LARGE_TABLE" if name in skipped else None
            )
            for name, df in workspace.tables.items()
        ),
        "profiles",
    )
    scanned = {n: df for n, df in workspace.tables.items() if n not in skipped}
    described = columns.select(
        F.col("object_name").alias("table_name"), "schema_name", "column_name", "data_type", "description"
    )
    signals = _union([sensitivity.value_signals(df, name) for name, df in scanned.items()]) if scanned else None
    classes = materialize(
        sensitivity.classify_columns(
            described, rules, signals, keys=("table_name", "column_name"), database=workspace.name
        ),
        "classes",
    )
    nobody = next(iter(workspace.tables.values())).limit(0)
    values = materialize(
        _union([profile.low_cardinality_values(nobody, "", columns=[])] + [
            profile.low_cardinality_values(
                df, name, policy.low_cardinality_limit,
                profile=profiles.where(F.col("table_name") == name),
            )
            for name, df in scanned.items()
        ]),
        "values",
    )
    targets = relations.measured_unique_targets(profiles, schema)
    inferred = relations.infer_relationships(columns, targets, foreign, **inference)
    readable = {n: None if n in skipped else rows for n, rows in known.items()}
    validated = materialize(
        relations.validate_relationships(
            workspace.tables, _relation_list(foreign, inferred), readable,
            policy.profile_row_limit if policy.profile_row_limit is not None else MANY,
        ),
        "validated",
    )
    missing = structure.tables_without_key(tables, primary)
    metrics = structure.table_metrics(tables, primary, foreign, indexed, constrained)
    shape = profile.table_shape(columns, sizes)
    orphans = relations.orphan_analysis(validated)
    masked = lambda rows, fields: masking.reconcile_sensitivity(
        rows, classes, fields, salt, enabled=policy.mask
    )
    programs = discover_logic(workspace, logic) if logic is not None else {}
    plan = sampling.sample_plan(
        tables, sizes, sampling.ordering_columns(primary, indexed), policy, programs.get("view_eligibility"))
    drawn = _drawn(workspace, plan, salt, policy, rules)
    risks = materialize(
        quality.risk_register(
            workspace.name, missing_keys=missing, foreign_keys=foreign, profile=profiles, orphans=orphans,
            constraints=constrained, definitions=programs.get("definitions"), external=programs.get("external_references"),
            errors=errors,
        ),
        "risks",
    )
    index = _union([parts["index"] for parts in drawn.values()] or [sampling.sample_index(nobody, "", 1).limit(0)])
    definitions = programs.get("definitions", spark.createDataFrame([], "dynamic_sql_present boolean"))
    edges = programs.get("lineage", spark.createDataFrame([], "lineage_type string"))
    found = {
        "tables": tables, "columns": columns, "row_counts": sizes, "table_shapes": shape, "profile_gates": gates,
        "data_types": profile.data_type_histogram(columns),
        "column_profiles": placed(masked(profiles, ("minimum_value", "maximum_value"))),
        "low_cardinality_values": placed(masked(values, ("value",))),
        "sensitivity": placed(classes),
        "inferred_relationships": inferred,
        "relationship_cardinality": relations.relationship_cardinality(validated),
        "orphan_analysis": orphans, "bridge_candidates": relations.bridge_candidates(foreign),
        "table_roles": structure.table_roles(tables, shape, metrics),
        "table_similarity": structure.table_similarity(columns),
        "sample_plan": plan, "sample_index": index,
        "risks": risks,
        **programs,
    }
    if drawn:
        found["masking_report"] = _union([parts["report"] for parts in drawn.values()])
    found |= {f"sample of {name}": parts["sample"] for name, parts in drawn.items()}
    found["quality_summary"] = quality.quality_summary(missing, foreign, profiles, orphans, definitions, risks)
    found["coverage_summary"] = quality.coverage_summary(tables, profiles, index, definitions, edges, validated, errors)
    found["database_summary"] = quality.database_summary({
        "tables": tables, "columns": columns, "declared_foreign_key_rows": foreign, "relationships": validated,
        "risks": risks, **{n: programs[n] for n in ("definitions", "dependencies", "lineage", "flows", "jobs") if n in programs},
    })
    return found


#: Above any number of rows: without a limit only tables left unread are not joined.
MANY = 1 << 62


def _drawn(
    workspace: Workspace, plan: DataFrame, salt: str, policy: Policy, rules: Sequence[sensitivity.OverrideRule]
) -> dict[str, dict[str, DataFrame]]:
    """The samples of the tables that the plan says are ready, in its order."""
    ready = plan.where("status = 'READY'").collect()  # one row per table
    return {
        r["object_name"]: sampling.draw_sample(
            workspace.tables[r["object_name"]], r["object_name"], r["requested_rows"], salt,
            r["order_columns"].split(",") if r["order_columns"] else (), rules, r["ordering_strategy"])
        for r in ready if r["object_name"] in workspace.tables
    }


def samples(
    workspace: Workspace, salt: str, policy: Policy = Policy(), keys: dict[str, Sequence[str]] | None = None,
    rules: Sequence[sensitivity.OverrideRule] = (),
) -> dict[str, DataFrame]:
    """A masked sample of every table, ordered by its key where one is given."""
    return {name: parts["sample"] for name, parts in drawn_samples(workspace, salt, policy, keys, rules).items()}


def drawn_samples(
    workspace: Workspace, salt: str, policy: Policy = Policy(), keys: dict[str, Sequence[str]] | None = None,
    rules: Sequence[sensitivity.OverrideRule] = (),
) -> dict[str, dict[str, DataFrame]]:
    """For every table the masked sample, its report and its index, all from one draw."""
    return {
        name: sampling.draw_sample(df, name, policy.sample_rows, salt, (keys or {}).get(name, ()), rules)
        for name, df in workspace.tables.items()
    }


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _or_empty(spark, df: DataFrame | None, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema) if df is None else df


def _relation_list(foreign: DataFrame, inferred: DataFrame) -> list[dict]:
    """Relationships as plan input: at most a few per column of the catalogue."""
    rows = [r.asDict() for r in relations.all_relationships(foreign, inferred).collect()]
    width: dict[tuple, int] = {}
    for row in rows:
        key = (row["source_schema"], row["source_object"], row.get("constraint_name"))
        width[key] = width.get(key, 0) + 1
    return [
        {
            **row, "source_table": row["source_object"], "target_table": row["target_object"],
            "composite": row["classification"] == "DECLARED_FK"
            and width[(row["source_schema"], row["source_object"], row.get("constraint_name"))] > 1,
        }
        for row in rows
    ]
