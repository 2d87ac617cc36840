"""Keys, relationships, orphans, structure and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakescribe.operators import browse, profile, quality, relations, sampling, structure
from lakescribe.sources import workspace as sources
from lakescribe.sources.workspace import Workspace, catalogue_columns, project_declared

from .inputs import TABLES, Registry, derived, table, with_inputs
from .profile_checks import KINDS, KNOWN, measures_sql, shape_sql

registry = Registry()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- keys and inferred relationships ----------------------------------------------------------

_TARGETS = """
, keyed AS (SELECT schema_name, object_name, min(column_name) AS column_name, 'PRIMARY_KEY' AS unique_evidence
  FROM cat_primary_keys GROUP BY schema_name, object_name, constraint_name HAVING count(*) = 1),
indexed AS (SELECT schema_name, object_name, min(column_name) AS column_name, 'UNIQUE_INDEX' AS unique_evidence
  FROM cat_indexes WHERE is_unique AND key_ordinal > 0 GROUP BY schema_name, object_name, index_name HAVING count(*) = 1),
targets AS (SELECT schema_name, object_name, column_name, min(unique_evidence) AS unique_evidence
  FROM (SELECT * FROM keyed UNION ALL SELECT * FROM indexed) GROUP BY 1, 2, 3)
"""


def with_extra(names, extra: str, body: str) -> str:
    base = with_inputs(names, "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + extra + body


def _declared_targets(spark, sf) -> DataFrame:
    return relations.declared_unique_targets(
        derived(spark, sf, "cat_primary_keys"), derived(spark, sf, "cat_indexes")
    )


@registry.add(with_extra(("cat_primary_keys", "cat_indexes"), _TARGETS, "SELECT * FROM targets"))
def unique_targets(spark, sf):
    return _declared_targets(spark, sf)


def inference_sql(columns: str, declared: str | None, pattern: str, affix: str = "") -> str:
    """Inference over ``columns`` and a CTE ``targets``; equal names and table names are joined."""
    plain = lambda c: f"regexp_replace(lower(regexp_replace({c}, '{affix}', '')), '[^a-z0-9]', '', 'g')"
    if not affix:
        plain = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    table_key = "regexp_replace(lower(object_name), '[^a-z0-9]', '', 'g')"
    known = (
        f"AND NOT EXISTS (SELECT 1 FROM {declared} d WHERE d.source_schema = c.schema_name AND d.source_object = c.object_name AND d.source_column = c.column_name)"
        if declared else ""
    )
    return f"""
, src AS (SELECT schema_name, object_name, column_name, lower(data_type) AS type_key, {plain('column_name')} AS name_key
  FROM {columns} c WHERE regexp_matches(column_name, {lit(pattern)}) {known}),
tgt AS (SELECT t.*, lower(c.data_type) AS type_key, {plain('t.column_name')} AS name_key, {table_key.replace('object_name', 't.object_name')} AS table_key
  FROM targets t JOIN {columns} c USING (schema_name, object_name, column_name)),
reach AS (SELECT *, name_key AS wanted FROM tgt UNION SELECT *, table_key || 'id' FROM tgt UNION SELECT *, rtrim(table_key, 's') || 'id' FROM tgt),
pairs AS (SELECT s.schema_name AS source_schema, s.object_name AS source_object, s.column_name AS source_column,
    t.schema_name AS target_schema, t.object_name AS target_object, t.column_name AS target_column, unique_evidence,
    s.name_key = t.name_key AS same_name, s.name_key IN (table_key || 'id', rtrim(table_key, 's') || 'id') AS table_id,
    table_key <> '' AND contains(s.name_key, table_key) AS overlap
  FROM src s JOIN reach t ON t.wanted = s.name_key AND t.type_key = s.type_key
  WHERE NOT (s.schema_name = t.schema_name AND s.object_name = t.object_name)),
scored AS (SELECT *, CAST(2 + CASE WHEN same_name THEN 4 ELSE 0 END + CASE WHEN table_id THEN 5 WHEN overlap THEN 3 ELSE 0 END AS INTEGER) AS inference_score,
    'compatible type; ' || lower(unique_evidence) || CASE WHEN same_name THEN '; matching column name' ELSE '' END
    || CASE WHEN table_id THEN '; table-name identifier pattern' WHEN overlap THEN '; table-name overlap' ELSE '' END AS evidence FROM pairs),
inferred AS (SELECT source_schema, source_object, source_column, target_schema, target_object, target_column, inference_score, evidence,
    CASE WHEN inference_score >= 10 THEN 'HIGH' WHEN inference_score >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM scored WHERE inference_score >= 6
  QUALIFY row_number() OVER (PARTITION BY source_schema, source_object, source_column
    ORDER BY inference_score DESC, unique_evidence, target_schema, target_object, target_column) <= 3)
"""


INFERRED_FIELDS = (
    "source_object", "source_column", "target_object", "target_column", "inference_score", "evidence", "confidence",
)
PATTERN = r"(?i)(^id$|id$|_id$|code$|no$)"


@registry.add(
    with_extra(
        ("cat_columns", "cat_primary_keys", "cat_indexes", "cat_foreign_keys"),
        _TARGETS + inference_sql("cat_columns", "cat_foreign_keys", PATTERN),
        f"SELECT {', '.join(INFERRED_FIELDS)} FROM inferred",
    )
)
def infer_relationships_catalogue(spark, sf):
    inferred = relations.infer_relationships(
        derived(spark, sf, "cat_columns"), _declared_targets(spark, sf),
        derived(spark, sf, "cat_foreign_keys"),
    )
    return inferred.select(*INFERRED_FIELDS)


#: All columns that are profiled; lists of numbers are not.
KEY_COLUMNS = {t: [c for c, k in KINDS[t].items() if not k.startswith("array")] for t in TABLES}
AFFIX = "^[a-z]_"


def measured_profile(spark, sf) -> DataFrame:
    parts = [relations.measure_unique(table(spark, sf, t), t, c) for t, c in KEY_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts)


_MEASURED = ", targets AS (" + "\nUNION ALL\n".join(
    f"SELECT 'main' AS schema_name, '{t}' AS object_name, '{c}' AS column_name, 'MEASURED_UNIQUE' AS unique_evidence FROM {t} "
    f"HAVING count(*) > 0 AND {measures_sql(t, c, KINDS[t][c])['candidate_unique']}"
    for t, cs in KEY_COLUMNS.items() for c in cs
) + ")"
_STAR_COLUMNS = ", star AS (SELECT 'main' AS schema_name, t AS object_name, c AS column_name, k AS data_type FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{k}')" for t in TABLES for c, k in KINDS[t].items()
) + ") AS v(t, c, k))"


@registry.add(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, {measures_sql(t, c, k)['candidate_unique']} AS candidate_unique FROM {t}"
        for t in TABLES for c, k in KINDS[t].items() if c in KEY_COLUMNS[t]
    )
)
def measure_unique(spark, sf):
    return reduce(DataFrame.unionAll, [relations.measure_unique(table(spark, sf, t), t) for t in TABLES])


@registry.add(
    "WITH one AS (SELECT 1)" + _MEASURED + _STAR_COLUMNS + inference_sql("star", None, "(?i)(key$|id$)", AFFIX)
    + f"SELECT {', '.join(INFERRED_FIELDS)} FROM inferred"
)
def infer_relationships_measured(spark, sf):
    """References of the star schema, from names and measured uniqueness."""
    tables = {name: table(spark, sf, name) for name in TABLES}
    columns = catalogue_columns(Workspace(spark, tables, schema_name="main"))
    targets = relations.measured_unique_targets(measured_profile(spark, sf), "main")
    inferred = relations.infer_relationships(
        columns, targets, name_pattern="(?i)(key$|id$)", strip_affix=AFFIX
    )
    return inferred.select(*INFERRED_FIELDS)


# --- validation -------------------------------------------------------------------------------


def validation_sql(source: str, scol: str, target: str, tcol: str, strict: bool = False) -> str:
    right = target if strict else f"(SELECT DISTINCT {tcol} FROM {target})"
    return (
        f"SELECT count(*) AS source_rows, count(*) FILTER (s.{scol} IS NULL) AS null_source_values, "
        f"count(DISTINCT s.{scol}) AS source_distinct_values, "
        f"count(*) FILTER (s.{scol} IS NOT NULL AND t.{tcol} IS NULL) AS orphan_rows "
        f"FROM {source} s LEFT JOIN {right} t ON t.{tcol} = s.{scol}"
    )


@registry.add(validation_sql("lineitem", "l_orderkey", "orders", "o_orderkey"))
def validate_relationship_lineitem_orders(spark, sf):
    return relations.validate_relationship(
        table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders"), "o_orderkey"
    )


@registry.add(
    with_inputs(("orphan_orders", "some_customers"), validation_sql("orphan_orders", "o_custkey", "some_customers", "c_custkey"))
)
def validate_relationship_orphans(spark, sf):
    return relations.validate_relationship(
        derived(spark, sf, "orphan_orders"), "o_custkey", derived(spark, sf, "some_customers"), "c_custkey"
    )


@registry.add(validation_sql("customer", "c_custkey", "events", "user_id", strict=True))
def validate_relationship_fanout(spark, sf):
    """A target that is not unique, counted the literal way."""
    return relations.validate_relationship(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "events"), "user_id", strict_fanout=True
    )


@registry.add(validation_sql("customer", "c_custkey", "events", "user_id"))
def validate_relationship_repeated_target(spark, sf):
    return relations.validate_relationship(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "events"), "user_id"
    )


RELATIONS = (
    ("orders", "o_custkey", "customer", "c_custkey", "SCHEMA_INFERRED"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "DECLARED_FK"),
    ("lineitem", "l_partkey", "part", "p_partkey", "SCHEMA_INFERRED"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "SCHEMA_INFERRED"),
    ("labels", "doc_id", "documents", "doc_id", "SCHEMA_INFERRED"),
    ("nation", "n_regionkey", "region", "r_regionkey", "DECLARED_FK"),
    ("events", "user_id", "customer", "c_custkey", "SCHEMA_INFERRED"),
    ("orphan_orders", "o_custkey", "some_customers", "c_custkey", "SCHEMA_INFERRED"),
    ("orphan_orders", "o_custkey", "elsewhere", "c_custkey", "SCHEMA_INFERRED"),
)


def _relations() -> list[dict[str, str]]:
    names = ("source_table", "source_column", "target_table", "target_column", "classification")
    return [
        dict(zip(names, r), confidence="LOW", evidence="compatible type", evidence_class="INFERENCE")
        for r in RELATIONS
    ]


def validated(spark, sf) -> DataFrame:
    tables = {name: table(spark, sf, name) for name in TABLES}
    tables |= {n: derived(spark, sf, n) for n in ("orphan_orders", "some_customers")}
    return relations.validate_relationships(tables, _relations())


_VALIDATED = ", validated AS (" + "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source_table, '{sc}' AS source_column, '{t}' AS target_table, '{tc}' AS target_column, '{c}' AS old_class, "
    + ("'SKIPPED_FOR_SAFETY_OR_ACCESS' AS status, CAST(NULL AS BIGINT) AS source_rows, CAST(NULL AS BIGINT) AS null_source_values, "
       "CAST(NULL AS BIGINT) AS source_distinct_values, CAST(NULL AS BIGINT) AS orphan_rows" if t == "elsewhere"
       else f"'DATA_VALIDATED' AS status, * FROM ({validation_sql(s, sc, t, tc)})")
    for s, sc, t, tc, c in RELATIONS
) + """), labelled AS (SELECT *, status = 'DATA_VALIDATED' AND old_class <> 'DECLARED_FK' AS raised,
  source_rows - null_source_values AS filled FROM validated)"""
_RELATION_COLUMNS = """source_table, source_column, target_table, target_column,
  CASE WHEN raised THEN 'DATA_VALIDATED' ELSE old_class END AS classification,
  CASE WHEN raised AND orphan_rows = 0 THEN 'HIGH' WHEN raised THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN raised THEN 'compatible type; value-domain join validation' ELSE 'compatible type' END AS evidence,
  CASE WHEN raised THEN 'DATA_VALIDATION' ELSE 'INFERENCE' END AS evidence_class"""
_PAIR = ("orphan_orders", "some_customers")


@registry.add(
    with_extra(
        _PAIR, _VALIDATED,
        f"SELECT {_RELATION_COLUMNS}, CASE WHEN status = 'DATA_VALIDATED' AND filled = source_distinct_values THEN '1:1' ELSE 'N:1' END AS likely_cardinality, "
        "CASE WHEN status <> 'DATA_VALIDATED' THEN 'UNKNOWN' WHEN null_source_values > 0 THEN 'OPTIONAL' ELSE 'REQUIRED_IN_CURRENT_DATA' END AS optionality, "
        "status AS validation_status FROM labelled",
    )
)
def relationship_cardinality(spark, sf):
    return relations.relationship_cardinality(validated(spark, sf))


ORPHANS = (
    f"SELECT {_RELATION_COLUMNS}, source_rows, null_source_values, orphan_rows, filled - orphan_rows AS matched_rows, "
    "CASE WHEN source_rows IS NOT NULL THEN coalesce(round(orphan_rows * 100.0::DOUBLE / nullif(filled, 0), 4), 0.0) END AS orphan_percent, "
    "status AS analysis_status FROM labelled"
)


@registry.add(with_extra(_PAIR, _VALIDATED, ORPHANS))
def orphan_analysis(spark, sf):
    return relations.orphan_analysis(validated(spark, sf))


@registry.add(
    with_inputs(
        _PAIR,
        "SELECT * FROM orphan_orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM some_customers)",
    )
)
def orphan_rows(spark, sf):
    return relations.orphan_rows(
        derived(spark, sf, "orphan_orders"), "o_custkey", derived(spark, sf, "some_customers"), "c_custkey"
    )


_BRIDGES = (
    "SELECT source_schema, source_object, CAST(count(*) AS INTEGER) AS target_count, string_agg(target, ', ' ORDER BY target) AS target_objects, "
    "'N:N_BRIDGE_CANDIDATE' AS likely_cardinality FROM (SELECT DISTINCT source_schema, source_object, target_schema || '.' || target_object AS target FROM cat_foreign_keys) "
    "GROUP BY 1, 2 HAVING count(*) >= 2"
)


@registry.add(with_inputs("cat_foreign_keys", _BRIDGES))
def bridge_candidates(spark, sf):
    return relations.bridge_candidates(derived(spark, sf, "cat_foreign_keys"))


@registry.add(
    with_extra(
        ("cat_columns", "cat_primary_keys", "cat_indexes", "cat_foreign_keys"),
        _TARGETS + inference_sql("cat_columns", "cat_foreign_keys", PATTERN),
        "SELECT source_object, source_column, target_object, target_column, constraint_name, 'DECLARED_FK' AS classification, "
        "'FACT' AS evidence_class, CAST(NULL AS INTEGER) AS inference_score FROM cat_foreign_keys "
        "UNION ALL SELECT source_object, source_column, target_object, target_column, NULL, 'SCHEMA_INFERRED', 'INFERENCE', inference_score FROM inferred",
    )
)
def all_relationships(spark, sf):
    declared = derived(spark, sf, "cat_foreign_keys")
    inferred = relations.infer_relationships(
        derived(spark, sf, "cat_columns"), _declared_targets(spark, sf), declared
    )
    return relations.all_relationships(declared, inferred).select(
        "source_object", "source_column", "target_object", "target_column", "constraint_name",
        "classification", "evidence_class", "inference_score",
    )


# --- structure --------------------------------------------------------------------------------

_NO_KEY = (
    "SELECT DISTINCT schema_name, object_name, 'NO_DECLARED_PRIMARY_KEY' AS observation, 'FACT' AS evidence FROM cat_tables "
    "WHERE object_name NOT IN (SELECT object_name FROM cat_primary_keys)"
)


@registry.add(with_inputs(("cat_tables", "cat_primary_keys"), _NO_KEY))
def tables_without_key(spark, sf):
    return structure.tables_without_key(derived(spark, sf, "cat_tables"), derived(spark, sf, "cat_primary_keys"))


def _count_join(source: str, name: str, measure: str, alias: str) -> str:
    return f"LEFT JOIN (SELECT {name} AS object_name, CAST({measure} AS INTEGER) AS {alias} FROM {source} GROUP BY 1) USING (object_name)"


METRIC_NAMES = (
    "primary_key_column_count", "foreign_key_outbound_count", "foreign_key_inbound_count", "index_count", "constraint_count",
)
_METRICS = (
    ", metrics AS (SELECT t.schema_name, object_name, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in METRIC_NAMES) + " FROM cat_tables t "
    + " ".join(
        [
            _count_join("cat_primary_keys", "object_name", "count(*)", METRIC_NAMES[0]),
            _count_join("cat_foreign_keys", "source_object", "count(*)", METRIC_NAMES[1]),
            _count_join("cat_foreign_keys", "target_object", "count(*)", METRIC_NAMES[2]),
            _count_join("cat_indexes", "object_name", "count(DISTINCT index_name)", METRIC_NAMES[3]),
            _count_join("cat_constraints", "object_name", "count(DISTINCT constraint_name)", METRIC_NAMES[4]),
        ]
    ) + ")"
)
_CATALOGUE = ("cat_tables", "cat_columns", "cat_primary_keys", "cat_foreign_keys", "cat_indexes", "cat_constraints")


def table_metrics_of(spark, sf) -> DataFrame:
    return structure.table_metrics(
        *[derived(spark, sf, n) for n in ("cat_tables", "cat_primary_keys", "cat_foreign_keys", "cat_indexes", "cat_constraints")]
    )


@registry.add(with_extra(_CATALOGUE, _METRICS, "SELECT * FROM metrics"))
def table_metrics(spark, sf):
    return table_metrics_of(spark, sf)


def roles_sql(strict: bool) -> str:
    name, rows = "lower(m.object_name)", "coalesce(row_count, 0)" if strict else "row_count"
    has = lambda p: f"regexp_matches({name}, '{p}')"
    width = "coalesce(column_count, 0)"
    return f"""
, shaped AS ({shape_sql('cat_columns')}), sized AS (SELECT object_name, {KNOWN} AS row_count FROM cat_tables),
roles AS (SELECT m.object_name, CASE WHEN {has('audit|log')} THEN 'AUDIT|MEDIUM|name pattern' WHEN {has('history')} THEN 'HISTORY|MEDIUM|name pattern'
  WHEN {has('archive|backup|old')} THEN 'ARCHIVE|MEDIUM|name pattern' WHEN {has('stage|staging|import|temp')} THEN 'STAGING|MEDIUM|name pattern'
  WHEN {has('config|setting|option')} THEN 'CONFIGURATION|MEDIUM|name pattern'
  WHEN foreign_key_outbound_count >= 2 AND {width} <= 16 THEN 'BRIDGE|MEDIUM|multiple outbound FKs and narrow shape'
  WHEN {has('map|bridge|link|detail')} AND {width} <= 16 THEN 'BRIDGE|LOW|name and narrow shape'
  WHEN {has('lookup|type|status|master')} OR ({rows} <= 100 AND {width} <= 12) THEN 'LOOKUP|LOW|name or small narrow shape'
  WHEN {has('transaction|invoice|payment|receipt|order|entry')} THEN 'TRANSACTION|MEDIUM|name pattern'
  WHEN foreign_key_inbound_count >= 2 THEN 'MASTER|LOW|multiple inbound FK references' ELSE 'UNKNOWN|LOW|insufficient structural evidence' END AS code
  FROM metrics m LEFT JOIN shaped s ON s.object_name = m.object_name LEFT JOIN sized z ON z.object_name = m.object_name)
SELECT object_name, split_part(code, '|', 1) AS inferred_category, split_part(code, '|', 2) AS confidence, split_part(code, '|', 3) AS evidence,
  CASE WHEN starts_with(code, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'INFERENCE' END AS evidence_class FROM roles"""


def _roles(spark, sf, strict: bool) -> DataFrame:
    tables = derived(spark, sf, "cat_tables")
    shape = profile.table_shape(derived(spark, sf, "cat_columns"))
    known = tables.select(
        "schema_name", "object_name", profile.known_row_estimate(F.col("row_count")).alias("row_count")
    )
    sized = known.join(shape, ["schema_name", "object_name"], "left")
    return structure.table_roles(tables, sized, table_metrics_of(spark, sf), strict).drop("schema_name")


@registry.add(with_extra(_CATALOGUE, _METRICS, roles_sql(False)))
def table_roles(spark, sf):
    return _roles(spark, sf, False)


@registry.add(with_extra(_CATALOGUE, _METRICS, roles_sql(True)))
def table_roles_strict(spark, sf):
    return _roles(spark, sf, True)


@registry.add(
    with_inputs(
        "cat_columns",
        """WITH names AS (SELECT DISTINCT object_name, lower(column_name) AS name FROM cat_columns),
sets AS (SELECT object_name, list_sort(list(name)) AS names, count(*) AS width FROM names GROUP BY 1),
heads AS (SELECT *, min(object_name) OVER (PARTITION BY names) AS head FROM sets),
firsts AS (SELECT * FROM heads WHERE object_name = head),
tokens AS (SELECT object_name, width, unnest(names) AS name FROM firsts),
shared AS (SELECT l.object_name AS left_object, r.object_name AS right_object, l.width AS lw, r.width AS rw, count(*) AS shared_names
  FROM tokens l JOIN tokens r ON r.name = l.name AND l.object_name < r.object_name GROUP BY 1, 2, 3, 4)
SELECT left_object, right_object, shared_names, shared_names / (lw + rw - shared_names) AS similarity FROM shared
  WHERE shared_names / (lw + rw - shared_names) >= 0.75
UNION ALL SELECT head, object_name, width, 1.0::DOUBLE FROM heads WHERE object_name <> head""",
    )
)
def table_similarity(spark, sf):
    found = structure.table_similarity(derived(spark, sf, "cat_columns"), 0.75)
    return found.select("left_object", "right_object", "shared_names", "similarity")


@registry.add(
    with_inputs(
        "cat_tables",
        f"SELECT object_name, CAST({KNOWN.replace('row_count', 'row_count')} AS BIGINT) AS row_count, CAST(NULL AS VARCHAR) AS note FROM cat_tables "
        "WHERE NOT regexp_matches(row_count, '[a-z]')",
    )
)
def project_declared_columns(spark, sf):
    tables = derived(spark, sf, "cat_tables").where("NOT row_count rlike '[a-z]'")
    known = tables.withColumn("row_count", profile.known_row_estimate(F.col("row_count")))
    return project_declared(known, "object_name string, row_count bigint, note string")


# --- quality ------------------------------------------------------------------------------------

_PROFILED = ("label", "digit", "status", "negative", "constant", "missing")


def _profile_rows(spark, sf) -> DataFrame:
    measured = profile.column_profile(derived(spark, sf, "blank_orders"), "blank_orders", _PROFILED)
    skipped = profile.column_profile(table(spark, sf, "embeddings"), "embeddings", ["embedding", "label"])
    return measured.unionByName(skipped)


def _measured_sql(name: str, column: str, kind: str) -> str:
    m = measures_sql(name, column, kind)
    fields = ("total_rows", "non_null_count", "distinct_count", "empty_string_count", "whitespace_string_count", "negative_count")
    return f"SELECT '{name}.{column}' AS context, 'PROFILED' AS status, " + ", ".join(f"{m[f]} AS {f}" for f in fields) + f" FROM {name}"


_RISKS = (
    ", prof AS (" + "\nUNION ALL\n".join(
        [_measured_sql("blank_orders", c, KINDS["blank_orders"][c]) for c in _PROFILED]
        + [_measured_sql("embeddings", "label", "int"),
           "SELECT 'embeddings.embedding', 'SKIPPED_FOR_SAFETY_OR_TYPE', NULL, NULL, NULL, NULL, NULL, NULL"]
    ) + f"), orphaned AS ({ORPHANS}), nokey AS ({_NO_KEY}), "
    "defs AS (SELECT *, coalesce(definition, '') <> '' AS definition_available, "
    "coalesce(regexp_matches(definition, '(?i)\\bSP_EXECUTESQL\\b|\\bEXEC\\s*\\(|\\bEXECUTE\\s*\\('), false) AS dynamic FROM statements), risks AS ("
    + "\nUNION ALL\n".join(
        [
            "SELECT 'Medium' AS severity, 'Structure' AS category, schema_name || '.' || object_name AS object_context, 'A table lacks a primary key' AS observation, 'FACT' AS evidence_type, 'Some other column set may be unique' AS uncertainty FROM nokey",
            "SELECT 'High', 'Relationships', 'Shop', 'The catalogue shows no foreign key', 'FACT', 'Programs may check references, or rights hide the keys' FROM (SELECT count(*) AS n FROM cat_foreign_keys) WHERE n = 0",
            "SELECT CASE WHEN is_disabled THEN 'High' ELSE 'Medium' END, 'Constraint', source_schema || '.' || source_object || '.' || constraint_name, 'A foreign key is off or was not checked', 'FACT', 'As the catalogue stands' FROM cat_foreign_keys WHERE is_disabled OR is_not_trusted",
            "SELECT 'Low', 'Data Quality', context, 'No row has a value', 'DATA_VALIDATION', 'Holds for the rows read now' FROM prof WHERE status = 'PROFILED' AND total_rows > 0 AND non_null_count = 0",
            "SELECT 'Informational', 'Data Quality', context, 'Every value is the same', 'DATA_VALIDATION', 'Holds for the rows read now' FROM prof WHERE status = 'PROFILED' AND non_null_count > 0 AND distinct_count = 1",
            "SELECT 'Low', 'Data Quality', context, concat('Rows with an empty text: ', empty_string_count), 'DATA_VALIDATION', 'An empty text can be meant' FROM prof WHERE empty_string_count > 0",
            "SELECT 'Low', 'Data Quality', context, concat('Rows with blanks alone: ', whitespace_string_count - empty_string_count), 'DATA_VALIDATION', 'Holds for the rows read now' FROM prof WHERE whitespace_string_count > empty_string_count",
            "SELECT 'Informational', 'Numeric Range', context, concat('Rows below zero: ', negative_count), 'DATA_VALIDATION', 'No allowed range is known for the column' FROM prof WHERE negative_count > 0",
            "SELECT 'Informational', 'Coverage', context, 'Not profiled: ' || status, 'FACT', 'Nothing is known about its values' FROM prof WHERE starts_with(status, 'SKIPPED')",
            "SELECT CASE WHEN classification = 'DECLARED_FK' THEN 'Medium' ELSE 'Low' END, 'Relationships', source_table || '.' || source_column, concat('Rows that refer to nothing: ', orphan_rows), 'DATA_VALIDATION', 'A guessed reference may mean something else' FROM orphaned WHERE orphan_rows > 0",
            "SELECT 'Medium', 'Constraint', schema_name || '.' || object_name || '.' || constraint_name, 'A constraint is off or was not checked', 'FACT', 'As the catalogue stands' FROM cat_constraints WHERE is_disabled OR is_not_trusted",
            "SELECT 'Medium', 'Static Analysis', schema_name || '.' || object_name, 'The definition cannot be read', 'FACT', 'What it does and uses may be missing here' FROM defs WHERE NOT definition_available",
            "SELECT 'Medium', 'Dynamic SQL', schema_name || '.' || object_name, 'Builds statements while it runs', 'INFERENCE', 'Their targets are not known beforehand' FROM defs WHERE dynamic",
            "SELECT 'Medium', 'External Dependency', source_schema || '.' || source_object, 'Refers outside: ' || CASE WHEN target_server <> '' THEN 'FOUR_PART' ELSE 'THREE_PART' END, 'INFERENCE', 'The other system was not asked' FROM dependencies WHERE target_server <> '' OR target_database <> ''",
            "SELECT 'Medium', 'Access or Discovery Limitation', schema_name || '.' || object_name, CASE WHEN impact = '' THEN 'Nothing could be read' ELSE impact END, 'FACT', sanitized_message FROM error_texts",
        ]
    ) + ")"
)
_RISK_INPUTS = _PAIR + ("blank_orders", "cat_tables", "cat_primary_keys", "cat_foreign_keys", "cat_constraints", "statements", "dependencies", "error_texts")


def _definitions(spark, sf) -> DataFrame:
    from lakescribe.operators.statements import definition_flags

    return definition_flags(derived(spark, sf, "statements"))


def _risk_inputs(spark, sf) -> dict[str, DataFrame]:
    from lakescribe.operators.lineage import external_references

    nothing = derived(spark, sf, "synonyms").where("1 = 0")
    definitions = _definitions(spark, sf)
    return {
        "missing_keys": structure.tables_without_key(derived(spark, sf, "cat_tables"), derived(spark, sf, "cat_primary_keys")),
        "foreign_keys": derived(spark, sf, "cat_foreign_keys"),
        "profile": _profile_rows(spark, sf),
        "orphans": relations.orphan_analysis(validated(spark, sf)),
        "constraints": derived(spark, sf, "cat_constraints"),
        "definitions": definitions,
        "external": external_references(derived(spark, sf, "dependencies"), nothing, definitions.where("1 = 0")),
        "errors": derived(spark, sf, "error_texts"),
    }


@registry.add(with_extra(_RISK_INPUTS, _VALIDATED + _RISKS, "SELECT * FROM risks"))
def risk_register(spark, sf):
    return quality.risk_register("Shop", **_risk_inputs(spark, sf))


@registry.add(
    with_extra(
        _RISK_INPUTS, _VALIDATED + _RISKS,
        "SELECT 'tables_without_primary_key' AS metric, count(*) AS value FROM nokey "
        "UNION ALL SELECT 'declared_foreign_key_rows', count(*) FROM cat_foreign_keys "
        "UNION ALL SELECT 'profile_observations', count(*) FILTER (status = 'PROFILED') FROM prof "
        "UNION ALL SELECT 'orphan_analyses_with_unmatched_rows', count(*) FILTER (orphan_rows > 0) FROM orphaned "
        "UNION ALL SELECT 'disabled_or_untrusted_foreign_keys', count(*) FILTER (is_disabled OR is_not_trusted) FROM cat_foreign_keys "
        "UNION ALL SELECT 'dynamic_sql_objects', count(*) FILTER (dynamic) FROM defs "
        "UNION ALL SELECT 'risk_register_entries', count(*) FROM risks",
    )
)
def quality_summary(spark, sf):
    inputs = _risk_inputs(spark, sf)
    return quality.quality_summary(
        inputs["missing_keys"], inputs["foreign_keys"], inputs["profile"], inputs["orphans"],
        inputs["definitions"], quality.risk_register("Shop", **inputs),
    )


@registry.add(
    with_inputs(
        ("cat_tables", "statements", "dependencies", "error_texts", "cat_foreign_keys"),
        "SELECT 'tables_discovered' AS metric, count(*) AS value FROM cat_tables UNION ALL SELECT 'tables_profiled', 2 "
        "UNION ALL SELECT 'samples_attempted', 2 UNION ALL SELECT 'sample_status_SAMPLED', 1 UNION ALL SELECT 'sample_status_EMPTY', 1 "
        "UNION ALL SELECT 'column_profile_rows', 8 UNION ALL SELECT 'programmable_objects', count(*) FROM statements "
        "UNION ALL SELECT 'lineage_edges', count(*) FROM dependencies UNION ALL SELECT 'relationship_rows', count(*) FROM cat_foreign_keys "
        "UNION ALL SELECT 'recorded_errors', count(*) FROM error_texts",
    )
)
def coverage_summary(spark, sf):
    customers = table(spark, sf, "customer")
    samples = sampling.sample_index(customers, "customer", 10, ["c_custkey"]).unionAll(
        sampling.sample_index(customers.where("c_custkey < 0"), "nobody", 10, ["c_custkey"])
    )
    return quality.coverage_summary(
        derived(spark, sf, "cat_tables"), _profile_rows(spark, sf), samples, derived(spark, sf, "statements"),
        derived(spark, sf, "dependencies"), derived(spark, sf, "cat_foreign_keys"), derived(spark, sf, "error_texts"),
    )


@registry.add(
    with_inputs(
        ("cat_tables", "cat_columns", "cat_foreign_keys", "statements", "error_texts"),
        "\nUNION ALL\n".join(
            f"SELECT '{m}' AS metric, count(*) AS value FROM {t}" for m, t in (
                ("tables", "cat_tables"), ("columns", "cat_columns"), ("declared_foreign_key_rows", "cat_foreign_keys"),
                ("views", "statements WHERE source_type = 'VIEW'"), ("errors", "error_texts"),
            )
        ),
    )
)
def database_summary(spark, sf):
    return quality.database_summary(
        {
            "tables": derived(spark, sf, "cat_tables"), "columns": derived(spark, sf, "cat_columns"),
            "declared_foreign_key_rows": derived(spark, sf, "cat_foreign_keys"),
            "views": derived(spark, sf, "statements").where("source_type = 'VIEW'"),
            "errors": derived(spark, sf, "error_texts"),
        }
    )


# --- browsing -----------------------------------------------------------------------------------


_PART_MATCH = " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), 'ring')" for c in KINDS["part"])


@registry.add(
    f"SELECT * FROM part WHERE {_PART_MATCH} ORDER BY lower(coalesce(p_brand, '')) DESC, p_partkey LIMIT 40 OFFSET 40"
)
def browse_rows(spark, sf):
    """The second page of 40: paging is the operator."""
    return browse.browse_rows(
        table(spark, sf, "part"), "RING", sort="p_brand", descending=True, page=2, per_page=40,
        tiebreak=("p_partkey",),
    )


@registry.add(f"SELECT count(*) AS total FROM part WHERE {_PART_MATCH}")
def browse_total(spark, sf):
    return browse.browse_total(table(spark, sf, "part"), "ring")


@registry.add(
    "SELECT doc_id, CAST(i AS INTEGER) AS line_number, md5(lines[i]) AS digest FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM "
    "(SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS lines FROM documents)) WHERE contains(lower(lines[i]), 'license')"
)
def search_lines(spark, sf):
    found = browse.search_lines(table(spark, sf, "documents"), "doc_id", "text", "License")
    return found.select("doc_id", "line_number", F.md5("text").alias("digest"))


_SOME_VIEWS = (
    "SELECT 'dbo' AS schema_name, concat('o', o_orderkey) AS object_name, CASE WHEN o_orderkey % 4 = 0 THEN 'VIEW' ELSE 'USER_TABLE' END AS object_type, "
    "'part_id' AS column_name, 'int' AS data_type, false AS is_nullable, false AS is_identity, false AS is_computed FROM {orders}"
)


def _some_views(spark, sf):
    return spark.sql(_SOME_VIEWS, orders=table(spark, sf, "orders"))


@registry.add("SELECT concat('o', o_orderkey) AS object_name, CAST(1 AS INTEGER) AS column_count FROM orders WHERE o_orderkey % 4 <> 0")
def table_shape_without_views(spark, sf):
    return profile.table_shape(_some_views(spark, sf)).select("object_name", "column_count")


@registry.add("SELECT concat('o', o_orderkey) AS source_object FROM orders WHERE o_orderkey % 4 <> 0")
def infer_relationships_without_views(spark, sf):
    """Views are no sources; the one unique column of a table named part is every table's target."""
    part = _some_views(spark, sf).limit(1).select(
        "schema_name", F.lit("part").alias("object_name"), F.lit("USER_TABLE").alias("object_type"), F.lit("part_id").alias("column_name"),
        "data_type", "is_nullable", "is_identity", "is_computed")
    unique = part.select("schema_name", "object_name", "column_name", F.lit("PRIMARY_KEY").alias("unique_evidence"))
    return relations.infer_relationships(_some_views(spark, sf).unionByName(part), unique).select("source_object")


@registry.add(
    with_inputs(
        "cat_primary_keys",
        "SELECT schema_name, object_name, constraint_name, CAST(key_ordinal AS INTEGER) AS key_ordinal, column_name, CAST(NULL AS BOOLEAN) AS is_descending_key FROM cat_primary_keys",
    )
)
def declared_primary_keys(spark, sf):
    keys = derived(spark, sf, "cat_primary_keys")
    return sources.declared_keys(keys, keys.limit(0))[0]


@registry.add(
    with_inputs(
        "cat_foreign_keys",
        "SELECT source_schema, source_object, constraint_name, CAST(NULL AS INTEGER) AS constraint_column_id, source_column, target_schema, target_object, target_column, "
        "CAST(NULL AS VARCHAR) AS delete_action, CAST(NULL AS VARCHAR) AS update_action, is_disabled, is_not_trusted FROM cat_foreign_keys",
    )
)
def declared_foreign_keys(spark, sf):
    keys = derived(spark, sf, "cat_foreign_keys")
    return sources.declared_keys(keys.limit(0), keys)[1]


@registry.add(
    with_inputs(
        "cat_indexes",
        "SELECT schema_name, object_name, index_id, index_name, CAST(NULL AS INTEGER) AS column_ordinal, column_name, key_ordinal, is_unique, is_included_column, has_filter, is_disabled FROM cat_indexes",
    )
)
def unique_index_columns(spark, sf):
    return sources.unique_index_columns(derived(spark, sf, "cat_indexes"))


@registry.add(
    with_inputs(
        "cat_constraints",
        "SELECT schema_name, object_name, constraint_name, kind AS constraint_type, CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS definition, is_disabled, is_not_trusted "
        "FROM cat_constraints, (VALUES ('CHECK'), ('KEY')) AS k(kind) WHERE kind = 'CHECK' OR is_disabled",
    )
)
def constraint_catalogue(spark, sf):
    rows = derived(spark, sf, "cat_constraints")
    return sources.constraint_catalogue(rows, rows.limit(0), rows.where("is_disabled"))
