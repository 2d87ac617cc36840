"""Statements, job steps and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakescribe.functions import fixed_values as fixed
from lakescribe.operators import jobs, lineage, statements
from lakescribe.plans import discovery
from lakescribe.sources.shared import dealt, materialize
from lakescribe.sources.workspace import Workspace

from .inputs import Registry, derived, table, with_inputs
from .sensitivity_checks import redact_sql

registry = Registry()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_extra(names, extra: str, body: str) -> str:
    base = with_inputs(names, "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + extra + body


def _flag(text: str, pattern: str, alias: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)}) AS {alias}"


_SANITIZED = "regexp_replace({r}, {p}, '\\1=''[REDACTED]''', 'g')".format(
    r=redact_sql("text"), p=lit(fixed.QUOTED_SECRET_ASSIGNMENT)
)
FLAGS = f"""
, flags AS (SELECT statement_id, schema_name, object_name, source_type, text <> '' AS definition_available,
  CASE WHEN text <> '' THEN sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) ELSE '' END AS definition_sha256,
  {_SANITIZED} AS definition_sanitized, {_flag('text', fixed.DYNAMIC_DEFINITION, 'dynamic_sql_present')},
  contains(text, '#') AS temp_table_present, {_flag('text', '(?i)BEGIN\\s+TRAN|COMMIT|ROLLBACK', 'transaction_logic_present')},
  {_flag('text', '(?i)\\bTRY\\b|\\bCATCH\\b|\\bTHROW\\b|\\bRAISERROR\\b', 'error_handling_present')},
  {_flag('text', '(?i)\\bINSERT\\b|\\bUPDATE\\b|\\bDELETE\\b|\\bMERGE\\b', 'likely_write_logic')}
  FROM (SELECT *, coalesce(definition, '') AS text FROM statements))
"""


def flags_of(spark, sf) -> DataFrame:
    return statements.definition_flags(derived(spark, sf, "statements"))


def shared_flags_of(spark, sf) -> DataFrame:
    """What references and lineage use of the same rows, read off the statements once."""
    used = ("statement_id", "schema_name", "object_name", "source_type", "definition_sanitized")
    return materialize(statements.definition_flags(dealt(derived(spark, sf, "statements"))).select(*used), "definitions")


@registry.add(with_extra("statements", FLAGS, "SELECT * FROM flags"))
def definition_flags(spark, sf):
    return flags_of(spark, sf)


def _part_list(raw: str) -> str:
    return f"list_transform(string_split(regexp_replace({raw}, '\\s+', '', 'g'), '.'), lambda p: trim(p, '[]'))"


def _found_sql(text: str, source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT statement_id, '{op}' AS operation, unnest(regexp_extract_all({text}, {lit(p)}, 1)) AS raw, "
        f"generate_subscripts(regexp_extract_all({text}, {lit(p)}, 1), 1) AS place FROM {source}"
        for op, p in statements.REFERENCE_PATTERNS
    )


REFERENCES = f"""
, found AS ({_found_sql('definition_sanitized', 'flags')}),
split AS (SELECT *, {_part_list('raw')} AS parts FROM found),
named AS (SELECT statement_id, operation, place, CASE WHEN len(parts) = 4 THEN parts[1] ELSE '' END AS target_server,
  CASE WHEN len(parts) IN (3, 4) THEN parts[-3] ELSE '' END AS target_database,
  CASE WHEN len(parts) IN (2, 3, 4) THEN parts[-2] ELSE '' END AS target_schema,
  CASE WHEN len(parts) <= 4 THEN parts[-1] ELSE parts[1] END AS target_object
  FROM split WHERE NOT regexp_matches(parts[-1], '^[#@]')),
latest AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY statement_id, operation, lower(target_server), lower(target_database),
  lower(target_schema), lower(target_object) ORDER BY place DESC) = 1),
refs AS (SELECT schema_name AS source_schema, object_name AS source_object, source_type, operation, target_server, target_database, target_schema,
  target_object, 'STATIC_DEFINITION_' || operation AS evidence FROM latest JOIN flags USING (statement_id))
"""


@registry.add(with_extra("statements", FLAGS + REFERENCES, "SELECT * FROM refs"))
def object_references(spark, sf):
    return statements.object_references(flags_of(spark, sf))


# Positions of the matches are the lengths of what lies before them.
_TOKEN = fixed.NAME_PART
_QUALIFIED = f"({_TOKEN})\\s*\\.\\s*({_TOKEN})"
COLUMN_REFERENCES = f"""
, texts AS (SELECT statement_id, definition_sanitized AS text FROM flags WHERE definition_sanitized <> ''),
pieces AS (SELECT statement_id, text, regexp_extract_all(text, {lit(_QUALIFIED)}, 0) AS whole, regexp_extract_all(text, {lit(_QUALIFIED)}, 1) AS qualifiers,
  regexp_extract_all(text, {lit(_QUALIFIED)}, 2) AS columns, string_split_regex(text, {lit(_QUALIFIED.replace('(' + _TOKEN + ')', _TOKEN))}) AS gaps FROM texts),
uses AS (SELECT statement_id, text, unnest(generate_series(1, len(whole))) AS i, whole, qualifiers, columns, gaps FROM pieces WHERE len(whole) > 0),
placed AS (SELECT statement_id, text, whole[i] AS word, lower(trim(qualifiers[i], '[]')) AS qualifier, trim(columns[i], '[]') AS column_name,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0) AS BIGINT) AS start FROM uses),
seen AS (SELECT *, substring(text, greatest(start - 100, 0) + 1, start - greatest(start - 100, 0)) AS before,
  substring(text, greatest(start - 100, 0) + 1, start + length(word) + 100 - greatest(start - 100, 0)) AS around FROM placed),
typed AS (SELECT *, CASE WHEN regexp_matches(before, '(?i)\\b(SUM|AVG|MIN|MAX|COUNT)\\s*\\([^)]*$') THEN 'AGGREGATED'
  WHEN regexp_matches(around, '(?i)\\bCASE\\b') THEN 'CONDITIONAL'
  WHEN regexp_matches(around, '(?i)' || regexp_escape(word) || '\\s*[+*/-]|[+*/-]\\s*' || regexp_escape(word)) THEN 'DERIVED' ELSE 'DIRECT' END AS lineage_type FROM seen),
mentions AS (SELECT statement_id, unnest(regexp_extract_all(text, {lit(statements.ALIAS_PATTERN)}, 1)) AS raw, unnest(regexp_extract_all(text, {lit(statements.ALIAS_PATTERN)}, 2)) AS alias,
  generate_subscripts(regexp_extract_all(text, {lit(statements.ALIAS_PATTERN)}, 1), 1) AS place FROM texts),
tables AS (SELECT DISTINCT schema_name, object_name FROM known_columns),
resolved AS (SELECT m.*, t.schema_name, t.object_name FROM (SELECT *, {_part_list('raw')} AS parts FROM mentions) m JOIN tables t
  ON (len(parts) = 2 AND lower(parts[1]) = lower(t.schema_name) AND lower(parts[2]) = lower(t.object_name))
  OR (len(parts) = 1 AND lower(parts[1]) = lower(t.object_name) AND (SELECT count(*) FROM tables u WHERE lower(u.object_name) = lower(t.object_name)) = 1)),
aliases AS (SELECT statement_id, place, 0 AS turn, lower(object_name) AS qualifier, schema_name, object_name FROM resolved
  UNION ALL SELECT statement_id, place, 1, lower(trim(alias, '[]')), schema_name, object_name FROM resolved
  WHERE coalesce(alias, '') <> '' AND lower(trim(alias, '[]')) NOT IN ({', '.join(lit(w) for w in fixed.ALIAS_STOP_WORDS)})),
latest_alias AS (SELECT * FROM aliases QUALIFY row_number() OVER (PARTITION BY statement_id, qualifier ORDER BY place DESC, turn DESC) = 1),
used AS (SELECT t.statement_id, a.schema_name AS target_schema, a.object_name AS target_object, t.column_name AS target_column, lineage_type, start
  FROM typed t JOIN latest_alias a USING (statement_id, qualifier)
  WHERE EXISTS (SELECT 1 FROM known_columns k WHERE k.schema_name = a.schema_name AND k.object_name = a.object_name AND lower(k.column_name) = lower(t.column_name))
  QUALIFY row_number() OVER (PARTITION BY t.statement_id, a.schema_name, a.object_name, lower(t.column_name), lineage_type ORDER BY start DESC) = 1),
column_refs AS (SELECT f.schema_name AS source_schema, f.object_name AS source_object, source_type, target_schema, target_object, target_column, lineage_type,
  'STATIC_ALIAS_QUALIFIED_COLUMN_REFERENCE' AS evidence FROM used JOIN flags f USING (statement_id))
"""


def column_refs_of(spark, sf, flags: DataFrame | None = None) -> DataFrame:
    return statements.column_references(
        flags or flags_of(spark, sf), derived(spark, sf, "known_columns"), statement_id="statement_id"
    )


@registry.add(with_extra(("statements", "known_columns"), FLAGS + COLUMN_REFERENCES, "SELECT * FROM column_refs"))
def column_references(spark, sf):
    return column_refs_of(spark, sf)


# --- statement safety ---------------------------------------------------------------------------

_SPANS = (
    r"""--[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|'[^']*(?:''[^']*)*'|"[^"]*(?:""[^"]*)*"|\[[^\]]*(?:\]\][^\]]*)*\]"""
)
_TOKENS = "[" + ", ".join(lit(t) for t in fixed.FORBIDDEN_TOKENS) + "]"
_PHRASES = " ".join(
    f"WHEN regexp_matches(body, {lit('(?i)' + p)}) THEN {lit('Forbidden SQL construct: ' + p)}" for p in fixed.FORBIDDEN_PHRASES
)


@registry.add(
    with_inputs(
        "statements",
        f"""WITH scrubbed AS (SELECT statement_id, coalesce(definition, '') AS text, regexp_replace(coalesce(definition, ''), {lit(_SPANS)}, ' ', 'g') AS scrubbed FROM statements),
bodies AS (SELECT *, regexp_extract(scrubbed, '([''"\\[]|/\\*)', 1) AS opened,
  regexp_replace(regexp_replace(scrubbed, '\\A\\s+|\\s+\\z', '', 'g'), '\\s*;\\z', '') AS body FROM scrubbed),
tokens AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(body, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda t: upper(t)),
  lambda t: list_contains({_TOKENS}, t)))) AS forbidden, upper(regexp_extract(body, '\\A([A-Za-z]+)', 1)) AS first FROM bodies),
judged AS (SELECT statement_id, CASE WHEN regexp_matches(text, '\\A\\s*\\z') THEN 'SQL must be a non-empty string'
  WHEN opened = '''' THEN 'Unterminated SQL string' WHEN opened = '"' THEN 'Unterminated SQL quoted identifier'
  WHEN opened = '[' THEN 'Unterminated SQL bracket identifier' WHEN opened = '/*' THEN 'Unterminated SQL block comment'
  WHEN regexp_matches(scrubbed, '\\A\\s*\\z') THEN 'SQL contains no executable statement'
  WHEN contains(body, ';') THEN 'Multiple SQL statements are not allowed'
  WHEN first NOT IN ('SELECT', 'WITH') THEN 'Only SELECT or WITH ... SELECT statements are allowed'
  WHEN first = 'WITH' AND NOT regexp_matches(body, '(?i)\\bSELECT\\b') THEN 'A CTE must resolve to a SELECT statement'
  WHEN len(forbidden) > 0 THEN 'Forbidden SQL token(s): ' || array_to_string(forbidden, ', ') {_PHRASES} END AS reason FROM tokens)
SELECT statement_id, reason IS NULL AS is_read_only, reason FROM judged""",
    )
)
def statement_safety(spark, sf):
    judged = statements.statement_safety(derived(spark, sf, "statements"))
    return judged.select("statement_id", "is_read_only", "reason")


# --- job steps ---------------------------------------------------------------------------------

_JOB_SPANS = r"""--[^\r\n]*|/\*[^*]*(?:\*+[^/*][^*]*)*(?:\*+/|\*?\z)|'[^']*(?:''[^']*)*(?:'|\z)"""
_KIND = (
    "CASE subsystem WHEN 'POWERSHELL' THEN 'POWERSHELL_OPAQUE' WHEN 'CMDEXEC' THEN 'CMDEXEC_OPAQUE' WHEN 'SSIS' THEN 'SSIS_OPAQUE' ELSE 'EXTERNAL_OPAQUE' END"
)
_HINT = (
    "CASE subsystem WHEN 'POWERSHELL' THEN 'PowerShell invocation; command and arguments redacted' WHEN 'CMDEXEC' THEN 'CmdExec invocation; command and arguments redacted' "
    "WHEN 'SSIS' THEN 'SSIS package invocation; location and arguments redacted' ELSE subsystem || ' invocation; command and arguments redacted' END"
)
_NO_TARGET = "'' AS target_server, '' AS target_database, '' AS target_schema, '' AS target_object"
STEPS = f"""
, steps AS (SELECT job_name, step_id, step_name, upper(subsystem) AS subsystem, coalesce(command, '') AS command, database_name, schedule_name,
  CASE WHEN upper(subsystem) = 'TSQL' THEN regexp_replace(coalesce(command, ''), {lit(_JOB_SPANS)}, ' ', 'g') ELSE '' END AS scrubbed FROM job_steps),
staged AS (SELECT *, regexp_matches(scrubbed, {lit(fixed.DYNAMIC_JOB_STEP)}) AS dynamic FROM steps),
found AS ({chr(10).join(' UNION ALL '.join(
    f"SELECT step_id, '{op}' AS operation, {turn} AS turn, unnest(regexp_extract_all(scrubbed, {lit(p)}, 1)) AS raw, generate_subscripts(regexp_extract_all(scrubbed, {lit(p)}, 1), 1) AS place FROM staged"
    for turn, (op, p) in enumerate(jobs.REFERENCE_PATTERNS)).splitlines())}),
kept AS (SELECT *, list_transform(regexp_extract_all(raw, {lit(fixed.JOB_NAME_PART)}, 0), lambda p: CASE WHEN starts_with(p, '[') THEN replace(substring(p, 2, length(p) - 2), ']]', ']') ELSE p END) AS parts
  FROM found WHERE NOT (operation = 'READ' AND lower(raw) IN ('openquery', 'openrowset', 'opendatasource')) AND NOT (operation = 'CALL' AND lower(raw) IN ('sp_executesql', 'sys.sp_executesql'))),
named AS (SELECT k.step_id, operation, turn, place, CASE WHEN len(parts) = 4 THEN '[EXTERNAL_SERVER:' || upper(substr(sha256(parts[1]), 1, 12)) || ']' ELSE '' END AS target_server,
  CASE WHEN len(parts) >= 3 THEN parts[-3] ELSE database_name END AS target_database, CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE '' END AS target_schema, parts[-1] AS target_object,
  CASE len(parts) WHEN 4 THEN 'FOUR_PART' WHEN 3 THEN 'THREE_PART' WHEN 2 THEN 'TWO_PART' ELSE 'UNQUALIFIED' END AS reference_kind,
  len(parts) = 4 OR (len(parts) = 3 AND (database_name = '' OR lower(parts[-3]) <> lower(database_name))) AS external_reference,
  'STATIC TSQL TOKEN REFERENCE; NEVER EXECUTED' AS evidence, CASE WHEN len(parts) = 1 THEN 'LOW' ELSE 'MEDIUM' END AS confidence
  FROM kept k JOIN staged s USING (step_id)),
firsts AS (SELECT * EXCLUDE (turn, place) FROM named QUALIFY row_number() OVER (PARTITION BY step_id, operation, lower(target_server), lower(target_database), lower(target_schema), lower(target_object) ORDER BY turn, place) = 1),
constructs AS (SELECT step_id, upper(unnest(regexp_extract_all(scrubbed, '(?i)\\b(OPENQUERY|OPENROWSET|OPENDATASOURCE)\\s*\\(', 1))) AS word FROM staged),
items AS (SELECT * FROM firsts
  UNION ALL SELECT step_id, 'READ', '[STATIC_TEXT_REDACTED]', '', '', '', word, true, word || ' STATIC INVOCATION DETECTED; ARGUMENTS OPAQUE; NEVER EXECUTED', 'LOW' FROM constructs
  UNION ALL SELECT step_id, 'OPAQUE', '', '', '', '', 'DYNAMIC_SQL', false, 'DYNAMIC SQL DETECTED; TEXT NOT INTERPRETED OR EXECUTED', 'LOW' FROM staged WHERE dynamic
  UNION ALL SELECT step_id, 'OPAQUE', '', '', '', '', CASE WHEN subsystem = 'SSIS' THEN 'SSIS_PACKAGE' ELSE 'EXTERNAL_INVOCATION' END, true, {_KIND} || '; COMMAND AND ARGUMENTS REDACTED; NEVER EXECUTED', 'LOW' FROM staged WHERE subsystem <> 'TSQL'),
job_refs AS (SELECT job_name, i.step_id, step_name, subsystem, database_name AS source_database, operation, target_server, target_database, target_schema, target_object, reference_kind, external_reference,
  dynamic AS dynamic_sql_opaque, evidence, 'INFERENCE' AS evidence_class, confidence, schedule_name,
  CASE WHEN subsystem = 'TSQL' AND dynamic THEN 'dynamic TSQL; text treated as opaque' WHEN subsystem = 'TSQL' THEN 'static TSQL parsed without execution' ELSE {_HINT} END AS invocation_hint
  FROM items i JOIN staged s USING (step_id)),
edges AS (SELECT *, coalesce(nullif(concat_ws('.', nullif(target_server, ''), nullif(target_database, ''), nullif(target_schema, ''), nullif(target_object, '')), ''), 'UNKNOWN') AS target FROM job_refs),
flows AS (SELECT job_name, step_id, step_name, subsystem, 'SQL Agent job: ' || job_name AS origin, CASE WHEN operation = 'READ' THEN target ELSE 'UNKNOWN' END AS source,
  CASE WHEN operation = 'CALL' THEN 'CALL ' || target WHEN operation = 'OPAQUE' THEN invocation_hint ELSE step_name END AS transformation,
  CASE WHEN operation = 'WRITE' THEN target ELSE 'UNKNOWN' END AS destination, CASE WHEN schedule_name = '' THEN 'UNKNOWN' ELSE schedule_name END AS schedule, operation,
  evidence AS read_write_evidence, external_reference AS external_dependency, CASE WHEN operation = 'OPAQUE' THEN 'OPAQUE_EXTERNAL_STEP' ELSE 'POSSIBLE_PIPELINE' END AS classification,
  confidence, evidence_class, reference_kind, dynamic_sql_opaque FROM edges)
"""


@registry.add(with_extra("job_steps", STEPS, "SELECT * EXCLUDE (schedule_name, invocation_hint) FROM job_refs"))
def job_step_references(spark, sf):
    return jobs.job_step_references(derived(spark, sf, "job_steps"))


@registry.add(with_extra("job_steps", STEPS, "SELECT * FROM flows"))
def flow_edges(spark, sf):
    return jobs.flow_edges(derived(spark, sf, "job_steps"))


_SAFE_TEXT = (
    f"subsystem = 'TSQL' AND command <> '' AND NOT dynamic AND command = regexp_replace({redact_sql('command')}, {lit(fixed.SECRET_ARGUMENT)}, '\\1=[REDACTED]', 'g') "
    f"AND NOT regexp_matches(command, '[''\"]|--|/\\*|\\*/') AND NOT regexp_matches(command, {lit(fixed.SECRET_WORD)}) AND NOT regexp_matches(command, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')"
)


@registry.add(
    with_extra(
        "job_steps", STEPS,
        f"SELECT job_name, step_id, step_name, subsystem, database_name, schedule_name, upper(sha256(command)) AS command_sha256, "
        f"CASE WHEN {_SAFE_TEXT} THEN command ELSE '' END AS command_text_sanitized, "
        f"CASE WHEN subsystem = 'TSQL' AND dynamic THEN 'dynamic TSQL; text treated as opaque' WHEN subsystem = 'TSQL' THEN 'static TSQL parsed without execution' ELSE {_HINT} END AS invocation_hint, "
        f"CASE WHEN subsystem = 'TSQL' AND dynamic THEN 'DYNAMIC_TSQL_OPAQUE' WHEN subsystem = 'TSQL' THEN 'STATIC_TSQL' ELSE {_KIND} END AS command_classification, dynamic AS dynamic_sql_opaque FROM staged",
    )
)
def job_catalogue(spark, sf):
    return jobs.job_catalogue(derived(spark, sf, "job_steps"))


# --- lineage -------------------------------------------------------------------------------------

_HIDDEN = "CASE WHEN coalesce(target_server, '') <> '' THEN '[EXTERNAL_SERVER:' || substr(sha256(target_server), 1, 12) || ']' ELSE '' END"
_DEP_FIELDS = (
    "source_schema", "source_object", "source_type", "source_column_id", "target_database", "target_schema", "target_object",
    "target_column", "referenced_id", "operation",
)
_KEY = "concat_ws('|', lower({t}source_schema), lower({t}source_object), lower({t}target_database), lower({t}target_schema), lower({t}target_object))"
MERGED = f"""
, missing AS (SELECT * FROM refs r WHERE {_KEY.format(t='r.')} NOT IN (SELECT {_KEY.format(t='d.')} FROM dependencies d)
  QUALIFY row_number() OVER (PARTITION BY {_KEY.format(t='r.')} ORDER BY list_position(['WRITE', 'READ', 'CALL'], operation), target_server, source_schema, source_object, target_database, target_schema, target_object) = 1),
merged AS (SELECT source_schema, source_object, source_type, source_column_id, {_HIDDEN} AS target_server, target_database, target_schema, target_object, target_column, referenced_id, CAST(NULL AS VARCHAR) AS operation, CAST(NULL AS VARCHAR) AS evidence FROM dependencies
  UNION ALL SELECT source_schema, source_object, source_type, NULL, {_HIDDEN}, target_database, target_schema, target_object, NULL, NULL, operation, evidence FROM missing)
"""
_STATEMENT_REFS = FLAGS + REFERENCES


def merged_of(spark, sf, flags: DataFrame | None = None) -> DataFrame:
    refs = statements.object_references(flags or flags_of(spark, sf))
    return lineage.merge_dependencies(derived(spark, sf, "dependencies"), refs)


@registry.add(
    with_extra(("statements", "dependencies"), _STATEMENT_REFS + MERGED, f"SELECT {', '.join(_DEP_FIELDS)}, target_server FROM merged")
)
def merge_dependencies(spark, sf):
    return merged_of(spark, sf).select(*_DEP_FIELDS, "target_server")


_SOURCE_COLUMNS = "SELECT schema_name, object_name, CAST(row_number() OVER (PARTITION BY schema_name, object_name ORDER BY column_name) AS INT) AS column_id, column_name FROM {t}"
LINEAGE = f"""
, view_columns AS ({_SOURCE_COLUMNS.format(t='''(SELECT DISTINCT source_schema AS schema_name, source_object AS object_name, target_object AS column_name FROM dependencies)''')}),
edges_of AS (SELECT m.*, c.column_name AS found_column, coalesce(f.definition_sanitized, '') AS text FROM merged m
  LEFT JOIN view_columns c ON c.schema_name = m.source_schema AND c.object_name = m.source_object AND c.column_id = m.source_column_id
  LEFT JOIN flags f ON f.schema_name = m.source_schema AND f.object_name = m.source_object),
catalogue_lineage AS (SELECT source_schema, source_object, source_type, coalesce(found_column, '') AS source_column, target_server, target_database, target_schema, target_object, target_column,
  coalesce(nullif(operation, ''), 'REFERENCE') AS relationship,
  CASE WHEN found_column IS NOT NULL AND coalesce(target_column, '') <> '' THEN 'DIRECT' WHEN coalesce(target_column, '') = '' THEN 'UNKNOWN'
    WHEN regexp_matches(text, '(?i)\\b(SUM|AVG|MIN|MAX|COUNT)\\s*\\(') THEN 'AGGREGATED' WHEN regexp_matches(text, '(?i)\\bCASE\\b') THEN 'CONDITIONAL'
    WHEN regexp_matches(text, '[+*/-]') THEN 'DERIVED' ELSE 'UNKNOWN' END AS lineage_type,
  coalesce(nullif(evidence, ''), 'CATALOGUE_DEPENDENCY') AS evidence,
  CASE WHEN coalesce(referenced_id, '') <> '' THEN 'HIGH' WHEN coalesce(target_schema, '') <> '' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN coalesce(referenced_id, '') <> '' THEN 'FACT' ELSE 'INFERENCE' END AS evidence_class FROM edges_of)
"""


def catalogue_lineage_of(spark, sf, flags: DataFrame | None = None) -> DataFrame:
    flags = flags or shared_flags_of(spark, sf)
    named = derived(spark, sf, "dependencies").selectExpr(
        "source_schema AS schema_name", "source_object AS object_name", "target_object AS column_name"
    ).repartition("schema_name", "object_name").distinct()  # dealt once, as their numbers are an object's
    columns = spark.sql(_SOURCE_COLUMNS.replace("{t}", "{named}"), named=named)
    return lineage.merged_column_lineage(
        derived(spark, sf, "dependencies"), statements.object_references(flags), columns, flags)


_LINEAGE_INPUTS = ("statements", "dependencies")


@registry.add(with_extra(_LINEAGE_INPUTS, _STATEMENT_REFS + MERGED + LINEAGE, "SELECT * FROM catalogue_lineage"))
def catalogue_column_lineage(spark, sf):
    return catalogue_lineage_of(spark, sf)


_ALL_EDGES = """
, every AS (SELECT * FROM catalogue_lineage
  UNION ALL SELECT source_schema, source_object, source_type, 'EXPRESSION_OUTPUT_UNKNOWN', '', '', target_schema, target_object, target_column, 'COLUMN_REFERENCE', lineage_type, evidence, 'MEDIUM', 'INFERENCE' FROM column_refs
  UNION ALL SELECT 'SQL_AGENT', job_name, 'SQL_AGENT_STEP', concat('step ', step_id, ': ', step_name), target_server, target_database, target_schema, target_object, '', operation, 'UNKNOWN', evidence, confidence, evidence_class FROM job_refs)
"""
_EDGE_INPUTS = ("statements", "dependencies", "known_columns", "job_steps")
# The two families of CTEs use some names twice; job steps get their own.
_JOB_CTES = STEPS.replace("found AS", "job_found AS").replace("FROM found WHERE NOT", "FROM job_found WHERE NOT").replace(
    "named AS (SELECT k.", "job_named AS (SELECT k."
).replace("FROM named QUALIFY row_number() OVER (PARTITION BY step_id", "FROM job_named QUALIFY row_number() OVER (PARTITION BY step_id")
EVERY_EDGE = _STATEMENT_REFS + MERGED + LINEAGE + COLUMN_REFERENCES + _JOB_CTES + _ALL_EDGES


def edges_of(spark, sf) -> DataFrame:
    flags = shared_flags_of(spark, sf)
    return lineage.lineage_edges(
        catalogue_lineage_of(spark, sf, flags), column_refs_of(spark, sf, flags),
        jobs.job_step_references(dealt(derived(spark, sf, "job_steps"))),
    )


@registry.add(with_extra(_EDGE_INPUTS, EVERY_EDGE, "SELECT * FROM every"))
def lineage_edges(spark, sf):
    return edges_of(spark, sf)


@registry.add(
    with_extra(
        _EDGE_INPUTS, EVERY_EDGE,
        "SELECT kind AS lineage_type, count(e.lineage_type) AS edges FROM (VALUES ('DIRECT'), ('DERIVED'), ('AGGREGATED'), ('CONDITIONAL'), ('UNKNOWN')) AS k(kind) LEFT JOIN every e ON e.lineage_type = kind GROUP BY 1",
    )
)
def lineage_type_counts(spark, sf):
    return lineage.lineage_type_counts(edges_of(spark, sf))


@registry.add(
    with_inputs(
        "dependencies",
        "SELECT object_name, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound, CAST(sum(i) + sum(o) AS BIGINT) AS total_edges, "
        "'STRUCTURAL_CENTRALITY_NOT_BUSINESS_CRITICALITY' AS interpretation FROM (SELECT source_schema || '.' || source_object AS object_name, 0 AS i, 1 AS o FROM dependencies "
        "UNION ALL SELECT target_schema || '.' || target_object, 1, 0 FROM dependencies) GROUP BY 1",
    )
)
def object_degrees(spark, sf):
    return lineage.object_degrees(derived(spark, sf, "dependencies"))


@registry.add(
    with_inputs(
        "dependencies",
        "SELECT source_type, count(*) AS edges, count(*) FILTER (target_server <> '' OR target_database <> '') AS cross_database_edges FROM dependencies GROUP BY 1",
    )
)
def edges_by_source_type(spark, sf):
    return lineage.edges_by_source_type(derived(spark, sf, "dependencies"))


@registry.add(with_inputs("dependencies", "SELECT source_schema, source_object, target_object FROM dependencies WHERE source_type = 'VIEW'"))
def view_edges(spark, sf):
    return lineage.edges_of_type(derived(spark, sf, "dependencies"), "VIEW").select(
        "source_schema", "source_object", "target_object"
    )


FLOWS = f"""
, targets AS (SELECT DISTINCT source_schema, source_object, operation, concat_ws('.', nullif(target_database, ''), nullif(target_schema, ''), nullif(target_object, '')) AS target FROM refs),
grouped AS (SELECT source_schema, source_object, string_agg(target, ', ' ORDER BY target) FILTER (operation = 'READ') AS r, string_agg(target, ', ' ORDER BY target) FILTER (operation = 'WRITE') AS w,
  string_agg(target, ', ' ORDER BY target) FILTER (operation = 'CALL') AS c, bool_or(length(target) - length(replace(target, '.', '')) >= 2) AS external_dependency FROM targets GROUP BY 1, 2),
flow_rows AS (SELECT source_schema || '.' || source_object AS origin, coalesce(r, 'UNKNOWN') AS source, 'STATIC_SQL_OBJECT; calls=' || coalesce(c, 'none') AS transformation, coalesce(w, 'UNKNOWN') AS destination,
  'UNKNOWN' AS schedule, 'STATIC DEFINITION TOKEN ANALYSIS' AS read_write_evidence, external_dependency,
  CASE WHEN dynamic_sql_present THEN 'DYNAMIC_SQL_OPAQUE' WHEN r IS NOT NULL AND w IS NOT NULL THEN 'LIKELY_PIPELINE' ELSE 'CONFIRMED_DEPENDENCY' END AS classification,
  CASE WHEN dynamic_sql_present THEN 'LOW' ELSE 'MEDIUM' END AS confidence, 'INFERENCE' AS evidence_class
  FROM grouped g JOIN flags f ON f.schema_name = g.source_schema AND f.object_name = g.source_object
  UNION ALL SELECT source_schema || '.' || source_object, target_schema || '.' || target_object, source_type, 'UNKNOWN', 'UNKNOWN', 'CATALOG REFERENCE; DIRECTION UNKNOWN', target_server <> '' OR target_database <> '',
  'HISTORICAL_OR_UNKNOWN', CASE WHEN referenced_id <> '' THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN referenced_id <> '' THEN 'FACT' ELSE 'INFERENCE' END
  FROM dependencies d WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.source_schema = d.source_schema AND r.source_object = d.source_object)
  UNION ALL SELECT origin, source, transformation, destination, schedule, read_write_evidence, external_dependency, classification, confidence, evidence_class FROM flows)
"""


@registry.add(
    with_extra(("statements", "dependencies", "job_steps"), _STATEMENT_REFS + _JOB_CTES + FLOWS, "SELECT * FROM flow_rows")
)
def flow_catalogue(spark, sf):
    flags = flags_of(spark, sf)
    return lineage.flow_catalogue(
        statements.object_references(flags), flags, derived(spark, sf, "dependencies"),
        jobs.flow_edges(derived(spark, sf, "job_steps")),
    )


_HUB_TARGETS = 40


@registry.add(
    f"""WITH refs AS (SELECT concat('hub_', o_custkey % 3) AS o, CASE WHEN o_orderkey % 4 = 0 THEN 'WRITE' ELSE 'READ' END AS operation, concat('T', o_orderkey // 2) AS target FROM orders
  UNION ALL SELECT concat('small_', o_custkey), 'READ', concat('T', o_orderkey % 5) FROM orders),
targets AS (SELECT DISTINCT o, operation, concat('dbo.', target) AS target FROM refs),
counts AS (SELECT o, operation, count(*) AS n FROM targets GROUP BY 1, 2)
SELECT concat('dbo.', t.o) AS origin, CASE WHEN count(DISTINCT t.operation) = 2 THEN 'LIKELY_PIPELINE' ELSE 'CONFIRMED_DEPENDENCY' END AS classification,
  string_agg(CASE WHEN t.operation = 'READ' THEN target END, ', ' ORDER BY target) AS reads, string_agg(CASE WHEN t.operation = 'WRITE' THEN target END, ', ' ORDER BY target) AS writes,
  bool_or(n > {_HUB_TARGETS}) AS in_several_rows, true AS rows_are_short FROM targets AS t JOIN counts AS c ON c.o = t.o AND c.operation = t.operation GROUP BY t.o"""
)
def flow_catalogue_of_hubs(spark, sf):
    """Objects of which three refer to a third of all orders each: their rows together list all targets."""
    text = lambda value: F.lit(value)
    orders = table(spark, sf, "orders")
    hub = F.struct(F.concat(text("hub_"), F.col("o_custkey") % 3).alias("o"), F.when(F.col("o_orderkey") % 4 == 0, "WRITE").otherwise("READ").alias("operation"),
                   F.concat(text("T"), F.expr("o_orderkey div 2")).alias("target"))
    small = F.struct(F.concat(text("small_"), "o_custkey").alias("o"), text("READ").alias("operation"), F.concat(text("T"), F.col("o_orderkey") % 5).alias("target"))
    refs = orders.select(F.inline(F.array(hub, small))).select(
        text("dbo").alias("source_schema"), F.col("o").alias("source_object"), "operation", text("").alias("target_database"),
        text("dbo").alias("target_schema"), F.col("target").alias("target_object"))
    flags = refs.limit(0).select(F.col("source_schema").alias("schema_name"), F.col("source_object").alias("object_name"), F.lit(False).alias("dynamic_sql_present"))
    found = lineage.flow_catalogue(refs, flags, derived(spark, sf, "dependencies").limit(0), targets_a_row=_HUB_TARGETS)
    lists = [F.array_compact(F.flatten(F.collect_list(F.filter(F.split(c, ", "), lambda x: ~x.isin("UNKNOWN", ""))))) for c in ("source", "destination")]
    short = F.max(F.greatest(F.size(F.split("source", ", ")), F.size(F.split("destination", ", ")))) <= 3 * _HUB_TARGETS
    joined = [F.nullif(F.array_join(F.sort_array(x), ", "), F.lit("")) for x in lists]
    return found.groupBy("origin", "classification").agg(
        joined[0].alias("reads"), joined[1].alias("writes"), (F.count(F.lit(1)) > 1).alias("in_several_rows"), short.alias("rows_are_short"))


@registry.add(
    with_extra(
        ("statements", "dependencies", "synonyms"), FLAGS,
        """SELECT source_schema, source_object, source_type, target_server, target_database, target_schema, target_object,
  CASE WHEN target_server <> '' THEN 'FOUR_PART' ELSE 'THREE_PART' END AS reference_kind, false AS queried_external_system FROM dependencies WHERE target_server <> '' OR target_database <> ''
UNION ALL SELECT schema_name, object_name, 'SYNONYM', '', '', '', CASE WHEN len(parts) >= 4 THEN '[EXTERNAL_SERVER:' || substr(sha256(parts[1]), 1, 12) || '].' || array_to_string(parts[2:], '.') ELSE array_to_string(parts, '.') END, 'SYNONYM_EXTERNAL', false
  FROM (SELECT *, list_transform(string_split(base_object_name, '.'), lambda p: trim(p, '[]')) AS parts FROM synonyms) WHERE len(parts) >= 3
UNION ALL SELECT schema_name, object_name, source_type, '[STATIC_TEXT_REDACTED]', '', '', '', 'OPENQUERY', false FROM flags WHERE regexp_matches(definition_sanitized, '(?i)\\bOPENQUERY\\s*\\(')""",
    )
)
def external_references(spark, sf):
    return lineage.external_references(
        derived(spark, sf, "dependencies"), derived(spark, sf, "synonyms"), flags_of(spark, sf)
    )


@registry.add(
    with_extra(
        ("statements", "dependencies", "synonyms"), _STATEMENT_REFS,
        """, views AS (SELECT * FROM flags WHERE statement_id % 17 <> 0),
away AS (SELECT DISTINCT lower(schema_name) AS s, lower(object_name) AS o FROM (SELECT *, list_filter(list_transform(string_split(base_object_name, '.'), lambda p: trim(trim(p), '[]')), lambda p: p <> '') AS parts FROM synonyms)
  WHERE len(parts) >= 4 OR (len(parts) = 3 AND lower(parts[1]) <> 'shop')),
both_refs AS (SELECT source_schema, source_object, target_server, target_database, target_schema, target_object, is_ambiguous, true AS catalogued, referenced_id FROM dependencies
  UNION ALL SELECT source_schema, source_object, target_server, target_database, target_schema, target_object, 0, false, '' FROM refs),
reasons AS (SELECT schema_name, object_name, 'VIEW_DEFINITION_UNAVAILABLE_OR_ENCRYPTED' AS reason FROM views WHERE NOT definition_available
  UNION SELECT schema_name, object_name, 'VIEW_DEFINITION_DYNAMIC_OR_OPAQUE' FROM views WHERE dynamic_sql_present
  UNION SELECT schema_name, object_name, 'EXTERNAL_QUERY_PRIMITIVE_OPENQUERY' FROM views WHERE regexp_matches(definition_sanitized, '(?i)\\bOPENQUERY\\s*\\(')
  UNION SELECT schema_name, object_name, 'VIEW_METADATA_UNAVAILABLE' FROM statements WHERE statement_id % 17 = 0
  UNION SELECT source_schema, source_object, 'LINKED_SERVER_DEPENDENCY' FROM both_refs WHERE target_server <> ''
  UNION SELECT source_schema, source_object, 'CROSS_DATABASE_DEPENDENCY' FROM both_refs WHERE target_database <> '' AND lower(target_database) <> 'shop'
  UNION SELECT source_schema, source_object, 'AMBIGUOUS_OR_OPAQUE_DEPENDENCY' FROM both_refs WHERE is_ambiguous = 1
  UNION SELECT source_schema, source_object, 'UNRESOLVED_CATALOG_DEPENDENCY' FROM both_refs WHERE catalogued AND referenced_id = '' AND NOT lower(target_database) = 'shop'
  UNION SELECT source_schema, source_object, 'EXTERNAL_SYNONYM_DEPENDENCY' FROM both_refs b WHERE EXISTS (SELECT 1 FROM away WHERE o = lower(target_object) AND (s = lower(target_schema) OR target_schema = ''))),
listed AS (SELECT lower(schema_name) AS s, lower(object_name) AS o, string_agg(reason, ';' ORDER BY reason) AS reasons FROM reasons GROUP BY 1, 2)
SELECT schema_name, object_name, CASE WHEN reasons IS NULL THEN 'ELIGIBLE_LOCAL_ONLY_VIEW' ELSE 'SKIPPED_EXTERNAL_OR_OPAQUE_VIEW_DEPENDENCY' END AS status, coalesce(reasons, '') AS eligibility_reason
FROM statements LEFT JOIN listed ON s = lower(schema_name) AND o = lower(object_name)""",
    )
)
def view_sample_eligibility(spark, sf):
    flags = flags_of(spark, sf)
    return lineage.view_sample_eligibility(
        flags.where("statement_id % 17 <> 0"), flags, derived(spark, sf, "dependencies"),
        statements.object_references(flags), derived(spark, sf, "synonyms"), "Shop",
    )




_RUN_TABLES = ("nation", "region", "customer", "supplier", "orders")


@registry.add(
    with_extra(
        ("statements", "dependencies", "job_steps"), _STATEMENT_REFS,
        "SELECT 'tables_discovered' AS metric, CAST(5 AS BIGINT) AS value UNION ALL SELECT 'tables_profiled', 5 UNION ALL SELECT 'samples_attempted', 5 "
        "UNION ALL SELECT 'sample_status_SAMPLED', 5 UNION ALL SELECT 'column_profile_rows', "
        + " + ".join(f"(SELECT count(*) FROM (DESCRIBE {t}))" for t in _RUN_TABLES)
        + " UNION ALL SELECT 'programmable_objects', count(*) FROM statements "
        "UNION ALL SELECT 'dynamic_sql_objects', count(*) FILTER (dynamic_sql_present) FROM flags "
        "UNION ALL SELECT 'READ', count(*) FROM refs WHERE operation = 'READ' UNION ALL SELECT 'WRITE', count(*) FROM refs WHERE operation = 'WRITE' "
        "UNION ALL SELECT 'CALL', count(*) FROM refs WHERE operation = 'CALL' UNION ALL SELECT 'jobs', count(*) FROM job_steps",
    )
)
def discovery_run(spark, sf):
    """One run over tables and programs together: what its summaries count."""
    found = discovery.discover(
        Workspace(spark, {t: table(spark, sf, t) for t in _RUN_TABLES}, name="Shop", schema_name="dbo"), "salt",
        logic=discovery.Logic(derived(spark, sf, "statements"), derived(spark, sf, "dependencies"), None, derived(spark, sf, "job_steps")))
    wanted = ("tables_discovered", "tables_profiled", "samples_attempted", "sample_status_SAMPLED", "column_profile_rows", "programmable_objects")
    dynamic = found["quality_summary"].where("metric = 'dynamic_sql_objects'")
    operations = found["object_references"].groupBy(F.col("operation").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    jobs_seen = found["database_summary"].where("metric = 'jobs'")
    return found["coverage_summary"].where(F.col("metric").isin(*wanted)).unionAll(dynamic).unionAll(operations).unionAll(jobs_seen)


@registry.add("SELECT concat('p', o_orderkey) AS source_object, CASE WHEN o_orderkey % 2 = 0 THEN 'WRITE' ELSE 'READ' END AS operation FROM orders")
def merge_reads_and_writes(spark, sf):
    """Statements that read, write and call one target: a write counts before a read, a read before a call."""
    empty = derived(spark, sf, "dependencies").limit(0)
    operations = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, ("CALL", "READ", "WRITE")))).otherwise(
        F.array(*map(F.lit, ("CALL", "READ"))))
    text = lambda value, name: F.lit(value).alias(name)
    references = table(spark, sf, "orders").select(
        text("dbo", "source_schema"), F.concat(F.lit("p"), "o_orderkey").alias("source_object"), text("PROCEDURE", "source_type"),
        F.explode(operations).alias("operation"), text("", "target_server"), text("", "target_database"),
        text("dbo", "target_schema"), text("T", "target_object"), text("", "evidence"))
    return lineage.merge_dependencies(empty, references).select("source_object", "operation")
