"""Classification, value signals, masking, publication and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakescribe.functions import fixed_values as fixed
from lakescribe.functions.text import is_safely_masked as safely_masked, mask_value
from lakescribe.operators import masking, profile, sampling, sensitivity
from lakescribe.sources.workspace import column_descriptions as join_descriptions

from .inputs import Registry, derived, table, with_inputs
from .profile_checks import KINDS, distribution_sql, profile_sql

registry = Registry()
SALT = "salt"
FIELDS = sensitivity.CLASS_FIELDS
SENSITIVE = "(" + ", ".join(f"'{c}'" for c in fixed.SENSITIVE_CATEGORIES) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def coded(category: str, action: str, confidence: str, evidence: str) -> str:
    return lit("|".join((category, action, confidence, evidence)))


def search_sql(text: str, confidence: str, evidence: str) -> str:
    return " ".join(
        f"WHEN regexp_matches({text}, {lit('(?i)' + pattern)}) THEN "
        + coded(category, "REDACT" if category == "Credential" else "PSEUDONYMIZE", confidence, evidence)
        for category, pattern in fixed.CATEGORY_PATTERNS
    )


def name_sql(name: str, description: str | None = None) -> str:
    """WHEN branches that give 'category|action|confidence|evidence'."""
    legacy = ", ".join(lit(n) for n in fixed.LEGACY_PII_NAMES)
    branches = (
        f"WHEN regexp_replace(lower({name}), '[^a-z0-9]', '', 'g') IN ({legacy}) THEN "
        + coded("PII", "PSEUDONYMIZE", "HIGH", fixed.EVIDENCE_LEGACY) + " "
        + search_sql(name, "HIGH", fixed.EVIDENCE_NAME)
    )
    if description:
        branches += " " + search_sql(description, "MEDIUM", fixed.EVIDENCE_DESCRIPTION)
    return branches


UNKNOWN = coded(*sensitivity.UNKNOWN)


def split_class(code: str) -> str:
    return ", ".join(f"split_part({code}, '|', {i}) AS {f}" for i, f in enumerate(FIELDS, 1))


def rank_sql(value: str) -> str:
    text = f"trim({value}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    branches = " ".join(
        f"WHEN regexp_matches({text}, {lit(pattern)}) THEN {rank}" for rank, _, pattern, _ in fixed.VALUE_PATTERNS
    )
    return (
        f"CASE WHEN {value} IS NULL OR {text} = '' OR starts_with({text}, '[MASKED:') OR {text} = '[REDACTED]' "
        f"THEN NULL {branches} END"
    )


def signal_case(rank: str) -> str:
    return f"CASE {rank} " + " ".join(
        f"WHEN {r} THEN {lit(fixed.EVIDENCE_VALUE + text)}" for r, _, _, text in fixed.VALUE_PATTERNS
    ) + " END"


@registry.add(
    with_inputs(
        "cat_columns",
        f"SELECT schema_name, object_name, column_name, {split_class('code')} FROM ("
        f"SELECT *, CASE {name_sql('column_name', 'description')} ELSE {UNKNOWN} END AS code FROM cat_columns)",
    )
)
def classify_columns_by_name(spark, sf):
    columns = derived(spark, sf, "cat_columns").select("schema_name", "object_name", "column_name", "description")
    return sensitivity.classify_columns(columns).drop("description")


@registry.add(
    f"SELECT word AS column_name, {split_class('code')} FROM (SELECT word, CASE {name_sql('word')} END AS code "
    "FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\\s,;]+')) AS word FROM documents) "
    "WHERE word <> '') WHERE code IS NOT NULL"
)
def classify_vocabulary(spark, sf):
    """Every distinct word of the documents read as a column name."""
    words = sensitivity.text_tokens(table(spark, sf, "documents"), "text").distinct()
    named = words.select(F.col("token").alias("column_name"))
    return sensitivity.classify_columns(named).where("sensitivity_category <> 'Unknown'")


RULES = [
    sensitivity.OverrideRule(schema="d*", table="student_*", column="*no", category="Non-sensitive",
                             action="PRESERVE", reason="wide glob"),
    sensitivity.OverrideRule(column="user?id", category="Health", reason="one character"),
    sensitivity.OverrideRule(column="MobNo", match="exact", schema="dbo", category="Financial",
                             confidence="MEDIUM", reason="exact name"),
    sensitivity.OverrideRule(table="plain_[0-4]*", category="Non-sensitive", action="PRESERVE", reason="set of digits"),
]


@registry.add(
    with_inputs(
        "cat_columns",
        f"SELECT object_name, column_name, {split_class('code')} FROM (SELECT *, CASE "
        f"WHEN lower(column_name) = 'mobno' AND schema_name = 'dbo' THEN {coded('Financial', 'PSEUDONYMIZE', 'MEDIUM', 'OVERRIDE: exact name')} "
        f"WHEN lower(object_name) GLOB 'student_*' AND lower(column_name) GLOB '*no' THEN {coded('Non-sensitive', 'PRESERVE', 'HIGH', 'OVERRIDE: wide glob')} "
        f"WHEN lower(column_name) GLOB 'user?id' THEN {coded('Health', 'PSEUDONYMIZE', 'HIGH', 'OVERRIDE: one character')} "
        f"WHEN lower(object_name) GLOB 'plain_[0-4]*' THEN {coded('Non-sensitive', 'PRESERVE', 'HIGH', 'OVERRIDE: set of digits')} "
        f"{name_sql('column_name', 'description')} ELSE {UNKNOWN} END AS code FROM cat_columns)",
    )
)
def apply_overrides(spark, sf):
    classified = sensitivity.classify_columns(derived(spark, sf, "cat_columns"), rules=RULES)
    return classified.select("object_name", "column_name", *FIELDS)


def _many_rules() -> list[sensitivity.OverrideRule]:
    """A rule a table and column, exact or by globs, behind those of RULES; most match nothing."""
    more = [
        sensitivity.OverrideRule(table=f"nothing_{i}" if i % 3 else "*", column=f"*none{i}?" if i % 2 else f"none_{i}*", category="Health")
        for i in range(10_000)
    ]
    tail = [
        sensitivity.OverrideRule(column="wid*", category="Financial", reason="start"), sensitivity.OverrideRule(column="*oa*", category="Health", reason="inside"),
        sensitivity.OverrideRule(column="payload", match="exact", category="Non-sensitive", action="PRESERVE", reason="last exact"),
    ]
    return [*RULES, *more, *tail]


@registry.add(
    with_inputs(
        "cat_columns",
        f"SELECT object_name, column_name, {split_class('code')} FROM (SELECT *, CASE "
        f"WHEN lower(column_name) = 'mobno' AND schema_name = 'dbo' THEN {coded('Financial', 'PSEUDONYMIZE', 'MEDIUM', 'OVERRIDE: exact name')} "
        f"WHEN lower(column_name) = 'payload' THEN {coded('Non-sensitive', 'PRESERVE', 'HIGH', 'OVERRIDE: last exact')} "
        f"WHEN lower(object_name) GLOB 'student_*' AND lower(column_name) GLOB '*no' THEN {coded('Non-sensitive', 'PRESERVE', 'HIGH', 'OVERRIDE: wide glob')} "
        f"WHEN lower(column_name) GLOB 'user?id' THEN {coded('Health', 'PSEUDONYMIZE', 'HIGH', 'OVERRIDE: one character')} "
        f"WHEN lower(object_name) GLOB 'plain_[0-4]*' THEN {coded('Non-sensitive', 'PRESERVE', 'HIGH', 'OVERRIDE: set of digits')} "
        f"WHEN lower(column_name) GLOB 'wid*' THEN {coded('Financial', 'PSEUDONYMIZE', 'HIGH', 'OVERRIDE: start')} "
        f"WHEN lower(column_name) GLOB '*oa*' THEN {coded('Health', 'PSEUDONYMIZE', 'HIGH', 'OVERRIDE: inside')} "
        f"{name_sql('column_name', 'description')} ELSE {UNKNOWN} END AS code FROM cat_columns)",
    )
)
def apply_many_overrides(spark, sf):
    """Ten thousand rules: rows that columns meet by an index, not branches of the plan."""
    classified = sensitivity.classify_columns(derived(spark, sf, "cat_columns"), rules=_many_rules())
    return classified.select("object_name", "column_name", *FIELDS)


def signals_sql(name: str, kinds: dict[str, str]) -> str:
    parts = []
    for column, kind in kinds.items():
        rank = rank_sql(f'CAST("{column}" AS VARCHAR)')
        counts = ", ".join(
            f"count(*) FILTER (r = {n}) AS {label}_values" for n, label, _, _ in fixed.VALUE_PATTERNS
        )
        parts.append(
            f"SELECT '{name}' AS table_name, '{column}' AS column_name, {counts}, CAST(min(r) AS INTEGER) AS signal_rank, "
            f"{signal_case('min(r)')} AS evidence FROM (SELECT {rank} AS r FROM {name})"
        )
    return "\nUNION ALL\n".join(parts)


for _name in ("documents", "customer", "conversations", "lineitem"):
    registry.add(signals_sql(_name, KINDS[_name]), f"value_signals_{_name}")(
        lambda spark, sf, name=_name: sensitivity.value_signals(table(spark, sf, name), name)
    )


@registry.add(
    "WITH tokens AS MATERIALIZED (SELECT unnest(regexp_split_to_array(text, '[\\s,;]+')) AS token FROM documents), "
    "filled AS (SELECT token FROM tokens WHERE token <> '') " + signals_sql("filled", {"token": "string"})
)
def value_signals_words(spark, sf):
    """Signals among the words inside the documents."""
    tokens = sensitivity.text_tokens(table(spark, sf, "documents"), "text")
    return sensitivity.value_signals(tokens, "filled")


PROFILE_CLASS = (
    "CASE WHEN length(object_name) % 3 = 0 THEN 'PII|PSEUDONYMIZE|HIGH|VALUE_SIGNAL: email value pattern' "
    "ELSE 'Unknown|PRESERVE|LOW|NO_SENSITIVITY_SIGNAL' END"
)
SAMPLE_CLASS = (
    "CASE WHEN column_id % 2 = 0 THEN 'Health|PSEUDONYMIZE|HIGH|BUILTIN_COLUMN_NAME' "
    "ELSE 'Non-sensitive|PRESERVE|HIGH|OVERRIDE: looked at' END"
)


def _classed(columns: DataFrame, code: str, test: str) -> DataFrame:
    parts = F.split(F.expr(code), r"\|")
    chosen = columns.where(test)
    return chosen.select(
        "schema_name", "object_name", "column_name",
        *[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(FIELDS)],
    )


@registry.add(
    with_inputs(
        "cat_columns",
        f"""SELECT object_name, column_name, {split_class('final')},
  CASE WHEN split_part(final, '|', 1) IN ('Unknown', 'Non-sensitive') THEN 'UNKNOWN' ELSE 'INFERENCE' END AS evidence_class
FROM (SELECT *, CASE WHEN split_part(by_profile, '|', 1) IN {SENSITIVE} AND split_part(base, '|', 1) NOT IN {SENSITIVE}
    THEN by_profile ELSE base END AS final
  FROM (SELECT *, coalesce(by_sample, by_name) AS base FROM (SELECT *,
    CASE {name_sql('column_name')} ELSE {UNKNOWN} END AS by_name,
    CASE WHEN column_id <> 3 THEN {PROFILE_CLASS} END AS by_profile,
    CASE WHEN column_id <= 4 THEN {SAMPLE_CLASS} END AS by_sample FROM cat_columns)))""",
    )
)
def final_sensitivity(spark, sf):
    columns = derived(spark, sf, "cat_columns").select("schema_name", "object_name", "column_name", "column_id")
    by_name = sensitivity.classify_columns(columns.drop("column_id"))
    return sensitivity.final_sensitivity(
        columns, by_name, _classed(columns, PROFILE_CLASS, "column_id <> 3"),
        _classed(columns, SAMPLE_CLASS, "column_id <= 4"),
    ).select("object_name", "column_name", *FIELDS, "evidence_class")


# --- masking ------------------------------------------------------------------------------------


def mask_sql(value: str, category: str) -> str:
    """The published text of a text value; ``category`` is SQL too."""
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN {category} = 'Credential' THEN '[REDACTED]' "
        f"WHEN {category} IN {SENSITIVE} THEN '[MASKED:' || substr(sha256('{SALT}|' || {value}), 1, 16) || ']' "
        f"ELSE {value} END"
    )


@registry.add(
    with_inputs(
        "profile_rows",
        f"SELECT column_name, {mask_sql('maximum_value', 'sensitivity_category')} AS masked, "
        f"CASE WHEN sensitivity_category = 'Credential' THEN '[REDACTED]' ELSE maximum_value END AS unmasked FROM profile_rows",
    )
)
def mask(spark, sf):
    rows = derived(spark, sf, "profile_rows")
    category = F.col("sensitivity_category")
    return rows.select(
        "column_name", mask_value(F.col("maximum_value"), category, SALT).alias("masked"),
        mask_value(F.col("maximum_value"), category, SALT, enabled=False).alias("unmasked"),
    )


CUSTOMER_CLASSES = {"c_name": "PII", "c_acctbal": "Financial", "c_mktsegment": "Credential"}
MASKED_CUSTOMER = (
    f"SELECT c_custkey, {mask_sql('c_name', lit('PII'))} AS c_name, c_nationkey, "
    f"{mask_sql('CAST(c_acctbal AS VARCHAR)', lit('Financial'))} AS c_acctbal, '[REDACTED]' AS c_mktsegment FROM customer"
)


@registry.add(MASKED_CUSTOMER)
def mask_table(spark, sf):
    return masking.mask_table(table(spark, sf, "customer"), CUSTOMER_CLASSES, SALT)


PUBLISHED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@registry.add(
    "SELECT "
    + ", ".join(f"{mask_sql(f'CAST({c} AS VARCHAR)', lit('Potentially Sensitive'))} AS {c}" for c in PUBLISHED)
    + ", '[REDACTED]' AS c_mktsegment FROM customer"
)
def publish_sample(spark, sf):
    return masking.publish_sample(table(spark, sf, "customer"), {"C_MKTSEGMENT": "Credential"}, SALT)


RECONCILED = ("customer", "nation", "orders")


def _classes_of(spark, sf) -> DataFrame:
    rows = [(n, c) for n in RECONCILED for c in table(spark, sf, n).columns]
    named = spark.createDataFrame(rows, "table_name string, column_name string")
    return sensitivity.classify_columns(named)


_RECONCILED_CLASS = (
    f"CASE {name_sql('column_name')} ELSE {UNKNOWN} END"
)


@registry.add(
    "SELECT table_name, column_name, total_rows, split_part(code, '|', 1) AS sensitivity_category, "
    f"{mask_sql('minimum_value', chr(40) + 'split_part(code, ' + lit('|') + ', 1)' + chr(41))} AS minimum_value, "
    f"{mask_sql('maximum_value', chr(40) + 'split_part(code, ' + lit('|') + ', 1)' + chr(41))} AS maximum_value "
    f"FROM (SELECT *, {_RECONCILED_CLASS} AS code FROM ("
    + "\nUNION ALL\n".join(profile_sql(n, KINDS[n]) for n in RECONCILED) + "))"
)
def reconcile_profile_sensitivity(spark, sf):
    parts = [profile.column_profile(table(spark, sf, n), n) for n in RECONCILED]
    profiles = reduce(DataFrame.unionByName, parts)
    done = masking.reconcile_sensitivity(
        profiles, _classes_of(spark, sf), ("minimum_value", "maximum_value"), SALT
    )
    return done.select(
        "table_name", "column_name", "total_rows", "sensitivity_category", "minimum_value", "maximum_value"
    )


@registry.add(
    "SELECT table_name, column_name, value_count, "
    f"{mask_sql('value', chr(40) + 'split_part(code, ' + lit('|') + ', 1)' + chr(41))} AS value "
    f"FROM (SELECT *, {_RECONCILED_CLASS} AS code FROM ("
    + "\nUNION ALL\n".join(distribution_sql(n, KINDS[n], 50) for n in RECONCILED) + "))"
)
def reconcile_distribution_sensitivity(spark, sf):
    parts = [profile.low_cardinality_values(table(spark, sf, n), n) for n in RECONCILED]
    values = reduce(DataFrame.unionByName, parts)
    done = masking.reconcile_sensitivity(values, _classes_of(spark, sf), ("value",), SALT)
    return done.select("table_name", "column_name", "value_count", "value")


def detected_sql(value: str) -> str:
    """The sensitive category the column's name or one value shows, else NULL."""
    return (
        f"split_part(CASE {name_sql('column_name')} WHEN {rank_sql(value)} IS NOT NULL THEN 'PII' END, '|', 1)"
    )


_TOKEN = "'[MASKED:' || substr(sha256('{salt}|' || {v}), 1, 16) || ']'"


def published_sql() -> str:
    def token(v: str) -> str:
        return _TOKEN.format(salt=SALT, v=v)

    def step(previous: str, value: str) -> str:
        return (
            f"CASE WHEN coalesce({value}, '') <> '' AND NOT reviewed AND {previous} NOT IN {SENSITIVE} "
            f"AND coalesce({detected_sql(value)}, '') IN {SENSITIVE} THEN {detected_sql(value)} ELSE {previous} END"
        )

    def new(category: str, value: str) -> str:
        return (
            f"CASE WHEN coalesce({value}, '') = '' THEN {value} WHEN {category} = 'Credential' THEN '[REDACTED]' "
            f"WHEN {category} IN {SENSITIVE} THEN {token(value)} WHEN data_type = 'varbinary' THEN '[BINARY_REDACTED]' "
            f"WHEN reviewed OR data_type IN ('int', 'datetime2') THEN {value} ELSE {token(value)} END"
        )

    def counted(category: str, value: str) -> str:
        return (
            f"CASE WHEN coalesce({value}, '') = '' THEN 0 WHEN {category} IN {SENSITIVE} OR data_type = 'varbinary' THEN 1 "
            f"WHEN reviewed OR data_type IN ('int', 'datetime2') THEN 0 ELSE 1 END"
        )

    return f"""
, joined AS (SELECT p.*, coalesce(c.sensitivity_category, p.sensitivity_category, 'Unknown') AS category,
    coalesce(c.sensitivity_category = 'Non-sensitive' AND c.evidence LIKE 'OVERRIDE:%', false) AS reviewed
  FROM profile_rows p LEFT JOIN class_rows c ON lower(c.table_name) = lower(p.table_name) AND lower(c.column_name) = lower(p.column_name)),
one AS (SELECT *, {step('category', 'minimum_value')} AS first_category FROM joined),
two AS (SELECT *, {step('first_category', 'maximum_value')} AS second_category FROM one),
published AS (SELECT table_name, column_name, {new('first_category', 'minimum_value')} AS minimum_value,
    {new('second_category', 'maximum_value')} AS maximum_value,
    {counted('first_category', 'minimum_value')} + {counted('second_category', 'maximum_value')} AS values_masked
  FROM two)
"""


def _with_published(body: str) -> str:
    base = with_inputs("class_rows", "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + published_sql() + body


def _published(spark, sf, policy="mask_unknown_text") -> DataFrame:
    return masking.publication_policy(
        derived(spark, sf, "profile_rows"), derived(spark, sf, "class_rows"),
        ("minimum_value", "maximum_value"), SALT, policy,
    )


@registry.add(_with_published("SELECT * FROM published"))
def publication_policy(spark, sf):
    return _published(spark, sf).select(
        "table_name", "column_name", "minimum_value", "maximum_value", "values_masked"
    )


@registry.add(
    _with_published(
        "SELECT CAST(sum(values_masked) AS BIGINT) AS profile_values_masked, CAST(0 AS BIGINT) AS profile_values_omitted FROM published"
    )
)
def publication_counters(spark, sf):
    return masking.publication_counters(_published(spark, sf))


@registry.add(
    with_inputs(
        "profile_rows",
        "SELECT column_name, CASE WHEN minimum_value = '' THEN '' END AS minimum_value, "
        "CASE WHEN maximum_value = '' THEN '' END AS maximum_value, "
        "CAST((coalesce(minimum_value, '') <> '')::INT + (coalesce(maximum_value, '') <> '')::INT AS INTEGER) AS values_omitted FROM profile_rows",
    )
)
def publication_aggregate_only(spark, sf):
    return _published(spark, sf, "aggregate_only").select(
        "column_name", "minimum_value", "maximum_value", "values_omitted"
    )


# --- redaction and audits -----------------------------------------------------------------------

LITERALS = ("Internal Host", "ecret")


def redact_sql(text: str, literals=()) -> str:
    sql = f"regexp_replace({text}, {lit(fixed.CONNECTION_PASSWORD)}, '\\1[REDACTED]', 'g')"
    sql = f"regexp_replace({sql}, {lit(fixed.SECRET_ASSIGNMENT)}, '\\1=[REDACTED]', 'g')"
    for item in sorted(literals, key=len, reverse=True):
        sql = f"replace({sql}, {lit(item)}, '[REDACTED]')"
    return sql


@registry.add(
    f"SELECT doc_id, md5(redacted) AS digest, redacted <> text AS was_redacted FROM (SELECT doc_id, text, {redact_sql('text', LITERALS)} AS redacted FROM documents)"
)
def redact_text(spark, sf):
    done = masking.redact_documents(table(spark, sf, "documents"), "text", LITERALS)
    return done.select("doc_id", F.md5("redacted_text").alias("digest"), "was_redacted")


@registry.add(
    "SELECT doc_id, literal_found, assignment_found FROM (SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), {lit(i.lower())})" for i in LITERALS)
    + f" AS literal_found, {redact_sql('text', LITERALS)} <> text AS assignment_found FROM documents) "
    "WHERE literal_found OR assignment_found"
)
def secret_scan(spark, sf):
    found = masking.secret_scan(table(spark, sf, "documents"), "text", LITERALS)
    return found.select("doc_id", "literal_found", "assignment_found")


def safe_sql(value: str, category: str) -> str:
    return (
        f"CASE WHEN coalesce(trim({value}), '') = '' THEN true WHEN {category} = 'Credential' THEN trim({value}) = '[REDACTED]' "
        f"ELSE trim({value}) = '[REDACTED]' OR regexp_matches(trim({value}), {lit(fixed.MASKED_TOKEN)}) END"
    )


MIXED_TOKEN = (
    "CASE WHEN length(column_name) % 4 = 0 THEN '[REDACTED]' WHEN length(column_name) % 4 = 1 THEN '[MASKED:0123456789abcdef]' "
    "WHEN length(column_name) % 4 = 2 THEN concat('[MASKED:', maximum_value, ']') ELSE maximum_value END"
)


@registry.add(
    with_inputs(
        "profile_rows",
        f"SELECT column_name, {safe_sql('token', 'sensitivity_category')} AS is_safe FROM (SELECT *, {MIXED_TOKEN} AS token FROM profile_rows)",
    )
)
def is_safely_masked(spark, sf):
    rows = derived(spark, sf, "profile_rows")
    return rows.select(
        "column_name", safely_masked(F.expr(MIXED_TOKEN), F.col("sensitivity_category")).alias("is_safe")
    )


_AUDIT = f"""
, joined AS (SELECT p.*, {MIXED_TOKEN.replace('column_name', 'p.column_name')} AS token, coalesce(c.sensitivity_category, 'Unknown') AS catalogued, coalesce(c.evidence, '') AS class_evidence
  FROM profile_rows p LEFT JOIN class_rows c ON lower(c.table_name) = lower(p.table_name) AND lower(c.column_name) = lower(p.column_name)),
detected AS (SELECT *, coalesce({detected_sql('minimum_value')}, {detected_sql('token')}, '') AS found,
  CASE WHEN sensitivity_category = '' THEN catalogued ELSE sensitivity_category END AS kept,
  catalogued = 'Non-sensitive' AND class_evidence LIKE 'OVERRIDE:%' AS reviewed FROM joined),
effective AS (SELECT *, CASE WHEN catalogued IN {SENSITIVE} OR reviewed THEN catalogued WHEN kept IN {SENSITIVE} THEN kept
  WHEN found IN {SENSITIVE} THEN found ELSE kept END AS category FROM detected),
long AS (SELECT table_name, column_name AS row_id, category, data_type, reviewed, 'minimum_value' AS field, minimum_value AS value FROM effective
  UNION ALL SELECT table_name, column_name, category, data_type, reviewed, 'maximum_value', token FROM effective),
audited AS (SELECT *, category IN {SENSITIVE} AS checked, {safe_sql('value', 'category')} AS safe,
  value IN ('[REDACTED]', '[BINARY_REDACTED]') OR regexp_matches(value, '{fixed.MASKED_TOKEN}') AS token FROM long WHERE coalesce(value, '') <> ''),
violations AS (SELECT table_name, row_id, field, category, CASE WHEN checked AND NOT safe THEN concat('unmasked ', category, ' value')
  WHEN checked OR token THEN NULL WHEN data_type = 'varbinary' THEN 'unredacted binary profile value'
  WHEN reviewed OR data_type IN ('int', 'datetime2') THEN NULL ELSE 'unmasked unknown text profile value' END AS violation, checked FROM audited)
"""


def _with_audit(body: str) -> str:
    base = with_inputs("class_rows", "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + _AUDIT + body


def _audited(spark, sf) -> DataFrame:
    rows = derived(spark, sf, "profile_rows").withColumn("maximum_value", F.expr(MIXED_TOKEN))
    return masking.audit_profile_values(
        rows, derived(spark, sf, "class_rows"), ("minimum_value", "maximum_value"), "profile",
        policy="mask_unknown_text",
    )


@registry.add(
    _with_audit("SELECT table_name, row_id, field, category, violation FROM violations WHERE violation IS NOT NULL")
)
def masking_audit(spark, sf):
    return masking.audit_violations(_audited(spark, sf))


@registry.add(
    _with_audit(
        f"""SELECT 'profile_values_masked' AS check_name, count(*) FILTER (checked) AS values_checked, count(violation) AS violations, count(violation) = 0 AS passed FROM violations
UNION ALL SELECT 'sample_values_masked', CAST(3 * count(*) AS BIGINT), CAST(0 AS BIGINT), true FROM customer
UNION ALL SELECT 'configured_secrets_absent', count(*), count(*) FILTER (literal_found), count(*) FILTER (literal_found) = 0 FROM scanned
UNION ALL SELECT 'secret_assignments_redacted', count(*), count(*) FILTER (assignment_found), count(*) FILTER (assignment_found) = 0 FROM scanned"""
    ).replace(
        ", joined AS",
        ", scanned AS (SELECT * FROM (SELECT "
        + " OR ".join(f"contains(lower(text), {lit(i.lower())})" for i in LITERALS)
        + f" AS literal_found, {redact_sql('text', LITERALS)} <> text AS assignment_found FROM documents) WHERE literal_found OR assignment_found), joined AS",
        1,
    )
)
def masking_audit_summary(spark, sf):
    masked = masking.mask_table(table(spark, sf, "customer"), CUSTOMER_CLASSES, SALT)
    samples = masking.audit_table_values(masked, "customer", CUSTOMER_CLASSES, "c_custkey")
    secrets = masking.secret_scan(table(spark, sf, "documents"), "text", LITERALS)
    return masking.audit_summary(_audited(spark, sf).unionByName(samples), secrets)


@registry.add(
    f"SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'c_name' AS field, 'PII' AS category, 'unmasked PII sample' AS violation FROM customer "
    "UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_acctbal', 'Financial', 'unmasked Financial sample' FROM customer WHERE c_acctbal IS NOT NULL"
)
def audit_table_values(spark, sf):
    """An unmasked table: a column known as sensitive and one found by its name."""
    audited = masking.audit_table_values(
        table(spark, sf, "customer"), "customer", {"c_acctbal": "Financial"}, "c_custkey"
    )
    return masking.audit_violations(audited).drop("table_name")


# --- samples ---------------------------------------------------------------------------------------


@registry.add("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def bounded_sample(spark, sf):
    """A top-k report: the limit is the operator."""
    return sampling.bounded_sample(table(spark, sf, "orders"), 100, ["o_orderkey"])


@registry.add(
    f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {mask_sql('c_name', lit('PII'))} AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 100"
)
def sample_and_mask(spark, sf):
    return sampling.sample_and_mask(table(spark, sf, "customer"), "customer", 100, SALT, ["c_custkey"])


def _report_code(column: str, kind: str) -> str:
    rank = f"(SELECT min({rank_sql(f'CAST({column} AS VARCHAR)')}) FROM s)"
    signals = " ".join(
        f"WHEN {rank} = {r} THEN {coded('PII', 'PSEUDONYMIZE', 'HIGH', fixed.EVIDENCE_VALUE + t)}"
        for r, _, _, t in fixed.VALUE_PATTERNS
    )
    return f"CASE {name_sql(lit(column))} {signals} ELSE {UNKNOWN} END"


def _report_sql(name: str, key: str) -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, {_report_code(c, k)} AS code" for c, k in KINDS[name].items()
    )
    return (
        f"WITH s AS MATERIALIZED (SELECT * FROM {name} ORDER BY {key} LIMIT 500) SELECT table_name, column_name, split_part(code, '|', 1) AS category, "
        f"split_part(code, '|', 2) AS action, split_part(code, '|', 3) AS confidence, split_part(code, '|', 4) AS evidence FROM ({rows})"
    )


@registry.add(_report_sql("events", "event_id"))
def masking_report(spark, sf):
    return sampling.masking_report(table(spark, sf, "events"), "events", 500, ["event_id"])


@registry.add(
    "SELECT 'customer' AS table_name, 500 AS requested_rows, CAST(least(500, count(*)) AS BIGINT) AS returned_rows, 'PRIMARY_KEY' AS ordering_strategy, "
    "'SAMPLED' AS status, 1 AS masked_sensitive_column_count FROM customer"
)
def sample_index(spark, sf):
    return sampling.sample_index(table(spark, sf, "customer"), "customer", 500, ["c_custkey"])


def _any(text: str, markers) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {lit(m)})" for m in markers) + ")"


@registry.add(
    with_inputs(
        "error_texts",
        f"SELECT o_orderkey, CASE WHEN {_any('sanitized_message', fixed.TIMEOUT_MARKERS)} THEN 'FAILED_TIMEOUT' "
        f"WHEN {_any('sanitized_message', fixed.SAMPLE_ACCESS_MARKERS)} THEN 'INACCESSIBLE' ELSE 'FAILED_QUERY' END AS status, "
        f"{_any('sanitized_message', fixed.ACCESS_MARKERS)} AS may_continue FROM error_texts",
    )
)
def sample_failure_status(spark, sf):
    message = F.col("sanitized_message")
    return derived(spark, sf, "error_texts").select(
        "o_orderkey", sampling.sample_failure_status(message).alias("status"),
        sampling.is_access_limitation(message).alias("may_continue"),
    )


_ORDERING = """
, keyed AS (SELECT schema_name, object_name, string_agg(column_name, ',' ORDER BY key_ordinal) AS order_columns, 'PRIMARY_KEY' AS ordering_strategy
  FROM cat_primary_keys GROUP BY 1, 2),
usable AS (SELECT * FROM cat_indexes WHERE is_unique AND NOT is_disabled AND NOT has_filter AND NOT is_included_column AND key_ordinal > 0),
firsts AS (SELECT schema_name, object_name, min(index_id) AS index_id FROM usable GROUP BY 1, 2),
indexed AS (SELECT u.schema_name, u.object_name, string_agg(column_name, ',' ORDER BY key_ordinal) AS order_columns, 'UNIQUE_INDEX' AS ordering_strategy
  FROM usable u JOIN firsts f ON f.object_name = u.object_name AND f.index_id = u.index_id GROUP BY 1, 2),
ordering AS (SELECT * FROM keyed UNION ALL SELECT * FROM indexed WHERE object_name NOT IN (SELECT object_name FROM keyed))
"""


def _with_ordering(body: str) -> str:
    base = with_inputs(("cat_primary_keys", "cat_indexes", "cat_tables"), "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + _ORDERING + body


def _ordering(spark, sf) -> DataFrame:
    return sampling.ordering_columns(derived(spark, sf, "cat_primary_keys"), derived(spark, sf, "cat_indexes"))


@registry.add(_with_ordering("SELECT * FROM ordering"))
def ordering_columns(spark, sf):
    return _ordering(spark, sf)


@registry.add(
    _with_ordering(
        "SELECT t.object_name, 100 AS requested_rows, coalesce(o.ordering_strategy, 'UNORDERED_TOP') AS ordering_strategy, o.order_columns, 'READY' AS status "
        "FROM cat_tables t LEFT JOIN ordering o USING (object_name)"
    )
)
def sample_plan(spark, sf):
    tables = derived(spark, sf, "cat_tables")
    plan = sampling.sample_plan(tables.drop("row_count"), tables, _ordering(spark, sf))
    return plan.select("object_name", "requested_rows", "ordering_strategy", "order_columns", "status")


@registry.add(
    with_inputs(
        "notes",
        "SELECT object_name, column_name, string_agg(property_value, ' ' ORDER BY property_value) AS description "
        "FROM (SELECT DISTINCT object_name, column_name, property_value FROM notes WHERE property_value IS NOT NULL) GROUP BY 1, 2",
    )
)
def column_descriptions(spark, sf):
    return join_descriptions(derived(spark, sf, "notes"))


@registry.add("SELECT count(*) AS n, CAST(0 AS BIGINT) AS raw_values, count(*) * 2 AS masked FROM orders")
def publication_of_case_variants(spark, sf):
    """Classes of names that differ in case only: one row out per row in, the most sensitive class counts."""
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), "o_orderkey").alias("table_name"), F.lit("Id").alias("column_name"), F.lit("int").alias("data_type"),
        F.col("o_custkey").cast("string").alias("minimum_value"), F.col("o_custkey").cast("string").alias("maximum_value"))
    variants = F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.lit(c).alias("sensitivity_category"), F.lit(e).alias("evidence"))
        for n, c, e in (("Id", "Unknown", ""), ("ID", "PII", "NAME"), ("iD", "Non-sensitive", "OVERRIDE: checked"))]))
    classes = rows.select("table_name", variants.alias("v")).select("table_name", "v.*")
    fields = ("minimum_value", "maximum_value")
    done = masking.publication_policy(rows, classes, fields, "salt")
    raw = [F.when(F.col(f).startswith("[MASKED:"), 0).otherwise(1) for f in fields]
    return done.agg(F.count(F.lit(1)).alias("n"), F.sum(raw[0] + raw[1]).alias("raw_values"), F.sum("values_masked").alias("masked"))


@registry.add(
    "SELECT 'documents' AS table_name, CAST(25 AS BIGINT) AS sampled, CAST(25 AS BIGINT) AS returned_rows, CAST(5 AS BIGINT) AS reported, TRUE AS agree"
)
def sample_drawn_once(spark, sf):
    """A sample without a key: rows, report and index describe the same draw."""
    drawn = sampling.draw_sample(table(spark, sf, "documents"), "documents", 25, "salt")
    report = drawn["report"].agg(
        F.count(F.lit(1)).alias("reported"), F.count_if(F.col("category").isin(*fixed.SENSITIVE_CATEGORIES)).alias("sensitive"))
    found = drawn["index"].join(report).join(drawn["sample"].agg(F.count(F.lit(1)).alias("sampled")))
    return found.select(
        "table_name", "sampled", "returned_rows", "reported", (F.col("sensitive") == F.col("masked_sensitive_column_count")).alias("agree"))
