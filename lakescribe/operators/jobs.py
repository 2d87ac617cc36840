"""Static reading of scheduled job steps: what they touch, what stays opaque.

A step table has ``job_name``, ``step_id``, ``step_name``, ``subsystem``, ``command``,
``database_name`` and ``schedule_name``. Raw commands never leave these operators.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.text import redact_text, searched
from .statements import extract_all, one_per_key

NAME = rf"({fixed.JOB_NAME_PART}(?:\s*\.\s*{fixed.JOB_NAME_PART}){{0,3}})"
REFERENCE_PATTERNS = (
    ("WRITE", rf"(?i)\bINSERT\s+(?:INTO\s+)?{NAME}"),
    ("WRITE", rf"(?i)\bMERGE\s+(?:INTO\s+)?{NAME}"),
    ("WRITE", rf"(?i)\bUPDATE\s+{NAME}"),
    ("WRITE", rf"(?i)\bDELETE\s+FROM\s+{NAME}"),
    ("READ", rf"(?i)\b(?:FROM|JOIN)\s+{NAME}"),
    ("CALL", rf"(?i)\bEXEC(?:UTE)?\s+{NAME}"),
)
# words without which the pattern at the same place cannot match
REFERENCE_WORDS = (("INSERT",), ("MERGE",), ("UPDATE",), ("DELETE",), ("FROM", "JOIN"), ("EXEC",))
# Comments and literals; one that never closes runs to the end of the command.
SPANS = (
    r"--[^\r\n]*+"
    r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
    r"|'[^']*+(?:''[^']*+)*+(?:'|\z)"
)
SUBSYSTEM_HINTS = (
    ("POWERSHELL", "PowerShell invocation; command and arguments redacted", "POWERSHELL_OPAQUE"),
    ("CMDEXEC", "CmdExec invocation; command and arguments redacted", "CMDEXEC_OPAQUE"),
    ("SSIS", "SSIS package invocation; location and arguments redacted", "SSIS_OPAQUE"),
)
CALLS_TO_SKIP = ("sp_executesql", "sys.sp_executesql")
STEP_FIELDS = ("job_name", "step_id", "step_name", "subsystem")
REFERENCE_COLUMNS = STEP_FIELDS + (
    "source_database", "operation", "target_server", "target_database", "target_schema",
    "target_object", "reference_kind", "external_reference", "dynamic_sql_opaque", "evidence",
    "evidence_class", "confidence",
)
FLOW_COLUMNS = STEP_FIELDS + (
    "origin", "source", "transformation", "destination", "schedule", "operation",
    "read_write_evidence", "external_dependency", "classification", "confidence",
    "evidence_class", "reference_kind", "dynamic_sql_opaque",
)


def _staged(steps: DataFrame, literals: tuple[str, ...]) -> DataFrame:
    """Steps with redacted labels, the scrubbed command and what is derived from it."""
    labels = ("job_name", "description", "step_name", "subsystem", "database_name", "schedule_name")
    shown = {
        name: redact_text(F.coalesce(F.col(name).cast("string"), F.lit("")), literals)
        for name in labels if name in steps.columns
    }
    command = F.coalesce(F.col("command"), F.lit(""))
    hint = F.concat(
        F.coalesce(F.nullif(F.col("subsystem"), F.lit("")), F.lit("External")),
        F.lit(" invocation; command and arguments redacted"),
    )
    kind = F.lit("EXTERNAL_OPAQUE")
    for subsystem, text, label in SUBSYSTEM_HINTS:
        hint = F.when(F.col("subsystem") == subsystem, text).otherwise(hint)
        kind = F.when(F.col("subsystem") == subsystem, label).otherwise(kind)
    tsql, dynamic = F.col("subsystem") == "TSQL", F.col("dynamic_sql_opaque")
    return (
        steps.withColumns({**shown, "command": command})
        .withColumn("subsystem", F.upper(F.trim("subsystem")))
        .withColumn("scrubbed", F.when(tsql, F.regexp_replace("command", SPANS, " ")).otherwise(""))
        .withColumn("upper", F.upper("scrubbed"))
        .withColumn("dynamic_sql_opaque", searched(F.col("upper"), ("EXEC",), fixed.DYNAMIC_JOB_STEP))
        .withColumns(
            {
                "invocation_hint": F.when(tsql & dynamic, "dynamic TSQL; text treated as opaque")
                .when(tsql, "static TSQL parsed without execution").otherwise(hint),
                "command_classification": F.when(tsql & dynamic, "DYNAMIC_TSQL_OPAQUE")
                .when(tsql, "STATIC_TSQL").otherwise(kind),
            }
        )
    )


def job_catalogue(steps: DataFrame, literals: Iterable[str] = ()) -> DataFrame:
    """Each step with a command hash, and its text only where it can be shown as it is."""
    literals = tuple(item for item in literals if item)
    staged = _staged(steps, literals)
    command = F.col("command")
    sanitized = F.regexp_replace(redact_text(command, literals), fixed.SECRET_ARGUMENT, "$1=[REDACTED]")
    harmless = (
        (F.col("subsystem") == "TSQL") & (command != "") & (command == sanitized)
        & ~F.col("dynamic_sql_opaque")
        & ~command.rlike(r"['\"]|--|/\*|\*/") & ~command.rlike(fixed.SECRET_WORD)
        & ~command.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    )
    own_hash = F.upper(F.sha2(command, 256))
    if "command_sha256" in steps.columns:
        supplied = F.nullif(F.trim(F.col("command_sha256")), F.lit(""))
        own_hash = F.coalesce(F.upper(supplied), own_hash)
    added = ("command_sha256", "command_text_sanitized", "invocation_hint",
             "command_classification", "dynamic_sql_opaque")
    kept = [c for c in steps.columns if c not in ("command", *added)]
    return staged.withColumns(
        {
            "command_sha256": own_hash,
            "command_text_sanitized": F.when(harmless, command).otherwise(""),
        }
    ).select(*kept, *added)


def _name_parts(name: Column, literals: tuple[str, ...]) -> Column:
    def unquoted(part: Column) -> Column:
        inside = F.substring(part, F.lit(2), F.length(part) - 2)
        text = F.when(part.startswith("["), F.replace(inside, F.lit("]]"), F.lit("]"))).otherwise(part)
        return redact_text(text, literals)

    return F.transform(F.regexp_extract_all(name, F.lit(f"({fixed.JOB_NAME_PART})"), F.lit(1)), unquoted)


def _reference(**values: Column | str | bool) -> Column:
    order = ("key", "position", "operation", "target_server", "target_database", "target_schema",
             "target_object", "reference_kind", "external_reference", "evidence", "confidence")
    return F.struct(
        *[(v if isinstance(v := values[name], Column) else F.lit(v)).alias(name) for name in order]
    )


def _named(operation: Column, parts: Column, position: Column) -> Column:
    size = F.size(parts)
    database = F.col("database_name")
    digest = F.upper(F.substring(F.sha2(F.element_at(parts, 1), 256), 1, 12))
    names = {
        "target_server": F.when(size == 4, F.concat(F.lit("[EXTERNAL_SERVER:"), digest, F.lit("]"))).otherwise(""),
        "target_database": F.when(size >= 3, F.element_at(parts, -3)).otherwise(database),
        "target_schema": F.when(size >= 2, F.element_at(parts, -2)).otherwise(""),
        "target_object": F.element_at(parts, -1),
    }
    other = (database == "") | (F.lower(F.element_at(parts, -3)) != F.lower(database))
    return _reference(
        key=F.lower(F.concat_ws("\x00", operation, *names.values())),
        position=position, operation=operation, **names,
        reference_kind=F.when(size == 4, "FOUR_PART").when(size == 3, "THREE_PART")
        .when(size == 2, "TWO_PART").otherwise("UNQUALIFIED"),
        external_reference=(size == 4) | ((size == 3) & other),
        evidence="STATIC TSQL TOKEN REFERENCE; NEVER EXECUTED",
        confidence=F.when(size == 1, "LOW").otherwise("MEDIUM"),
    )


def job_step_references(steps: DataFrame, literals: Iterable[str] = ()) -> DataFrame:
    """What each step reads, writes or calls, once each, plus a row for all it hides."""
    return _references(steps, tuple(item for item in literals if item)).select(*REFERENCE_COLUMNS)


def _references(steps: DataFrame, literals: tuple[str, ...]) -> DataFrame:
    staged = _staged(steps, literals)
    text, upper = F.col("scrubbed"), F.col("upper")

    def found(turn: int, operation: str, pattern: str) -> Column:
        names = extract_all(text, upper, REFERENCE_WORDS[turn], pattern)
        if operation == "READ":
            calls = tuple(name.lower() for name in fixed.EXTERNAL_CALLS)
            names = F.filter(names, lambda n: ~F.lower(n).isin(*calls))
        if operation == "CALL":
            names = F.filter(names, lambda n: ~F.lower(n).isin(*CALLS_TO_SKIP))
        place = F.lit(turn).cast("bigint") * 1_000_000_000
        return F.transform(
            names,
            lambda name, i: F.struct(
                F.lit(operation).alias("operation"), name.alias("name"), (i + place).alias("place")
            ),
        )

    none = {f"target_{p}": "" for p in ("server", "database", "schema", "object")}
    constructs = F.transform(
        extract_all(text, upper, ("OPEN",), r"(?i)\b(OPENQUERY|OPENROWSET|OPENDATASOURCE)\s*\("),
        lambda word, i: _reference(
            key=F.lit(""), position=i.cast("bigint"), operation="READ",
            **{**none, "target_server": "[STATIC_TEXT_REDACTED]"},
            reference_kind=F.upper(word), external_reference=True,
            evidence=F.concat(
                F.upper(word),
                F.lit(" STATIC INVOCATION DETECTED; ARGUMENTS OPAQUE; NEVER EXECUTED"),
            ),
            confidence="LOW",
        ),
    )
    dynamic = _reference(
        key="", position=F.lit(0).cast("bigint"), operation="OPAQUE", **none, reference_kind="DYNAMIC_SQL",
        external_reference=False,
        evidence="DYNAMIC SQL DETECTED; TEXT NOT INTERPRETED OR EXECUTED", confidence="LOW",
    )
    opaque = _reference(
        key="", position=F.lit(0).cast("bigint"), operation="OPAQUE", **none,
        reference_kind=F.when(F.col("subsystem") == "SSIS", "SSIS_PACKAGE").otherwise("EXTERNAL_INVOCATION"),
        external_reference=True,
        evidence=F.concat(
            F.col("command_classification"),
            F.lit("; COMMAND AND ARGUMENTS REDACTED; NEVER EXECUTED"),
        ),
        confidence="LOW",
    )
    is_tsql = F.col("subsystem") == "TSQL"
    extra = F.array_compact(
        F.array(
            F.when(F.col("dynamic_sql_opaque"), dynamic), F.when(~is_tsql, opaque),
        )
    )
    every = F.concat(*[found(turn, *entry) for turn, entry in enumerate(REFERENCE_PATTERNS)])
    parted = F.transform(
        every,
        lambda item: F.struct(
            item["operation"].alias("operation"), item["place"].alias("place"),
            _name_parts(item["name"], literals).alias("parts"),
        ),
    )
    named = F.transform(parted, lambda item: _named(item["operation"], item["parts"], item["place"]))
    items = F.concat(one_per_key(named, last=False), constructs, extra)
    return staged.select(
        *STEP_FIELDS, F.col("database_name").alias("source_database"), "schedule_name",
        "invocation_hint", "dynamic_sql_opaque", F.explode(items).alias("item"),
    ).select(
        "*", "item.*", F.lit("INFERENCE").alias("evidence_class")
    ).drop("item")


def flow_edges(steps: DataFrame, literals: Iterable[str] = ()) -> DataFrame:
    """One edge per reference: reads fill the source, writes the destination, the rest says how."""
    refs = _references(steps, tuple(item for item in literals if item))
    names = [F.nullif(F.col(f"target_{p}"), F.lit("")) for p in ("server", "database", "schema", "object")]
    target = F.coalesce(F.nullif(F.concat_ws(".", *names), F.lit("")), F.lit("UNKNOWN"))
    operation = F.col("operation")

    def or_unknown(name: str, default: str = "UNKNOWN") -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    return refs.withColumns(
        {
            "origin": F.concat(F.lit("SQL Agent job: "), F.col("job_name")),
            "source": F.when(operation == "READ", target).otherwise("UNKNOWN"),
            "destination": F.when(operation == "WRITE", target).otherwise("UNKNOWN"),
            "transformation": F.when(operation == "CALL", F.concat(F.lit("CALL "), target))
            .when(operation == "OPAQUE", or_unknown("invocation_hint", "OPAQUE STEP"))
            .otherwise(or_unknown("step_name")),
            "schedule": or_unknown("schedule_name"),
            "read_write_evidence": F.col("evidence"),
            "external_dependency": F.col("external_reference"),
            "classification": F.when(operation == "OPAQUE", "OPAQUE_EXTERNAL_STEP").otherwise(
                "POSSIBLE_PIPELINE"
            ),
        }
    ).select(*FLOW_COLUMNS)
