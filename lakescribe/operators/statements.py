"""Static reading of SQL statements held in a table: flags, references, safety.

A statement table has ``schema_name``, ``object_name``, ``source_type`` and ``definition``. No
statement is ever run. References of one statement are found and made unique inside its row, so
these operators need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fixed
from ..functions.types import of_tables
from ..sources.shared import materialize
from ..functions.text import (
    holds_any, may_hold_secret, redact_text, searched, secrets_replaced,
)

NAME = rf"({fixed.NAME_PART}(?:\s*\.\s*{fixed.NAME_PART}){{0,3}})"
REFERENCE_WORDS = {
    "WRITE": ("INSERT", "MERGE", "UPDATE", "DELETE"), "READ": ("FROM", "JOIN"), "CALL": ("EXEC",),
}
REFERENCE_PATTERNS = (
    ("WRITE", rf"(?i)\b(?:INSERT\s+INTO|MERGE\s+INTO|UPDATE|DELETE\s+FROM)\s+{NAME}"),
    ("READ", rf"(?i)\b(?:FROM|JOIN)\s+{NAME}"),
    ("CALL", rf"(?i)\b(?:EXEC|EXECUTE)\s+{NAME}"),
)
REFERENCE_COLUMNS = (
    "source_schema", "source_object", "source_type", "operation", "target_server",
    "target_database", "target_schema", "target_object", "evidence",
)


# flag, words one of which must occur, pattern; all against the upper-cased text
FLAG_PATTERNS = (
    ("dynamic_sql_present", ("EXEC",), fixed.DYNAMIC_DEFINITION),
    ("transaction_logic_present", ("TRAN", "COMMIT", "ROLLBACK"), r"\bBEGIN\s+TRAN|\bCOMMIT\b|\bROLLBACK\b"),
    (
        "error_handling_present", ("TRY", "CATCH", "THROW", "RAISERROR"),
        r"\bTRY\b|\bCATCH\b|\bTHROW\b|\bRAISERROR\b",
    ),
    (
        "likely_write_logic", ("INSERT", "UPDATE", "DELETE", "MERGE"),
        r"\bINSERT\b|\bUPDATE\b|\bDELETE\b|\bMERGE\b",
    ),
)


def definition_flags(
    statements: DataFrame, text_column: str = "definition", literals: Iterable[str] = ()
) -> DataFrame:
    """Replaces the raw text by its sanitized form, its hash and what it does."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    folded = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    suspicious, redacted = may_hold_secret(text), secrets_replaced(text)
    unquoted = F.regexp_replace(redacted, fixed.QUOTED_SECRET_ASSIGNMENT, "$1='[REDACTED]'")
    sanitized = (
        F.when(suspicious & text.contains("'"), unquoted).when(suspicious, redacted).otherwise(text)
    )
    if tuple(literals):
        sanitized = redact_text(sanitized, literals)
    upper = F.col("__upper")
    flags = {
        "definition_available": text != "",
        "definition_sha256": F.when(text != "", F.sha2(folded, 256)).otherwise(""),
        "definition_sanitized": sanitized,
        "temp_table_present": text.contains("#"),
    }
    for name, words, pattern in FLAG_PATTERNS:
        flags[name] = searched(upper, words, pattern)
    return (
        statements.withColumn("__upper", F.upper(text))
        .withColumns(flags)
        .drop(text_column, "__upper")
    )


def one_per_key(items: Column, last: bool) -> Column:
    """The first or last of the structs that share their first field, ``key``.

    The second field must be the position. Sorting first makes this n log n in the row.
    """

    def keep(ordered: Column) -> Column:
        def is_edge(item: Column, i: Column) -> Column:
            neighbour = F.get(ordered, i + 1 if last else i - 1)
            at_end = i == (F.size(ordered) - 1 if last else F.lit(0))
            return at_end | (neighbour["key"] != item["key"])

        return F.filter(ordered, is_edge)

    return F.get(F.transform(F.array(F.sort_array(items)), keep), F.lit(0))


def extract_all(text: Column, upper: Column, words: Iterable[str], pattern: str, group: int = 1) -> Column:
    """All matches of a group of a pattern that cannot match without one of the words in ``upper``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(holds_any(upper, words), found).otherwise(F.array().cast("array<string>"))


def _parts(raw: Column) -> Column:
    compact = F.regexp_replace(raw, r"\s+", "")
    return F.transform(F.split(compact, r"\."), lambda part: F.btrim(part, F.lit("[]")))


def _target(operation: Column, parts: Column, position: Column) -> Column:
    size = F.size(parts)

    def at(back: int) -> Column:
        return F.element_at(parts, -back)

    fits = (size >= 1) & (size <= 4)
    names = {
        "target_server": F.when(size == 4, at(4)).otherwise(""),
        "target_database": F.when(size.isin(3, 4), at(3)).otherwise(""),
        "target_schema": F.when(size.isin(2, 3, 4), at(2)).otherwise(""),
        "target_object": F.when(fits, at(1)).otherwise(F.element_at(parts, 1)),
    }
    key = F.lower(F.concat_ws("\x00", operation, *names.values()))
    return F.struct(
        key.alias("key"), position.alias("position"), operation.alias("operation"),
        *[value.alias(name) for name, value in names.items()],
        at(1).rlike("^[#@]").alias("is_local"),
    )


def object_references(statements: DataFrame, text_column: str = "definition_sanitized") -> DataFrame:
    """Objects each statement reads, writes or calls, once each; the last spelling is kept."""

    def found(operation: str, pattern: str) -> Column:
        names = extract_all(F.col("__text"), F.col("__upper"), REFERENCE_WORDS[operation], pattern)
        return F.transform(
            names,
            lambda name, i: F.struct(
                F.lit(operation).alias("operation"), i.alias("place"), _parts(name).alias("parts")
            ),
        )

    every = F.concat(*[found(*entry) for entry in REFERENCE_PATTERNS])
    targets = F.filter(
        F.transform(every, lambda item: _target(item["operation"], item["parts"], item["place"])),
        lambda item: ~item["is_local"],
    )
    kind = F.col("source_type") if "source_type" in statements.columns else F.lit("STATEMENT")
    filled = F.coalesce(F.col(text_column), F.lit(""))
    staged = statements.withColumns({"__text": filled, "__upper": F.upper(filled)})
    return staged.select(
        F.col("schema_name").alias("source_schema"), F.col("object_name").alias("source_object"),
        kind.alias("source_type"), F.explode(one_per_key(targets, last=True)).alias("item"),
    ).select(
        "source_schema", "source_object", "source_type", "item.operation", "item.target_server",
        "item.target_database", "item.target_schema", "item.target_object",
        F.concat(F.lit("STATIC_DEFINITION_"), F.col("item.operation")).alias("evidence"),
    )


ALIAS_PATTERN = (
    rf"(?i)\b(?:FROM|JOIN)\s+({fixed.NAME_PART}(?:\s*\.\s*{fixed.NAME_PART})?)"
    rf"\s*(?:AS\s+)?({fixed.NAME_PART})?"
)
#: Characters looked at on both sides of a name; matches that can stand in them (one is 3 characters at least).
CONTEXT, NEIGHBOURS = 100, 34
#: Up to so many names after FROM and JOIN a row sorts out uses of others itself; the join does so in any case.
KNOWN_NAMES = 64


def _bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once, also where the body uses it for every item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mentions(text: Column) -> Column:
    """(name, alias) after every FROM and JOIN, by one search; groups are read from the short matches."""
    return F.transform(
        extract_all(text, F.upper(text), REFERENCE_WORDS["READ"], ALIAS_PATTERN, 0),
        lambda m: F.struct(*[F.regexp_extract(m, ALIAS_PATTERN, i).alias(n) for i, n in ((1, "name"), (2, "alias"))]))


def _aliases(mentioned: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, alias) -> table: names and aliases after FROM and JOIN that are known tables."""
    tables = columns.select(
        F.lower("schema_name").alias("schema_key"), F.lower("object_name").alias("object_key"),
        "schema_name", "object_name",
    )
    by_pair = tables.groupBy("schema_key", "object_key").agg(
        F.max(F.struct("schema_name", "object_name")).alias("table")
    )
    by_name = by_pair.groupBy("object_key").agg(
        F.count(F.lit(1)).alias("same_name"), F.max("table").alias("only_table")
    ).where("same_name = 1")
    mentions = (
        mentioned.select("statement_id", F.posexplode("mentions").alias("place", "mention"))
        .withColumn("parts", F.transform(_parts(F.col("mention.name")), F.lower))
        .select(
            "statement_id", "place",
            F.when(F.size("parts") == 2, F.get("parts", F.lit(0))).alias("schema_key"),
            F.element_at("parts", -1).alias("object_key"),
            F.lower(F.btrim(F.col("mention.alias"), F.lit("[]"))).alias("alias"),
        )
    )
    resolved = (
        mentions.join(by_pair, ["schema_key", "object_key"], "left")
        .join(by_name, "object_key", "left")
        .withColumn("table", F.when(F.col("schema_key").isNull(), F.col("only_table")).otherwise(F.col("table")))
        .where(F.col("table").isNotNull())
    )
    reserved = F.col("alias").isin("", *fixed.ALIAS_STOP_WORDS)
    spelled = F.array(
        F.struct(F.lit(0).alias("turn"), F.lower(F.col("table.object_name")).alias("alias")),
        F.when(~reserved, F.struct(F.lit(1).alias("turn"), F.col("alias"))),
    )
    latest = Window.partitionBy("statement_id", "qualifier").orderBy(F.desc("place"), F.desc("turn"))
    return (
        resolved.select("statement_id", "place", "table", F.explode(F.array_compact(spelled)).alias("item"))
        .select("statement_id", "place", "table", "item.turn", F.col("item.alias").alias("qualifier"))
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1")
        .select("statement_id", "qualifier", "table.*")
    )


QUALIFIED = rf"({fixed.NAME_PART})\s*\.\s*({fixed.NAME_PART})"


def _use(before: Column, around: Column, word: Column) -> Column:
    """What the surroundings of a name do with it."""
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    arithmetic = F.concat(F.lit("(?i)"), quoted, F.lit(r"\s*[+*/-]|[+*/-]\s*"), quoted)
    return (
        F.when(before.rlike(r"(?i)\b(?:SUM|AVG|MIN|MAX|COUNT)\s*\([^)]*$"), "AGGREGATED")
        .when(around.rlike(r"(?i)\bCASE\b"), "CONDITIONAL")
        .when(F.regexp_like(around, arithmetic), "DERIVED").otherwise("DIRECT")
    )


def _qualified_names(mentioned: DataFrame, text_column: str) -> DataFrame:
    """Every ``qualifier.column`` of each statement with what its surroundings do with it.

    Matches and the gaps between them alternate. What stands around a match is put together from the
    nearest of them by index, so the work is linear in the statement. A gap counts with both ends only.
    """
    text = F.col(text_column)
    words = F.regexp_extract_all(text, F.lit(QUALIFIED), F.lit(0))
    gaps = F.transform(F.split(text, QUALIFIED, -1), lambda g: F.when(
        F.length(g) > 2 * CONTEXT, F.concat(F.left(g, F.lit(CONTEXT)), F.right(g, F.lit(CONTEXT)))).otherwise(g))
    known = F.array_distinct(F.flatten(F.transform("mentions", lambda m: F.array(
        F.lower(F.element_at(_parts(m["name"]), -1)), F.lower(F.btrim(m["alias"], F.lit("[]")))))))

    def name(word: Column, group: int) -> Column:
        return F.btrim(F.regexp_extract(word, QUALIFIED, group), F.lit("[]"))

    def uses(x: Column) -> Column:
        each = F.transform(x["words"], lambda w, i: F.struct(
            i.alias("place"), w.alias("word"), F.lower(name(w, 1)).alias("qualifier"), name(w, 2).alias("column")))
        wanted = F.filter(each, lambda u: (F.size(x["known"]) > KNOWN_NAMES) | F.array_contains(x["known"], u["qualifier"]))
        with_gap_before = F.zip_with(x["gaps"], x["words"], lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
        with_gap_behind = F.transform(x["words"], lambda w, i: F.concat(w, F.get(x["gaps"], i + 1)))
        return _bound(F.struct(with_gap_before.alias("before"), with_gap_behind.alias("behind")), lambda near: F.transform(
            wanted, lambda u: _surrounded(u, x["gaps"], near)))

    parts = F.struct(words.alias("words"), gaps.alias("gaps"), known.alias("known"))
    each = mentioned.where(text.contains(".")).select(
        "statement_id", *SOURCE_FIELDS, F.explode(_bound(parts, uses)).alias("use"))
    around = F.concat("use.before", "use.word", "use.behind")
    return each.select(
        "statement_id", *SOURCE_FIELDS, "use.place", "use.qualifier", "use.column",
        _use(F.col("use.before"), around, F.col("use.word")).alias("lineage_type"),
    )


def _surrounded(use: Column, gaps: Column, near: Column) -> Column:
    """A match with the characters in front of it and behind it."""
    place = use["place"]
    first = F.greatest(place - NEIGHBOURS, F.lit(0))
    before = F.concat(F.array_join(F.slice(near["before"], first + 1, place - first), ""), F.get(gaps, place))
    behind = F.concat(F.get(gaps, place + 1), F.array_join(F.slice(near["behind"], place + 2, F.lit(NEIGHBOURS)), ""))
    return F.struct(
        *[use[c].alias(c) for c in ("place", "word", "qualifier", "column")],
        F.right(before, F.lit(CONTEXT)).alias("before"), F.left(behind, F.lit(CONTEXT)).alias("behind"))


SOURCE_FIELDS = ("source_schema", "source_object", "source_type")


def column_references(
    statements: DataFrame, columns: DataFrame, text_column: str = "definition_sanitized",
    statement_id: str | None = None,
) -> DataFrame:
    """Qualified columns of known tables each statement uses, and how; views are no such tables.

    ``statement_id`` names a unique column of the statements; without it a statement is known by
    its schema, object and text.
    """
    if statement_id:
        identity = F.col(statement_id)
    else:
        identity = F.sha2(F.concat_ws("\x00", "schema_name", "object_name", text_column), 256)
    kind = F.col("source_type") if "source_type" in statements.columns else F.lit("STATEMENT")
    numbered = statements.where(F.col(text_column) != "").select(
        identity.alias("statement_id"), F.col("schema_name").alias("source_schema"),
        F.col("object_name").alias("source_object"), kind.alias("source_type"), text_column,
    ).withColumn("mentions", _mentions(F.col(text_column)))
    numbered = materialize(numbered, "statements")  # names and aliases read it; redaction and search run once
    columns = of_tables(columns)
    known = columns.select(
        "schema_name", "object_name", F.lower("column_name").alias("column_key")
    ).distinct()
    names = _qualified_names(numbered, text_column).withColumn("column_key", F.lower("column"))
    unique = (
        names.join(_aliases(numbered, columns), ["statement_id", "qualifier"])
        .join(known, ["schema_name", "object_name", "column_key"], "left_semi")
        .groupBy("statement_id", *SOURCE_FIELDS, "schema_name", "object_name", "column_key", "lineage_type")
        .agg(F.max(F.struct("place", "column")).getField("column").alias("target_column"))
    )
    return unique.select(
        *SOURCE_FIELDS, F.col("schema_name").alias("target_schema"), F.col("object_name").alias("target_object"),
        "target_column", "lineage_type",
        F.lit("STATIC_ALIAS_QUALIFIED_COLUMN_REFERENCE").alias("evidence"),
    )


# One leftmost-first alternation consumes comments, literals and quoted names as they open.
# Possessive loops keep long literals off the matcher's stack.
QUOTED_SPANS = (
    r"--[^\r\n]*+"
    r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
    r"|'[^']*+(?:''[^']*+)*+'"
    r'|"[^"]*+(?:""[^"]*+)*+"'
    r"|\[[^\]]*+(?:\]\][^\]]*+)*+\]"
)
UNTERMINATED = (
    ("'", "Unterminated SQL string"),
    ('"', "Unterminated SQL quoted identifier"),
    ("[", "Unterminated SQL bracket identifier"),
    ("/", "Unterminated SQL block comment"),
)


def statement_safety(statements: DataFrame, text_column: str = "definition") -> DataFrame:
    """Whether each statement is one plain SELECT, and the first reason why it is not."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    blank = r"\A\s*\z"
    staged = (
        statements.withColumn("__scrubbed", F.regexp_replace(text, QUOTED_SPANS, " "))
        .withColumn("__open", F.regexp_extract("__scrubbed", r"(['\"\[]|/\*)", 1))
        .withColumn("__body", F.regexp_replace("__scrubbed", r"\A\s+|\s+\z", ""))
        .withColumn("__body", F.regexp_replace("__body", r"\s*;\z", ""))
        .withColumn(
            "__forbidden",
            F.array_sort(
                F.array_intersect(
                    F.transform(
                        F.regexp_extract_all("__body", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1)),
                        F.upper,
                    ),
                    F.array(*[F.lit(token) for token in fixed.FORBIDDEN_TOKENS]),
                )
            ),
        )
    )
    body = F.col("__body")
    first = F.upper(F.regexp_extract(body, r"\A([A-Za-z]+)", 1))
    reason = F.when(text.rlike(blank), "SQL must be a non-empty string")
    for sign, message in UNTERMINATED:
        reason = reason.when(F.col("__open").startswith(sign), message)
    reason = (
        reason.when(F.col("__scrubbed").rlike(blank), "SQL contains no executable statement")
        .when(body.contains(";"), "Multiple SQL statements are not allowed")
        .when(~first.isin("SELECT", "WITH"), "Only SELECT or WITH ... SELECT statements are allowed")
        .when(
            (first == "WITH") & ~body.rlike(r"(?i)\bSELECT\b"),
            "A CTE must resolve to a SELECT statement",
        )
        .when(
            F.size("__forbidden") > 0,
            F.concat(F.lit("Forbidden SQL token(s): "), F.array_join("__forbidden", ", ")),
        )
    )
    for pattern in fixed.FORBIDDEN_PHRASES:
        reason = reason.when(
            body.rlike("(?i)" + pattern), F.lit("Forbidden SQL construct: " + pattern)
        )
    return (
        staged.withColumn("reason", reason)
        .withColumn("is_read_only", F.col("reason").isNull())
        .select(*statements.columns, "is_read_only", "reason")
    )
