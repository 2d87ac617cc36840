"""Masking, publication of profiles and samples, and the audit of what was written."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.text import (
    is_present, is_safely_masked, mask_token, mask_value, redact_text, strip,
)
from ..functions.types import base_type_name, col_of, text_form
from .sensitivity import detected_category

KEYS = ("table_name", "column_name")


def mask_table(
    df: DataFrame, categories: Mapping[str, str], salt: str, enabled: bool = True
) -> DataFrame:
    """The table with every classified column masked; other columns keep their types."""
    kept = ("Unknown", "Non-sensitive")
    columns = []
    for field in df.schema.fields:
        category = categories.get(field.name, "Unknown")
        column = col_of(field.name)
        if category not in kept or field.dataType.simpleString() == "binary":
            column = mask_value(column, category, salt, field.dataType, enabled)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def categories_of(classification: DataFrame, table_name: str) -> dict[str, str]:
    """column -> category of one table (its size is the width of that table)."""
    rows = classification.where(F.col("table_name") == table_name).select(
        "column_name", "sensitivity_category"
    )
    return {r["column_name"]: r["sensitivity_category"] for r in rows.collect()}


def reconcile_sensitivity(
    rows: DataFrame, final: DataFrame, value_fields: Sequence[str], salt: str,
    keys: Sequence[str] = KEYS, enabled: bool = True,
) -> DataFrame:
    """Attach each column's final class to profile or distribution rows and mask their values.

    Works on raw values, so a value is masked once, under its final class.
    """
    classes = final.select(
        *keys, "sensitivity_category", "masking_action",
        F.col("confidence").alias("sensitivity_confidence"),
        F.col("evidence").alias("sensitivity_evidence"),
    )
    category = F.coalesce("sensitivity_category", F.lit("Unknown"))
    joined = rows.join(classes, list(keys), "left")
    return joined.withColumns(
        {f: mask_value(F.col(f), category, salt, enabled=enabled) for f in value_fields}
    )


def _matches_case_folded(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the classes of their column, one row out per row in.

    Names that differ in case only are one column here: the most sensitive of their classes counts.
    """
    folded = [F.lower(F.col(k)).alias(f"__{k}") for k in keys]
    ranks = F.array(*[F.lit(c) for c in fixed.CATEGORIES_BY_RISK])
    risk = F.coalesce(F.nullif(F.array_position(ranks, F.col("__category")), F.lit(0)), F.lit(0))
    right = other.select("*", *folded).groupBy(*[f"__{k}" for k in keys]).agg(
        F.max_by(F.struct("__category", "__evidence"), F.struct(risk, "__category", F.coalesce("__evidence", F.lit("")))).alias("__class")
    ).select(*[f"__{k}" for k in keys], "__class.*")
    test = reduce(Column.__and__, [F.lower(rows[k]) == right[f"__{k}"] for k in keys])
    return rows.join(right, test, "left").drop(*[f"__{k}" for k in keys])


def _sensitive(category: Column) -> Column:
    return F.coalesce(category.isin(*fixed.SENSITIVE_CATEGORIES), F.lit(False))


def _reviewed(category: Column, evidence: Column) -> Column:
    return F.coalesce(
        (category == "Non-sensitive") & F.upper(evidence).startswith("OVERRIDE:"), F.lit(False)
    )


def publication_policy(
    rows: DataFrame,
    classification: DataFrame,
    value_fields: Sequence[str],
    salt: str,
    policy: str = "mask_unknown_text",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Profile or distribution rows as they may be published.

    ``aggregate_only`` blanks every value field. ``mask_unknown_text`` masks sensitive values and
    all text of unknown columns, replaces binary, and keeps numbers, times and the values of
    columns reviewed as Non-sensitive by an override. ``values_masked`` and ``values_omitted``
    count what happened to the row. ``rows`` has ``data_type``; its own ``sensitivity_category``
    and ``sensitivity_evidence`` serve where the classification lists no such column.
    """
    if policy not in ("mask_unknown_text", "aggregate_only"):
        raise ValueError(f"unknown publication policy {policy!r}")
    classes = classification.select(
        *keys, F.col("sensitivity_category").alias("__category"), F.col("evidence").alias("__evidence")
    )
    joined = _matches_case_folded(rows, classes, keys)
    own = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    category = F.coalesce("__category", own("sensitivity_category"), F.lit("Unknown"))
    evidence = F.coalesce(F.nullif(F.col("__evidence"), F.lit("")), own("sensitivity_evidence"))
    reviewed = _reviewed(category, evidence)
    type_name = base_type_name(F.col("data_type"))
    binary = F.coalesce(type_name.isin(*fixed.BINARY_TYPES), F.lit(False))
    plain = F.coalesce(type_name.isin(*fixed.NUMERIC_TYPES, *fixed.DATE_TYPES), F.lit(False))

    # Each step is a column of its own, so the pattern searches behind it run once.
    staged = joined.withColumns(
        {"__reviewed": reviewed, "__binary": binary, "__plain": plain, "__current": category}
    )
    kept_as_is = F.col("__reviewed") | F.col("__plain")
    current = F.col("__current")
    masked, omitted = F.lit(0), F.lit(0)
    for field in value_fields:
        value = F.col(field)
        present = is_present(value)
        if policy == "aggregate_only":
            omitted = omitted + present.cast("int")
            continue
        open_question = present & ~F.col("__reviewed") & ~_sensitive(current)
        found = F.when(open_question, detected_category(F.col("column_name"), value))
        staged = staged.withColumn("__current", F.coalesce(found, current))
        token = mask_token(value, salt)
        new = (
            F.when(current == "Credential", F.lit(fixed.REDACTED))
            .when(_sensitive(current), token)
            .when(F.col("__binary"), F.lit(fixed.BINARY_REDACTED))
            .when(kept_as_is, value)
            .otherwise(token)
        )
        kept = ~_sensitive(current) & ~F.col("__binary") & kept_as_is
        staged = staged.withColumns(
            {
                f"__new_{field}": F.when(present, new).otherwise(value),
                f"__masked_{field}": (present & ~kept).cast("int"),
            }
        )
        masked = masked + F.col(f"__masked_{field}")
    counted = staged.withColumns(
        {"values_masked": masked.cast("int"), "values_omitted": omitted.cast("int")}
    )
    for field in value_fields:
        if policy == "aggregate_only":
            blank = F.when(is_present(F.col(field)), F.lit(None)).otherwise(F.col(field))
            counted = counted.withColumn(field, blank)
        else:
            counted = counted.withColumn(field, F.col(f"__new_{field}"))
    return counted.select(*[c for c in counted.columns if not c.startswith("__")])


def publication_counters(published: DataFrame) -> DataFrame:
    return published.agg(
        F.coalesce(F.sum("values_masked"), F.lit(0)).alias("profile_values_masked"),
        F.coalesce(F.sum("values_omitted"), F.lit(0)).alias("profile_values_omitted"),
    )


def publish_sample(sample: DataFrame, categories: Mapping[str, str], salt: str) -> DataFrame:
    """A sample with every filled cell masked; a column without a category counts as sensitive."""
    lowered = {name.lower(): category for name, category in categories.items()}
    columns = []
    for field in sample.schema.fields:
        column = col_of(field.name)
        category = lowered.get(field.name.lower(), "Potentially Sensitive")
        masked = mask_value(column, category, salt, field.dataType)
        filled = is_present(text_form(column, field.dataType))
        columns.append(F.when(filled, masked).otherwise(F.lit("")).alias(field.name))
    return sample.select(*columns)


def redact_documents(df: DataFrame, text_column: str, literals: Iterable[str] = ()) -> DataFrame:
    """The table with secrets in one text column replaced, and whether anything was."""
    redacted = redact_text(F.col(text_column), tuple(literals))
    return df.withColumn("redacted_text", redacted).withColumn(
        "was_redacted", F.col("redacted_text") != F.col(text_column)
    )


def secret_scan(df: DataFrame, text_column: str, literals: Iterable[str] = ()) -> DataFrame:
    """The rows whose text still holds a secret assignment or one of the given literals."""
    needles = tuple(item for item in literals if item)
    text = F.col(text_column)
    holds = F.lit(False)
    for needle in needles:
        holds = holds | F.lower(text).contains(needle.lower())
    changed = redact_text(text, needles) != text
    return (
        df.withColumn("literal_found", holds)
        .withColumn("assignment_found", changed)
        .where("literal_found OR assignment_found")
    )


def effective_category(
    catalogued: Column, evidence: Column, stored: Column, column_name: Column, values: Sequence[Column]
) -> Column:
    """The class an audit holds a value to: the catalogue's, unless it is not sensitive and was
    not reviewed; then the stored one; then whatever the name and the values show."""
    catalogued = F.coalesce(catalogued, F.lit("Unknown"))
    kept = F.coalesce(F.nullif(stored, F.lit("")), catalogued)
    return F.coalesce(
        F.when(_sensitive(catalogued) | _reviewed(catalogued, evidence), catalogued),
        F.when(_sensitive(kept), kept),
        detected_category(column_name, *values),
        kept,
    )


AUDIT_COLUMNS = ("label", "table_name", "row_id", "field", "category", "checked", "masked", "violation")


def audit_profile_values(
    rows: DataFrame,
    classification: DataFrame,
    value_fields: Sequence[str],
    label: str,
    policy: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every filled value field of written profile rows, with the violation it is, if any."""
    classes = classification.select(
        *keys, F.col("sensitivity_category").alias("__category"), F.col("evidence").alias("__evidence")
    )
    joined = _matches_case_folded(rows, classes, keys)
    own = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    evidence = F.coalesce(F.nullif(F.col("__evidence"), F.lit("")), own("sensitivity_evidence"))
    category = effective_category(
        F.col("__category"), F.col("__evidence"), own("sensitivity_category"),
        F.col("column_name"), [F.col(f) for f in value_fields],
    )
    type_name = base_type_name(own("data_type"))
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in value_fields]
    )
    # Classified before the fields are spread: once per row, and out of reach of later filters.
    long = (
        joined.withColumn("__effective", category)
        .select(
            F.lit(label).alias("label"), F.col(keys[0]).alias("table_name"),
            F.col("column_name").alias("row_id"), F.col("__effective").alias("category"),
            _reviewed(F.col("__effective"), evidence).alias("reviewed"),
            type_name.alias("type_name"), F.explode(fields).alias("item"),
        )
        .select("*", "item.field", "item.value")
        .where(is_present(F.col("value")))
    )
    sensitive = _sensitive(F.col("category"))
    safe = is_safely_masked(F.col("value"), F.col("category"))
    text = strip(F.col("value"))
    token = (text.isin(fixed.REDACTED, fixed.BINARY_REDACTED)) | text.rlike(fixed.MASKED_TOKEN)
    plain = F.coalesce(
        F.col("type_name").isin(*fixed.NUMERIC_TYPES, *fixed.DATE_TYPES), F.lit(False)
    )
    binary = F.coalesce(F.col("type_name").isin(*fixed.BINARY_TYPES), F.lit(False))
    if policy == "aggregate_only":
        violation = F.lit("profile value retained under aggregate_only")
        checked = masked = F.lit(False)
    else:
        unmasked = F.concat(F.lit("unmasked "), F.col("category"), F.lit(" value"))
        violation = F.when(sensitive & ~safe, unmasked)
        checked, masked = sensitive, F.lit(False)
        if policy == "mask_unknown_text":
            masked = F.when(sensitive, safe).otherwise(token)
            violation = (
                violation.when(sensitive | token, F.lit(None))
                .when(binary, "unredacted binary profile value")
                .when(F.col("reviewed") | plain, F.lit(None))
                .otherwise("unmasked unknown text profile value")
            )
    return long.select(
        "label", "table_name", "row_id", "field", "category", checked.alias("checked"),
        masked.alias("masked"), violation.alias("violation"),
    )


def audit_table_values(
    df: DataFrame, table_name: str, categories: Mapping[str, str], row_id: str,
    detect: bool = True,
) -> DataFrame:
    """Every filled cell of a written table that must be masked, with its violation, if any.

    Columns with a sensitive category must hold tokens only. Other columns are re-detected from
    their name and, cell by cell, from their values unless ``detect`` is off.
    """
    cells = []
    for field in df.schema.fields:
        category = F.lit(categories.get(field.name, "Unknown"))
        value = text_form(col_of(field.name), field.dataType)
        if categories.get(field.name) not in fixed.SENSITIVE_CATEGORIES:
            if not detect or field.name == row_id:
                continue
            category = detected_category(F.lit(field.name), value)
        cells.append(
            F.struct(F.lit(field.name).alias("field"), value.alias("value"), category.alias("category"))
        )
    long = df.select(
        col_of(row_id).cast("string").alias("row_id"), F.explode(F.array(*cells)).alias("cell")
    ).select("row_id", "cell.*")
    unmasked = F.concat(F.lit("unmasked "), F.col("category"), F.lit(" sample"))
    return long.where(is_present(F.col("value")) & F.col("category").isNotNull()).select(
        F.lit("sample").alias("label"), F.lit(table_name).alias("table_name"), "row_id", "field",
        "category", F.lit(True).alias("checked"), F.lit(False).alias("masked"),
        F.when(~is_safely_masked(F.col("value"), F.col("category")), unmasked).alias("violation"),
    )


def audit_violations(audited: DataFrame) -> DataFrame:
    return audited.where("violation IS NOT NULL").select(
        "table_name", "row_id", "field", "category", "violation"
    )


def audit_summary(audited: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """One row per check: what was checked, how often it failed, whether it passed."""

    def check(name: str, rows: DataFrame, bad: Column, checked: Column) -> DataFrame:
        return rows.agg(
            F.count_if(checked).alias("values_checked"), F.count_if(bad).alias("violations")
        ).select(
            F.lit(name).alias("check_name"), "values_checked", "violations",
            (F.col("violations") == 0).alias("passed"),
        )

    violated = F.col("violation").isNotNull()
    sample = F.col("label") == "sample"
    checks = [
        check("profile_values_masked", audited, violated & ~sample, F.col("checked") & ~sample),
        check("sample_values_masked", audited, violated & sample, F.col("checked") & sample),
    ]
    if secrets is not None:
        always = F.lit(True)
        checks.append(check("configured_secrets_absent", secrets, F.col("literal_found"), always))
        checks.append(check("secret_assignments_redacted", secrets, F.col("assignment_found"), always))
    return reduce(DataFrame.unionAll, checks)
