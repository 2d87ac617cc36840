"""Bounded samples: in which order, whether at all, and masked before anyone sees them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fixed
from ..functions.text import contains_any, is_true, mask_value
from ..functions.types import col_of
from ..policy import Policy
from ..sources.shared import materialize
from .lineage import ALLOWED
from .profile import known_row_estimate
from .sensitivity import (
    OverrideRule, UNKNOWN, _field_rank, _result, name_result, override_result, signal_result,
)

TABLE = ["schema_name", "object_name"]


def ordering_columns(primary_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Per table the columns a sample is ordered by: its primary key, else its first unique index.

    The first index is the lowest (index_id, name) among the unique ones that are enabled and
    unfiltered. Key columns are few, so a table's list fits a row.
    """

    def in_order(rows: DataFrame, strategy: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("key_ordinal", "column_name")))
        names = F.array_join(F.transform(listed, lambda item: item["column_name"]), ",")
        return rows.groupBy(*TABLE).agg(names.alias("order_columns")).withColumn(
            "ordering_strategy", F.lit(strategy)
        )

    usable = (F.col("key_ordinal") > 0) & (F.coalesce("column_name", F.lit("")) != "")
    by_key = in_order(primary_keys.where(usable), "PRIMARY_KEY")
    unique = indexes.where(
        usable & is_true(F.col("is_unique")) & ~is_true(F.col("is_disabled"))
        & ~is_true(F.col("has_filter")) & ~is_true(F.col("is_included_column"))
    )
    identity = F.struct(
        F.coalesce(known_row_estimate(F.col("index_id")), F.lit(0)).alias("id"),
        F.lower(F.coalesce("index_name", F.lit(""))).alias("name"), F.col("index_name").alias("exact"),
    )
    first = unique.groupBy(*TABLE).agg(F.min(identity).alias("first"))
    chosen = unique.withColumn("this", identity).join(first, TABLE).where("this = first")
    by_index = in_order(chosen, "UNIQUE_INDEX")
    return by_key.unionAll(by_index.join(by_key.select(*TABLE), TABLE, "left_anti"))


def sample_plan(
    objects: DataFrame, sizes: DataFrame, ordering: DataFrame, policy: Policy = Policy(),
    eligibility: DataFrame | None = None,
) -> DataFrame:
    """Whether and how each object is sampled; ``objects`` has ``object_type``.

    A view needs a row of :func:`..lineage.view_sample_eligibility` that allows it.
    """
    joined = objects.join(sizes.select(*TABLE, "row_count"), TABLE, "left").join(ordering, TABLE, "left")
    if eligibility is None:
        denied = F.lit("VIEW_ELIGIBILITY_EVIDENCE_NOT_PROVIDED")
        joined = joined.withColumns({"view_status": F.lit(None).cast("string"), "view_reason": denied})
    else:
        joined = joined.join(
            eligibility.select(
                *TABLE, F.col("status").alias("view_status"),
                F.col("eligibility_reason").alias("view_reason"),
            ),
            TABLE, "left",
        )
    kind = F.upper(F.trim("object_type"))
    table, view = kind.isin("TABLE", "USER_TABLE"), kind == "VIEW"
    limit = policy.profile_row_limit
    large = F.lit(False) if limit is None else F.coalesce(known_row_estimate(F.col("row_count")) > limit, F.lit(False))
    allowed = F.coalesce(F.col("view_status") == ALLOWED, F.lit(False))
    status = (
        F.when(table & F.lit(not policy.sample_tables), "SKIPPED_TABLE_SAMPLING_DISABLED")
        .when(table & large & F.lit(not policy.sample_large_tables), "SKIPPED_LARGE_TABLE_SAMPLING_DISABLED")
        .when(table, "READY")
        .when(view & F.lit(not policy.sample_views), "SKIPPED_VIEW_SAMPLING_DISABLED")
        .when(view & ~allowed, "SKIPPED_EXTERNAL_OR_OPAQUE_VIEW_DEPENDENCY")
        .when(view, "READY")
        .otherwise("SKIPPED_UNSUPPORTED_OBJECT_TYPE")
    )
    ready = F.col("status") == "READY"
    return joined.withColumn("status", status).select(
        *TABLE, "object_type", F.lit(policy.sample_rows).alias("requested_rows"),
        F.when(~ready, "NOT_APPLICABLE").when(view, "UNORDERED_TOP_VIEW")
        .otherwise(F.coalesce("ordering_strategy", F.lit("UNORDERED_TOP"))).alias("ordering_strategy"),
        F.when(ready & table, F.col("order_columns")).alias("order_columns"),
        "status",
        F.when(view & ~ready, F.col("view_reason")).otherwise("").alias("eligibility_reason"),
    )


def bounded_sample(df: DataFrame, rows: int, key_columns: Sequence[str] = ()) -> DataFrame:
    """The first rows by key (a top-k per task, then one merge), or any rows without one."""
    if rows < 1:
        raise ValueError("a sample needs a positive number of rows")
    ordered = df.orderBy(*[col_of(c) for c in key_columns]) if key_columns else df
    return ordered.limit(rows)


def _sample_class(field, rank: Column, rules: Sequence[OverrideRule], table_name: str) -> Column:
    named = name_result(F.lit(field.name))
    results = [named, signal_result(rank), _result(*UNKNOWN)]
    if rules:
        results.insert(
            0,
            override_result(
                rules, database=F.lit(""), schema=F.lit(""), table=F.lit(table_name),
                column=F.lit(field.name),
            ),
        )
    return F.coalesce(*results)


def sample_and_mask(
    df: DataFrame, table_name: str, rows: int, salt: str, key_columns: Sequence[str] = (),
    rules: Sequence[OverrideRule] = (),
) -> DataFrame:
    """A bounded sample in which every column that its name or any sampled value marks as
    sensitive is masked.

    Classification and masking see the same rows: the whole sample, at most ``rows`` of them, is
    one window, so it is drawn once.
    """
    sample = bounded_sample(df, rows, key_columns)
    whole = Window.partitionBy(F.lit(1))
    columns = []
    for field in df.schema.fields:
        rank = F.min(_field_rank(field)).over(whole)
        found = _sample_class(field, rank, rules, table_name)
        category = found.getField("sensitivity_category")
        columns.append(mask_value(col_of(field.name), category, salt, field.dataType).alias(field.name))
    return sample.select(*columns)


def masking_report(
    df: DataFrame, table_name: str, rows: int, key_columns: Sequence[str] = (),
    rules: Sequence[OverrideRule] = (),
) -> DataFrame:
    """One row per column of a sample: its class and why."""
    sample = bounded_sample(df, rows, key_columns)
    entries = [
        F.struct(
            F.lit(table_name).alias("table_name"), F.lit(field.name).alias("column_name"),
            _sample_class(field, F.min(_field_rank(field)), rules, table_name).alias("class"),
        )
        for field in df.schema.fields
    ]
    return (
        sample.agg(F.array(*entries).alias("entries"))
        .select(F.inline("entries"))
        .select(
            "table_name", "column_name", F.col("class.sensitivity_category").alias("category"),
            F.col("class.masking_action").alias("action"), "class.confidence", "class.evidence",
        )
    )


def sample_index(
    df: DataFrame, table_name: str, rows: int, key_columns: Sequence[str] = (),
    rules: Sequence[OverrideRule] = (), strategy: str | None = None,
) -> DataFrame:
    """One row per sampled object: rows asked for and returned, ordering, masked columns."""
    sample = bounded_sample(df, rows, key_columns)
    masked = sum(
        (
            _sample_class(field, F.min(_field_rank(field)), rules, table_name)
            .getField("sensitivity_category").isin(*fixed.SENSITIVE_CATEGORIES).cast("int")
            for field in df.schema.fields
        ),
        start=F.lit(0),
    )
    return sample.agg(
        F.count(F.lit(1)).alias("returned_rows"), masked.alias("masked_sensitive_column_count")
    ).select(
        F.lit(table_name).alias("table_name"), F.lit(rows).alias("requested_rows"), "returned_rows",
        F.lit(strategy or ("PRIMARY_KEY" if key_columns else "UNORDERED_TOP")).alias("ordering_strategy"),
        F.when(F.col("returned_rows") > 0, "SAMPLED").otherwise("EMPTY").alias("status"),
        "masked_sensitive_column_count",
    )


def draw_sample(
    df: DataFrame, table_name: str, rows: int, salt: str, key_columns: Sequence[str] = (),
    rules: Sequence[OverrideRule] = (), strategy: str | None = None,
) -> dict[str, DataFrame]:
    """The masked ``sample``, its masking ``report`` and its ``index`` of one and the same draw.

    Without a key two draws may differ, so the drawn rows (at most ``rows``) are written to the
    shared folder, unmasked as they are read, and all three results are taken from them.
    """
    drawn = materialize(bounded_sample(df, rows, key_columns), "sample")
    return {
        "sample": sample_and_mask(drawn, table_name, rows, salt, key_columns, rules),
        "report": masking_report(drawn, table_name, rows, key_columns, rules),
        "index": sample_index(drawn, table_name, rows, key_columns, rules, strategy),
    }


def sample_failure_status(message: Column) -> Column:
    """What an error text says about a failed sample."""
    return (
        F.when(contains_any(message, fixed.TIMEOUT_MARKERS), "FAILED_TIMEOUT")
        .when(contains_any(message, fixed.SAMPLE_ACCESS_MARKERS), "INACCESSIBLE")
        .otherwise("FAILED_QUERY")
    )


def is_access_limitation(message: Column) -> Column:
    """Whether an error is one of access, after which other reads may go on."""
    return contains_any(message, fixed.ACCESS_MARKERS)
