"""Publishing profile rows: mask, write, audit what was written, release only if it passes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import masking
from ..sources.shared import fresh_folder


class PublicationRefused(RuntimeError):
    """The audit of the staged copy found violations; nothing was published."""


def publish_profiles(
    row_sets: Mapping[str, tuple[DataFrame, Sequence[str]]],
    classification: DataFrame,
    salt: str,
    target: str,
    policy: str = "mask_unknown_text",
    literals: Iterable[str] = (),
) -> DataFrame:
    """Publishes named row sets (rows, value fields) below ``target`` and returns the audit summary.

    The audit reads the staged files, not the DataFrames they came from. Its violations, the
    recorded number of masked values and any secret left in a value field refuse the release.
    """
    spark = classification.sparkSession
    staging = fresh_folder(spark, "publication")
    audits, secrets = [], []
    recorded = 0
    for name, (rows, fields) in row_sets.items():
        published = masking.publication_policy(rows, classification, fields, salt, policy)
        published.write.parquet(f"{staging}/{name}")
        staged = spark.read.parquet(f"{staging}/{name}")
        recorded += masking.publication_counters(staged).first()["profile_values_masked"]
        audits.append(masking.audit_profile_values(staged, classification, fields, name, policy))
        secrets.append(
            masking.secret_scan(
                staged.select(F.concat_ws("\n", *fields).alias("text")), "text", tuple(literals)
            ).select("literal_found", "assignment_found")
        )
    audited = reduce(DataFrame.unionByName, audits)
    summary = masking.audit_summary(audited, reduce(DataFrame.unionAll, secrets))
    counted = audited.agg(F.count_if(F.col("masked")).alias("n")).first()["n"]
    failed = [r["check_name"] for r in summary.where("NOT passed").collect()]
    if policy == "mask_unknown_text" and counted != recorded:
        failed.append("masked_value_count")
    if failed:
        raise PublicationRefused(f"audit failed: {', '.join(failed)}; staged copy at {staging}")
    for name in row_sets:
        spark.read.parquet(f"{staging}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return summary
