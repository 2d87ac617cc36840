"""op6: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import KINDS, find_personal_data


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_context"),
    )


QUERIES = {"op6_personal_data": op6_personal_data}

#: SQL would have to repeat the rounds of scoring; tests/llm compares with a brute-force version.
ORACLES: dict = {}
