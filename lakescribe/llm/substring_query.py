"""op2: substring dedup over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .substring_dedup import substring_dedup


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=20)


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLES = {
    "op2_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM windows)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS i FROM later),
gone_of AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone_of USING (doc_id)"""
}
