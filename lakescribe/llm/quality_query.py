"""op8: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import measure_quality


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_quality_rules": op8_quality_rules}

ORACLES = {
    "op8_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l,
    row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM base WHERE len(w) >= 3),
repeated AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, p + unnest([0, 1, 2]) AS i FROM repeated) GROUP BY r),
measured AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(t, '[^\pL]+', '', 'g')) AS letters
  FROM base LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words
    AND 100 * letters >= 60 * word_chars AND 100 * n_dup_lines <= 30 * n_lines AS kept
FROM failed"""
}
