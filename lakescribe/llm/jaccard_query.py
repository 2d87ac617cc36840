"""op10: n-gram Jaccard join of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard_join import jaccard_groups


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=80, n=5).drop("copy_of", "text_name")


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}

ORACLES = {
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
    lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS p FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes AS x ON x.doc_id = a.doc_id JOIN sizes AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
}
