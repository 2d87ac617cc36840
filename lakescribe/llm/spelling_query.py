"""op12: spelling variants among the words of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spelling import spelling_forms, vocabulary


def misspelled(doc_id: Column, run: Column) -> Column:
    """The run without one letter where 31 divides the checksum of document and run; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_forms(vocabulary(docs, least_length=7, least_count=2, spelled=misspelled), ratio=10)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

ORACLES = {
    "op12_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
keyed AS (SELECT DISTINCT doc_id, w, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM runs),
summed AS (
  SELECT doc_id, w, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM keyed, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word
  FROM runs JOIN summed USING (doc_id, w)),
vocab AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
shorter AS (SELECT DISTINCT l.word AS a, l.n AS an, v.word AS b, v.n AS bn FROM less AS l JOIN vocab AS v ON v.word = l.rest),
near AS (
  SELECT a AS word, an AS n, b AS other, bn AS other_n FROM shorter UNION ALL SELECT b, bn, a, an FROM shorter
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM less AS x JOIN less AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
    CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM vocab AS v LEFT JOIN (SELECT * FROM best WHERE k = 1) AS b USING (word)),
way(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM way AS w JOIN forms AS f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM forms AS f JOIN way AS w USING (word) JOIN forms AS last ON last.word = w.root WHERE last.form IS NULL"""
}
