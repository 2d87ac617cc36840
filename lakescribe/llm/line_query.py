"""op9: line dedup of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_templates import line_dedup


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}

ORACLES = {
    "op9_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS number
  FROM documents),
lines AS (
  SELECT doc_id, text, number, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM (SELECT *, list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM raw)
  WHERE len(w) > 0),
named AS (
  SELECT doc_id, text, number, len(w)::VARCHAR || ' ' || array_to_string(w[1:4], ' ') AS leaf, array_to_string(w, ' ') AS literal
  FROM lines),
counted AS (
  SELECT leaf, literal, count(DISTINCT text) AS texts, min(doc_id) AS doc FROM named GROUP BY leaf, literal),
totals AS (SELECT leaf, sum(texts) AS total FROM counted GROUP BY leaf HAVING sum(texts) >= 6 AND count(*) > 1),
tokens AS (
  SELECT leaf, literal, texts, total, unnest(string_split(literal, ' ')) AS token,
    generate_subscripts(string_split(literal, ' '), 1) AS place
  FROM counted JOIN totals USING (leaf)),
fixed AS (
  SELECT leaf, place, token FROM tokens WHERE token <> '<*>' GROUP BY leaf, place, token
  HAVING sum(texts) >= 6 AND 100 * sum(texts) >= 30 * max(total)),
templates AS (
  SELECT leaf, literal, max(texts) AS texts,
    string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY place) AS template
  FROM tokens AS t LEFT JOIN fixed AS f USING (leaf, place, token) GROUP BY leaf, literal
  HAVING 100 * count(f.token) >= 70 * count(*)),
recurring AS (SELECT leaf, template FROM templates GROUP BY leaf, template HAVING sum(texts) >= 6),
own AS (
  SELECT c.leaf, c.literal, CASE WHEN r.template IS NULL THEN 'line ' || c.literal ELSE 'template ' || r.template END AS template, c.doc
  FROM counted AS c LEFT JOIN templates AS t ON t.leaf = c.leaf AND t.literal = c.literal
  LEFT JOIN recurring AS r ON r.leaf = t.leaf AND r.template = t.template
  WHERE r.template IS NOT NULL OR c.texts >= 6),
first AS (SELECT leaf, template, min(doc) AS first_doc FROM own GROUP BY leaf, template),
gone AS (
  SELECT DISTINCT n.doc_id, n.number FROM named AS n JOIN own AS o ON o.leaf = n.leaf AND o.literal = n.literal
  JOIN first AS f ON f.leaf = o.leaf AND f.template = o.template WHERE n.doc_id <> f.first_doc),
kept AS (
  SELECT r.doc_id, string_agg(line, chr(10) ORDER BY number) FILTER (g.number IS NULL) AS text, count(g.number) AS n_removed
  FROM raw AS r LEFT JOIN gone AS g USING (doc_id, number) GROUP BY r.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM named AS n WHERE n.doc_id = d.doc_id) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept AS k USING (doc_id)"""
}
