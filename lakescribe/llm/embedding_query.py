"""op3: near-dedup of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import embedding_groups


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}

ORACLES = {
    "op3_embedding_dedup": r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links AS l WHERE l.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings AS e JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)"""
}
