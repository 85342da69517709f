"""Query op3_embedding_near_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import near_duplicates


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLE = {
    "op3_embedding_near_dedup": """
WITH RECURSIVE d AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM d WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.n AS a, b.n AS b, b.vec_id AS b_id FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.95),
r AS (SELECT n, n AS at, vec_id AS id FROM d UNION SELECT r.n, p.b, p.b_id FROM r JOIN p ON r.at = p.a)
SELECT d.vec_id, coalesce(any_value(k.n_links), 0) AS n_links, min(r.id) AS component_id, d.vec_id = min(r.id) AS kept
FROM d JOIN r USING (n) LEFT JOIN (SELECT a AS n, count(*) AS n_links FROM p GROUP BY a) k USING (n) GROUP BY d.n, d.vec_id
"""
}
