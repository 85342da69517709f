"""Query op7_line_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import LEAST_WORDS, remove_repeats


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, first_removed (-1: none) and kept_md5 for every document."""
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_units", "n_removed", length.alias("removed_chars"), F.coalesce(F.get("removed.start", 0), F.lit(-1).cast("long")).alias("first_removed"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS ps FROM documents
), raw AS (
  SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM split
), placed AS (
  SELECT *, list_filter(string_split_regex(lower(piece), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM raw
), full_ AS (
  SELECT doc_id, k, array_to_string(w, ' ') AS norm, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS no,
    sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM placed WHERE len(w) > 0
), docs AS (
  SELECT doc_id, list(norm ORDER BY no) AS norms, list(k ORDER BY no) AS ks FROM full_ GROUP BY doc_id
), short AS (
  SELECT a.doc_id, a.no AS a, b.no AS b FROM full_ a ASOF JOIN full_ b ON a.doc_id = b.doc_id AND a.upto - a.n + {LEAST_WORDS} <= b.upto
), units AS (
  SELECT * FROM short UNION SELECT doc_id, max(a), any_value(len(norms)) FROM short JOIN docs USING (doc_id) GROUP BY doc_id
), ranked AS (
  SELECT u.doc_id, a, b, ks, first_value(u.doc_id) OVER g AS f_id, first_value(a) OVER g AS f_a, first_value(b) OVER g AS f_b
  FROM units u JOIN docs USING (doc_id) WINDOW g AS (PARTITION BY array_to_string(list_slice(norms, a, b), ' ') ORDER BY u.doc_id, a, b)
), spans AS (
  SELECT DISTINCT doc_id, ks[CASE WHEN doc_id = f_id THEN greatest(a, f_b + 1) ELSE a END] AS lo, ks[b] AS hi FROM ranked
  WHERE NOT (doc_id = f_id AND a = f_a AND b = f_b) AND (doc_id <> f_id OR f_b < b)
), gone AS (
  SELECT DISTINCT p.doc_id, p.k FROM placed p JOIN spans s ON p.doc_id = s.doc_id AND p.k BETWEEN s.lo AND s.hi
), marked AS (
  SELECT p.*, g.k IS NOT NULL AS gone FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k
), sums AS (
  SELECT doc_id, count(*) FILTER (len(w) > 0) AS n_units, count(*) FILTER (len(w) > 0 AND gone) AS n_removed, coalesce(sum(length(piece)) FILTER (gone), 0) AS removed_chars,
    coalesce(min(start) FILTER (gone), -1) AS first_removed, coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
  CAST(coalesce(first_removed, -1) AS BIGINT) AS first_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
}
