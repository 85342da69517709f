"""Query op8_suffix_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .suffix_dedup import remove_repeats


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    rows = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("span_start").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE: dict[str, str] = {}
