"""Query op1_quality_model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .kneser_ney import classify


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_model": op1_quality_model}
ORACLE: dict[str, str] = {}
