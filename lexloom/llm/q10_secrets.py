"""Query op10_secret_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import scan


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word_no, run_no, n_chars, candidate_sha256, is_secret for every candidate of every document."""
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "word_no", "run_no", F.char_length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "is_secret")


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE: dict[str, str] = {}
