"""Query op13_whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .whitening import whiten


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and the first 8 components."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE: dict[str, str] = {}
