"""Query op5_simhash_near_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import fingerprint_hex, simhash_groups


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept for every document."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id", (groups["doc_id"] == groups["component_id"]).alias("kept"))


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLE: dict[str, str] = {}
