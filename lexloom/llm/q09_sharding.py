"""Query op9_sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sharding import shard

SHARDS = 16


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    return shard(table(spark, sf_dir, "documents"), SHARDS)


QUERIES = {"op9_sharding": op9_sharding}
ORACLE: dict[str, str] = {}
