"""Query op4_byte_bpe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip_digests
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE: dict[str, str] = {}
