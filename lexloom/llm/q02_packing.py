"""Query op2_packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack

END_ID = 2


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
