"""Query op11_bpe_lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .q04_bpe import vocabulary
from .transducer import round_trip_digests


def op11_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {"op11_bpe_lexicon": op11_bpe_lexicon}
ORACLE: dict[str, str] = {}
