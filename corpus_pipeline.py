"""A pipeline from raw documents to packed sequences.

Each stage works on all rows that its predecessor kept, is written as Parquet into the shared folder and read again:
quality rules drop documents, SimHash near-dedup keeps one document of each group, suffix-array dedup takes repeated passages
out of the texts, the secret scan replaces secrets, and packing returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import packing, quality_rules, secrets, simhash, suffix_dedup
from lexloom.llm.common import materialize, table
from lexloom.llm.q02_packing import END_ID, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars of the text as it is now. All stages take the columns of documents, leave out others, whatever their names, and give an empty table for an empty one."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or an empty text has no words and goes, a null lang or label is one of its own, repeated rows stay or go together."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words): the smallest doc_id (null last), of equal rows one. Texts without words, null ones too, are one group; very long ones are compared whole."""
    return simhash.keep_one(docs, words_per_shingle=5).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that occur elsewhere too; all rows stay, in repeated rows of long texts nothing is left, and null texts become empty."""
    left = suffix_dedup.remove_repeats(docs.select("doc_id", "text", "lang", "source"))
    return _documents(left.select("doc_id", F.col("kept").alias("text"), "lang", "source"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; all rows stay, repeated ones are alike, null and empty texts stay as they are, very long ones are scanned whole."""
    return _documents(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; repeated rows are documents of their own, a null or an empty text is an end id, and a very long one is cut."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), END_ID, keep_words=False)


STAGES = [
    ("quality rules", drop_bad),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: Fingerprints, a forest and a tokenizer are beyond SQL: the tests run the stages on planted cases, and hold the operators behind them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
