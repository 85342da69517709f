"""The tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_lines(lines: DataFrame, name: str) -> str:
    """The path of a set of text files with the rows of lines (value)."""
    path = scratch(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path
