"""Incremental runs: append what isn't done yet, and counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of each batch, rows whose key the table at path doesn't have yet are worked on and appended.

    A batch that is run again after a failure finds its rows done; a key that a batch repeats is worked on once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        done = existing(batch.sparkSession, path)
        if done is not None:
            rows = rows.join(done.select(F.col(key).alias("_done")), F.col(key) == F.col("_done"), "left_anti")
        work(rows).write.mode("append").parquet(path)

    return run


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None before anything was written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resume(stream: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that works off the stream with append_new, as far as it goes now."""
    return stream.writeStream.foreachBatch(append_new(path, key, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def category_windows(events: DataFrame, time: str, category: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, category, n) over windows of event time; rows later than the watermark are dropped by a stream, and not by a table."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "category", "n")
