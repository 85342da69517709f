"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0 .. shards - 1 of a key, without a ring table.

    A key jumps from shard b to floor((b + 1) / r) for as long as that is below the number of shards, where the r in (0, 1]
    are a sequence that the key alone decides; XXH64 of the key and the number of the jump gives it. When a shard is appended,
    a key stays or goes to the new one, which takes 1 / (shards + 1) of the keys. b grows with each jump, so that
    `shards` steps suffice.
    """
    if shards < 1:
        raise ValueError("at least one shard")

    def jump(acc: Column, i: Column) -> Column:
        r = (F.shiftrightunsigned(F.xxhash64(acc["key"], i), 33) + 1).cast("double") / float(1 << 31)
        after = F.floor((acc["at"] + 1) / r).cast("long")
        on = ~acc["done"]
        return F.struct(
            acc["key"].alias("key"), F.when(on & (after < shards), after).otherwise(acc["at"]).alias("at"), (acc["done"] | (after >= shards)).alias("done")
        )

    start = F.struct(key.alias("key"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda acc: acc["at"].cast("int"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The law is "key": doc_id and the number of shards decide, grown_shard is the shard with one more. size is the text's UTF-8
    bytes plus 1. slot numbers a shard's rows from 0 without gaps: rows are counted in buckets, and a row's slot is the
    rows of the buckets before plus its place in its own, so that no shard is one task's work; rows that repeat a doc_id
    get slots of their own, spread by where they were read. Null texts count as empty, a null doc_id is a key as any other
    (it hashes to the seed); other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col))
    buckets = max(32, partitions(spark))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"),
    )
    rows = materialize(rows, "shard-rows")
    sums = materialize(rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("k")), "shard-sums")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("shard", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("_n", inside).join(first, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet, one folder shard=N for each shard."""
    docs.withColumn("shard", jump_hash(F.xxhash64(F.col(id_col)), shards)).write.partitionBy("shard").parquet(path)
