import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import sharding as S


def test_growth(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    rows = keys.select(*(S.jump_hash(F.col("k"), n).alias(f"s{n}") for n in (1, 2, 16, 17))).collect()
    assert {r.s1 for r in rows} == {0}
    for a, b in (("s1", "s2"), ("s16", "s17")):
        moved = [r for r in rows if r[a] != r[b]]
        assert {r[b] for r in moved} == {int(b[1:]) - 1}
        assert len(moved) == pytest.approx(20_000 / int(b[1:]), rel=0.1)
    for n in (2, 16, 17):
        counts = Counter(r[f"s{n}"] for r in rows)
        assert len(counts) == n and max(counts.values()) < 1.15 * 20_000 / n


def test_rows(spark):
    docs = [(i, f"text é {i}", i) for i in range(700)] + [(5, "again", 1)] * 40 + [(None, None, 2), (8, "", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard int").repartition(7)
    rows = S.shard(df, 16).collect()
    assert len(rows) == len(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in docs)
    by_shard, by_key = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(len(x) == 1 for x in by_key.values())
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert S.shard(df.limit(0), 16).count() == 0


def test_written(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    S.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.where(F.col("shard") != S.jump_hash(F.xxhash64("doc_id"), 4)).count() == 0
