"""What the findings of round 3 were about, in small."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_each_text_is_worked_on_once_wherever_it_stands(spark):
    from lexloom.operators import dataset

    rows = [(1, 0, "a"), (1, 0, "b"), (2, 1, "a"), (None, 3, "c"), (4, None, "d"), (5, 5, None)] + [(k, 9, "e") for k in range(50)]
    texts = spark.createDataFrame(rows, "group_id long, ordinal long, text string").repartition(7)
    assert sorted(r.text for r in dataset.work_off(texts, None, lambda df: df, 3).collect()) == ["a", "b", "c", "d", "e"]
    groups = {r.text: r.group_id for r in dataset.work_off(texts.where("text = 'e'"), None, lambda df: df, 3).collect()}
    assert groups == {"e": 0}


def test_a_task_sends_the_best_of_all_its_blocks(spark, monkeypatch):
    from lexloom.operators import retrieve

    monkeypatch.setattr(retrieve, "ROWS", 50), monkeypatch.setattr(retrieve, "BLOCK", 10), monkeypatch.setattr(retrieve, "HELD_BYTES", 20_000)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 4)), 1)
    x[300:600] = x[:300]  # ties go to the smaller id
    df = spark.createDataFrame([(f"i{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>").repartition(2)
    queries = df.where("id like '%0'")
    sent = retrieve._by_all(df, queries, 5, 6, "string")
    assert sent.count() <= 90 * 5 * 2  # before: 5 of every block of 50
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {f"i{q:04d}": [f"i{i:04d}" for i in np.lexsort((np.arange(900), -np.round(unit @ unit[q], 6)))[:5]] for q in range(0, 900, 10)}
    got = {}
    for r in sorted(retrieve.nearest(df, queries, 5).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_sentences_are_decoded_together_as_alone():
    from lexloom.operators import tagger

    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 9, rng.integers(1, 12))
        scores, steps = rng.integers(-3, 4, (sizes.sum(), 4)).astype(float), rng.integers(-3, 4, (5, 4)).astype(float)
        alone = np.concatenate([tagger.viterbi(x, steps) for x in np.split(scores, np.cumsum(sizes)[:-1])])
        assert (tagger._decode(scores, steps, sizes) == alone).all()


def test_labels_of_long_texts_are_linear_in_their_tokens(spark):
    from lexloom.operators import gazetteer

    texts = spark.createDataFrame([(1, "a b " * 20_000)], "id long, text string")
    rows = gazetteer.token_labels(texts, gazetteer.entities(texts, spark.createDataFrame([("a", "X")], "name string, label string")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan  # it was made anew for each token
    assert rows.first().entities == ["X", "O"] * 20_000


def test_vectors_are_copied_once_a_block_however_many_cells(monkeypatch):
    import pandas as pd

    from lexloom.llm import embedding_dedup as E

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    centroids = E.spherical_kmeans(E._unit(x), 100, 3)
    cos = E._unit(x) @ centroids.T
    cell, angle = cos.argmax(1), np.arccos(cos.max(1))
    size, radius = np.bincount(cell, minlength=100), np.array([angle[cell == c].max(initial=0) for c in range(100)])
    first, count, n = E._dealt(centroids, size, 1000)
    assert n <= 5 and (count == 1).all()
    run = E._copies(centroids, radius, first, count, n, 0.95, np.float32)
    rows = pd.concat(run([pd.DataFrame({"uid": np.arange(3000), "weight": 1, "embedding": list(x)})]))
    assert rows["ids"].str.len().sum() // 8 <= 3000 * n  # before: nearly all cells
    crowded = E._dealt(centroids[:2], np.array([2500, 10]), 1000)
    assert crowded[1].tolist() == [3, 1] and crowded[2] == 4


def test_a_writer_unpacks_a_few_messages_at_a_time(tmp_path, monkeypatch):
    import pyarrow as pa

    from lexloom.sources import frames

    sizes, batch = [], pa.RecordBatch.from_pylist([{"title": f"t{i}", "paragraphs": []} for i in range(100)])

    class Batch:
        num_rows = batch.num_rows

        def slice(self, at, n):
            sizes.append(n)
            return batch.slice(at, n)

    message = frames.FrameWriter(str(tmp_path), 1 << 20, False).write(iter([Batch()]))
    assert max(sizes) <= frames.SLICE and len(sizes) == -(-100 // frames.SLICE)
    frames.FrameWriter(str(tmp_path), 1 << 20, False).commit([message])
    data = (tmp_path / message.names[0]).read_bytes()
    assert [frames.decode(f, frames.ARTICLE_FIELDS)["title"] for f in frames.frames(data)] == [f"t{i}" for i in range(100)]


def test_blocks_stay_together_for_some_rounds_and_new_sources_need_no_steps(spark, monkeypatch):
    from lexloom.operators import embed

    names, plain = [], embed.written
    monkeypatch.setattr(embed, "written", lambda df, name, by=None: names.append(name) or plain(df, name, by))
    monkeypatch.setattr(embed, "CHUNK", 3)
    pairs = spark.createDataFrame([(i, f"w{(i + k) % 30}", 1) for i in range(40) for k in range(5)], "source long, target string, n long")
    model = embed.train(pairs, 4, rounds=6, blocks=3)
    assert names.count("vector-blocks") == 1 + 2  # before: 1 + 6 rounds x 3 blocks, each a table of all vectors
    assert embed.losses(model).first()["pairs"] == 200 and embed.vectors(model).count() == 40
    names.clear()
    monkeypatch.setattr(embed, "NEW_PAIRS", 20), monkeypatch.setattr(embed, "POOL", 10)
    new = embed.infer(model, pairs.where("source < 20"), rounds=6)
    assert new.count() == 20 and sum(n == "new-vectors" for n in names) == 1 and len(names) <= 4  # before: 6 x 3 tables of new-blocks


def test_blocks_are_as_few_as_memory_allows(spark, monkeypatch):
    from lexloom.operators import embed

    pairs = spark.createDataFrame([(i, i + 1, 1) for i in range(100)], "source long, target long, n long")
    monkeypatch.setattr(embed, "BLOCK_BYTES", 100 * 5 * 4)
    assert embed.train(pairs, 4, rounds=1).blocks == 1
    monkeypatch.setattr(embed, "BLOCK_BYTES", 40 * 5 * 4)
    assert embed.train(pairs, 4, rounds=1).blocks == 3


def test_small_pages_are_looked_through_without_digests_of_words(spark, monkeypatch):
    from lexloom.operators import spans

    rows = [(p, i, f"w{p} x{i} y{i % 3} z") for p in range(4) for i in range(3 if p else 9)] + [(5, 0, None), (5, 1, "a b"), (5, 2, "c d")]
    p = spark.createDataFrame(rows, "page_id long, pos int, text string")
    m = spark.createDataFrame([(k, "x1 y1", "y1") for k in range(4)] + [(0, "y2 z w0 x6", "w0"), (5, "b c", "c"), (5, "b  c", "c"), (1, "z w1 x2", "x2"), (1, "z w1 x9", "z")], "page_id long, sentence string, answer string")
    found = lambda: sorted((r.page_id, r.sentence, r.context, r.answer_start) for r in spans.locate(m, p).collect())
    monkeypatch.setattr(spans, "PAGE_PARAGRAPHS", 0)
    want = found()
    monkeypatch.setattr(spans, "PAGE_PARAGRAPHS", 3)
    assert found() == want and len(want) == 7
    monkeypatch.setattr(spans, "PAGE_PARAGRAPHS", 9)
    monkeypatch.setattr(spans, "_digests", None)  # before: each word and pair of words of all pages was shuffled
    assert found() == want


def test_vectors_meet_cells_a_few_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    from lexloom.operators import cells

    rng, seen, plain = np.random.default_rng(6), [], cells._matrix
    x, centroids = rng.normal(size=(500, 4)), rng.normal(size=(40, 4))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_pylist([{"id": i, "vector": v.tolist()} for i, v in enumerate(x)])
    index = cells.Cells(None, centroids, np.full(40, 0.3), np.full(40, 9), 4)
    steps = (cells._assigned(centroids, 4), cells._probed(index, "long", 7, False, 6))
    want = [pa.Table.from_batches(run(iter([batch]))).sort_by([("id", "ascending"), ("cell", "ascending")]) for run in steps]
    monkeypatch.setattr(cells, "_matrix", lambda column, dim: seen.append(len(column)) or plain(column, dim))
    monkeypatch.setattr(cells, "ENTRIES", 400)
    for run, w in zip(steps, want):
        assert pa.Table.from_batches(run(iter([batch]))).sort_by([("id", "ascending"), ("cell", "ascending")]).equals(w)
    list(cells._sums(centroids, 4)(iter([batch.select(["vector"])])))
    assert max(seen) <= 10  # before: 500, all of a batch times all cells


def test_markup_is_cleaned_a_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from lexloom.functions import markup

    held, plain = [], pa.Array.to_pylist

    class Texts:
        type = pa.string()

        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, i, n):
            held.append(n)
            return self.values.slice(i, n)

    texts = pa.array([f"[[a|b{i}]] {{{{x}}}} &amp;" for i in range(300)] + [None])
    assert plain(markup._few(markup._bare)(Texts(texts))) == [f"b{i}  &" for i in range(300)] + [None]
    assert max(held) <= markup.SLICE  # before: a whole batch as Python objects
    twice = spark.createDataFrame([("a",)], "t string").withColumn("t", markup.clean(F.col("t"))).where("t rlike 'a'")
    assert twice._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # before: 4, the filter had its own
    rows = spark.createDataFrame([("[[File:a|[[b]] c]]x {{y}} [[p|q]]",), (None,), ("",)], "t string").select(markup.clean(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["x q", None, ""]


def test_a_stream_gives_a_few_files_at_a_time_in_their_order(spark, tmp_path, monkeypatch):
    from lexloom.operators import translate
    from lexloom.streaming import batches

    monkeypatch.setattr(batches, "FILE_BYTES", 4_000), monkeypatch.setattr(batches, "BATCH_BYTES", 16_000)
    rows = spark.range(600).select((F.col("id") % 3 * F.col("id") % 2).cast("string").alias("group_id"), F.pmod(F.col("id") * 7, F.lit(601)).alias("ordinal"), F.when(F.col("id") % 11 > 0, F.repeat(F.lit("ż"), (F.col("id") % 40).cast("int"))).alias("text"))
    path, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    timed = rows.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).repartition(5)
    files = batches.arrive(timed, path)
    last = spark.createDataFrame([("end", -1, "", "2024-01-03 00:00:00")], "group_id string, ordinal long, text string, at string")
    last.withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = batches.batched(stream, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p.numInputRows for p in query.recentProgress) < 300  # before: all in one
    found = sorted((r.group_id, r.ordinal, r.batch) for r in spark.read.parquet(out).select("group_id", "batch", F.explode("ordinals").alias("ordinal")).where("group_id <> 'end'").collect())
    want = translate.request_batches(rows.select("group_id", "ordinal", F.char_length("text").alias("size")), 100)
    assert found == sorted((r.group_id, r.ordinal, r.batch) for r in want.collect()) and len(found) == 600
    assert batches.arrive(timed.where("false"), str(tmp_path / "none")) == 1
