"""Streams of messages as a source, compressed dumps by their index, state over a stream, counters, extended documents, numbering and file order."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.markup import unescaped
from lexloom.operators import dataset, link, nest, report, spans, translate
from lexloom.sources import files, frames, multistream
from lexloom.sources.delimited import write_frames
from lexloom.sources.schemas import ARTICLE
from lexloom.streaming.batches import batched


def document(text):
    return {"text": text, "sentence": [{"token": [{"word": w, "pos": "X", "originalText": w, "ner": "O", "lemma": w.lower()} for w in text.split()]}]}


def article(i):
    q = {"id": f"q{i}", "question": document(f"what is {i}"), "answers": [document("a b")] * (i % 3), "answerOffsets": [i, -1]}
    return {"title": f"title {i}", "paragraphs": [{"context": document("ź " * (i % 50)), "qas": [q]}]}


def test_frames_are_read_in_parts(spark, tmp_path):
    spark.dataSource.register(frames.FrameSource)
    path = str(tmp_path / "articles")
    wanted = [article(i) for i in range(200)]
    df = spark.createDataFrame(wanted, ARTICLE).repartition(3)
    df.write.format("frames").option("stretch", "3000").mode("append").save(path)
    back = spark.read.format("frames").load(path)
    assert back.rdd.getNumPartitions() > 3 * 3
    assert sorted((r.asDict(recursive=True) for r in back.collect()), key=str) == sorted(wanted, key=str)
    # more is appended; overwriting leaves only what is new; a file without an index is one stretch
    df.limit(5).write.format("frames").mode("append").save(path)
    assert spark.read.format("frames").load(path).count() == 205
    df.limit(7).write.format("frames").mode("overwrite").save(path)
    assert spark.read.format("frames").load(path).count() == 7
    alone = tmp_path / "alone"
    alone.write_bytes(write_frames(wanted))
    one = spark.read.format("frames").load(str(alone))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 200
    df.where("false").write.format("frames").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("frames").load(str(tmp_path / "none")).count() == 0


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(frames.FrameSource)
    path = str(tmp_path / "failed")
    bad = spark.createDataFrame([article(1)], ARTICLE).withColumn("title", F.when(F.col("title") == "title 1", F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("frames").mode("append").save(path)
    assert not os.path.isdir(path) or not [n for n in os.listdir(path) if not n.startswith("_")]


def test_only_wanted_streams_of_a_dump_are_read(spark, tmp_path):
    path = str(tmp_path / "dump")
    pages = [(i, f"Page: {i}", f"text <{i}> & ż " * 40) for i in range(500)] + [(900, None, "x"), (901, "empty", "")]
    df = spark.createDataFrame(pages, "page_id long, title string, text string").repartition(2)
    written = multistream.write_dump(df, path, 20).collect()
    assert sum(r.pages for r in written) == 501
    wanted = spark.createDataFrame([("page_3",), ("PAGE_7&",), ("nothing",), ("empty",), (None,)], "title string")
    listed = multistream.index(spark, path)
    assert listed.count() == 501
    rows = multistream.read_wanted(spark, path, wanted).collect()
    normal = {X_normal(t): (i, t, x) for i, t, x in pages if t}
    assert sorted((r.page_id, r.title, r.text) for r in rows) == sorted(normal[n] for n in ("page3", "page7", "empty"))
    assert 0 < sum(r.bytes for r in rows) < 0.3 * sum(r.bytes for r in written)
    every = multistream.read_wanted(spark, path, df.select("title"))
    assert every.count() == 501 and every.agg(F.sum("bytes")).first()[0] == sum(r.bytes for r in written)


def X_normal(title):
    return title.lower().replace(":", "").replace(" ", "")


TEXTS = [("a", i, "x" * (i * 7 % 13 + 1)) for i in range(40)] + [("b", i, "y" * 5) for i in range(3)] + [("c", 0, None)]


def test_stream_batches_equal_those_of_the_table(spark, tmp_path):
    """The stream comes in parts, and the query is started anew for each: nothing is lost and nothing comes twice."""
    schema = "group_id string, ordinal long, text string, at timestamp"
    path, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))

    def add(rows):
        spark.createDataFrame(rows, "group_id string, ordinal long, text string, t string").withColumn("at", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        query = batched(stream, 20).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    add([(*t, "2024-01-01 00:00:00") for t in TEXTS if t[1] < 9])
    add([(*t, "2024-01-01 00:01:00") for t in TEXTS if 9 <= t[1] < 30])
    add([(*t, "2024-01-01 00:02:00") for t in TEXTS if t[1] >= 30])
    open_ = spark.read.parquet(out).select("group_id", F.explode("ordinals")).count()
    assert open_ < len(TEXTS)
    add([("end", 0, "z", "2024-01-02 00:00:00")])
    found = sorted((r.group_id, r.ordinal, r.batch) for r in spark.read.parquet(out).select("group_id", "batch", F.explode("ordinals").alias("ordinal")).collect())
    table = spark.createDataFrame(TEXTS, "group_id string, ordinal long, text string").select("group_id", "ordinal", F.char_length("text").alias("size"))
    want = sorted((r.group_id, r.ordinal, r.batch) for r in translate.request_batches(table, 20).collect())
    assert found == want


def test_observed_counts_come_with_the_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, t string")
    rows, seen = report.observed(df, "seen", missing=F.col("t").isNull(), large=F.col("id") > 1, none=F.col("t") == "z")
    assert rows.count() == 3 and seen.get == {"rows": 3, "missing": 1, "large": 2, "none": 0}
    lines = report.first_lines(df.withColumn("k", F.lit(1)).withColumn("q", F.lit("why")), "k", ["q"], "t", "id", 2).first()
    assert lines.lines.split("\n")[:2] == ["q: why", "1. a"]


def test_checked_answers_and_their_counters(spark):
    paragraphs = spark.createDataFrame([(1, 0, "the red cat sat on a mat"), (1, 1, "and it was so")], "page_id long, pos int, text string")
    rows = [(1, "red cat sat", "cat", "CAT"), (1, "red cat sat", "cat", "cats"), (1, "not there", "there", "there"), (1, "on a mat and it was so", "mat", "mat"), (1, "red cat sat", "dog", "dog"), (1, "red cat sat", "sat", None)]
    matches = spark.createDataFrame(rows, "page_id long, sentence string, answer string, original_answer string")
    found, seen = dataset.checked(matches, paragraphs, lambda w: F.transform(w, lambda x: F.regexp_replace(x, "s$", "")))
    kept = found.select("answer", "original_answer", "answer_start").collect()
    assert sorted((r.answer, r.original_answer, r.answer_start) for r in kept) == [("cat", "CAT", 8), ("cat", "cats", 8), ("mat", "mat", 21)]
    assert [s.get for s in seen] == [{"rows": 6, "different": 1}, {"rows": 4, "incorrect": 1}]


def test_locate_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    paragraphs = [(p, i, " ".join(rng.choices(["a", "bb", "ccc", "a.", "dd"], k=rng.randrange(0, 8)))) for p in range(12) for i in range(5)]
    matches = []
    for p, i, t in paragraphs:
        n = rng.randrange(0, len(t) + 1)
        matches.append((p, t[n : n + rng.randrange(0, 14)], t[n + 1 : n + 3], len(matches)))
        matches.append((p, " ".join(x for q, j, x in paragraphs if q == p and j in (i, i + 1))[2:-1], "a", len(matches)))
    matches += [(None, "a", "a", -1), (3, None, "a", -2), (99, "a", "a", -3)]
    m = spark.createDataFrame(matches, "page_id long, sentence string, answer string, k long")
    found = spans.locate(m, spark.createDataFrame(paragraphs, "page_id long, pos int, text string"))
    want = set()
    for page, s, answer, k in matches:
        own = [t for p, _, t in sorted(paragraphs) if p == page]
        options = own + [f"{a} {b}" for a, b in zip(own, own[1:])]
        hit = next((c for c in options if s is not None and s in c), None)
        if hit is not None:
            inside = s.find(answer)
            want.add((k, hit, hit.find(s) + inside if inside >= 0 else -1))
    assert {(r.k, r.context, r.answer_start) for r in found.collect()} == want and len(want) > 80


def test_numbers_are_gapless_at_scale(spark, tmp_path):
    n = 500_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("b"), F.repeat(F.lit("x"), 20).alias("payload"))
    path = str(tmp_path / "numbered")
    nest.numbered(rows, ["a", "b"], 5).write.parquet(path)
    out = spark.read.parquet(path)
    low, high, distinct = out.agg(F.min("new_id"), F.max("new_id"), F.count_distinct("new_id")).first()
    assert (low, high, distinct) == (5, n + 4, n)
    from pyspark.sql import Window

    w = Window.orderBy("new_id")
    assert out.select("a", "b", F.lag("a").over(w).alias("p"), F.lag("b").over(w).alias("q")).where("p > a or p = a and q > b").count() == 0
    assert nest.numbered(rows.where("false"), ["a"]).count() == 0
    hot = nest.numbered(spark.range(1000).select(F.lit(1).alias("a")), ["a"])
    assert sorted(r.new_id for r in hot.collect()) == list(range(1, 1001))


def test_titles_of_several_files_in_their_order(spark, tmp_path):
    folder = tmp_path / "titles"
    folder.mkdir()
    (folder / "a.txt").write_text("one ||| t\nfirst ||| u\n")
    (folder / "b.txt").write_text("".join(f"x{i} ||| y{i}\n" for i in range(30_000)) + "two ||| t\n")
    found = {r.en: r.pl for r in files.read_titles(spark, str(folder)).where("en in ('t', 'u')").collect()}
    assert found == {"t": "two", "u": "first"}


def test_articles_extended_and_combined(spark):
    articles = spark.createDataFrame([("A%2BB", [("c", 1)]), ("Z", [])], "title string, paragraphs array<struct<c:string,n:int>>")
    links = spark.createDataFrame([("A+B", 1, "T", 2), ("A+B", 3, "U", 4)], "title string, page_id int, other_title string, other_page_id int")
    rows = {r.title: r for r in link.extend_articles(articles, links).collect()}
    assert rows["A%2BB"][2:] == (1, "A+B", 2, "T") and rows["Z"].enwiki_page_id is None and rows["A%2BB"].paragraphs[0].c == "c"
    pages = spark.createDataFrame([(7, "a+b"), (8, "other"), (9, "OTHER")], "page_id long, title string")
    assert [(r.title, r.en_wiki_page_id) for r in link.combined(articles, pages).collect()] == [("A%2BB", 7)]
    with pytest.raises(Exception, match="repeated key"):
        link.combined(articles, pages.unionByName(spark.createDataFrame([(10, "A_+B")], "page_id long, title string"))).collect()


def test_repairs_and_entities(spark):
    rows = spark.createDataFrame([('x " Into the Groove " La Isla Bonita ”', "&lt;a&gt; &#322;"), (None, None)], "o string, e string")
    found = rows.select(X.repaired_original(F.col("o")).alias("o"), unescaped(F.col("e")).alias("e")).collect()
    assert found[0].o == 'x "Into the Groove" La Isla Bonita' and found[0].e == "<a> ł" and found[1].o is None and found[1].e is None
