"""Queries on streams of messages, compressed dumps, state over streams, extended documents and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import first_where
from ..functions.markup import unescaped
from ..operators import dataset, link, nest, report, translate
from ..shared import dropped, scratch, written
from ..sources import multistream
from ..sources.frames import FrameSource
from ..streaming import incremental
from ..streaming.batches import arrive, batched
from .tables import table


def _document(text: Column) -> Column:
    """An annotated document of one sentence: words that end with a vowel are names of a place."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    token = lambda t: F.struct(t.alias("word"), F.lit("X").alias("pos"), t.alias("originalText"), F.when(t.rlike("[aeiou]$"), "LOCATION").otherwise("O").alias("ner"), F.lower(t).alias("lemma"))
    return F.struct(text.alias("text"), F.array(F.struct(F.transform(words, token).alias("token"))).alias("sentence"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as annotated articles, written as streams of messages with places every few kilobytes, and read from there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    none = F.array().cast("array<int>")
    q = F.struct("turn", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), _document(F.col("text")).alias("question"), F.array(_document(F.col("role"))).alias("answers"), none.alias("answerOffsets")).alias("q"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(q)).alias("q"), F.min_by("text", "turn").alias("first"))
    paragraph = F.struct(_document(F.col("first")).alias("context"), F.transform("q", lambda x: x["q"]).alias("qas"))
    articles = rows.select(F.col("conv_id").cast("string").alias("title"), F.array(paragraph).alias("paragraphs"))
    spark.dataSource.register(FrameSource)
    path = scratch(spark, "frames")
    articles.write.format("frames").option("stretch", "4096").mode("append").save(path)
    return spark.read.format("frames").load(path)


def frames_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _annotated(spark, sf_dir).select("title", F.explode("paragraphs").alias("p")).select("title", F.explode("p.qas").alias("q"))
    return flat.select("title", "q.id", F.md5(F.encode("q.question.text", "UTF-8")).alias("question_md5"), F.size(F.col("q.question.sentence")[0]["token"]).alias("n"))


def annotated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the annotated articles with the tokens and labels of their contexts, kept as a table."""
    rows = written(translate.annotated_answers(_annotated(spark, sf_dir)), "annotated")
    return rows.select("qid", "answer", F.size("context_tokens").alias("n"), F.size(F.filter("context_entities", lambda e: e == "LOCATION")).alias("places"), F.element_at("context_tokens", -1).alias("last"))


def dump_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of compressed dumps of ten pages a stream; those whose id is divisible by 50 are read, by titles written otherwise, and not even half of the bytes."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    title = F.concat("source", F.lit(": x"), F.col("doc_id").cast("string"))
    pages = d.select(F.col("doc_id").alias("page_id"), title.alias("title"), F.regexp_replace("text", r"[\x00-\x1f￾￿]", " ").alias("text"))
    path = scratch(spark, "dumps")
    listed = written(multistream.write_dump(pages, path, 10), "dump-files")
    wanted = d.where("doc_id % 50 = 0").select(F.concat(F.replace(F.upper("source"), F.lit("."), F.lit("%2E")), F.lit("_X"), F.col("doc_id").cast("string"), F.lit("&")).alias("title"))
    rows = written(multistream.read_wanted(spark, path, wanted), "wanted-pages")
    share = rows.agg(F.sum("bytes").alias("read")).join(F.broadcast(listed.agg(F.sum("bytes").alias("all")))).select((2 * F.col("read") < F.col("all")).alias("less_than_half"))
    return rows.select("page_id", "title", F.md5(F.encode("text", "UTF-8")).alias("text_md5")).join(F.broadcast(share))


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stream in, some files at a time in the order of their ids, in batches of their source of at least 29,500 characters; a last row a day later lets the open batches go."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("group_id"), F.col("doc_id").alias("ordinal"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    last = spark.range(1).select(F.lit("").alias("group_id"), F.lit(-1).cast("long").alias("ordinal"), F.lit("").alias("text"), F.lit("2024-01-03 00:00:00").cast("timestamp").alias("at"))
    path, out, checkpoint = (scratch(spark, f"stream-{k}") for k in ("in", "out", "checkpoint"))
    files = arrive(d, path)
    last.write.mode("append").parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = batched(stream, 29_500).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("group_id string, batch int, ordinals array<bigint>, texts array<string>").parquet(out)
    return rows.where("group_id <> ''").select("group_id", "batch", F.explode("ordinals").alias("ordinal"))


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that stream in twice, the second time with others: each text is worked on once."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    path, out, checkpoint = (scratch(spark, f"resume-{k}") for k in ("in", "out", "checkpoint"))
    for part in (c.where("length(text) % 2 = 0"), c):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(c.schema).parquet(path)
        incremental.resume(stream, out, "id", lambda rows: rows.select("id", F.char_length("text").alias("n")), checkpoint).awaitTermination()
    return spark.read.schema("id string, n int").parquet(out)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested articles with quoted titles."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.concat(F.lit("C%2B%2B_"), F.col("conv_id").cast("string"), F.lit("+x")).alias("title"), F.col("role").alias("context"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lower("text").alias("answer"), F.lit(0).alias("answer_start"))
    return nest.nest(rows)


def extended_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with what is known of two pages of three, still nested."""
    articles = _articles(spark, sf_dir)
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 3 <> 0")
    links = ids.select(F.concat(F.lit("C++_"), F.col("conv_id").cast("string"), F.lit("+x")).alias("title"), F.col("conv_id").alias("page_id"), F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("other_title"), (F.col("conv_id") + 1).alias("other_page_id"))
    rows = link.extend_articles(articles, links)
    questions = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.size(p["qas"]))
    return rows.select("title", "enwiki_page_id", "enwiki_title", "plwiki_page_id", "plwiki_title", F.size("paragraphs").alias("paragraphs"), questions.alias("questions"))


def combined_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that are a page's, by normalised titles."""
    pages = table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 2 = 0").select(F.col("conv_id").alias("page_id"), F.concat(F.lit("c++ "), F.col("conv_id").cast("string"), F.lit("+(X)")).alias("title"))
    pages = pages.withColumn("title", F.replace("title", F.lit(" "), F.lit("_")))
    return link.combined(_articles(spark, sf_dir), pages).select("title", "en_wiki_page_id", F.size("paragraphs").alias("paragraphs"))


def unquoted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quoted signs, one of them broken, and entities of markup."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    title = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("%zz"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%C5%BC")))
    return p.select("p_partkey", X.unquoted(title).alias("title"), unescaped(F.concat(F.lit("&lt;"), "p_brand", F.lit(" &amp; &oacute;&#380;&gt;"))).alias("text"))


def translated_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions with the translations of their answers, a row each; short and missing questions go, and answers without a translation."""
    o = table(spark, sf_dir, "orders")
    some = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("o_orderpriority"), F.col("o_orderstatus")))
    answers = o.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("en_answer"), some.alias("translations"))
    questions = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("Kto to ?")).otherwise(F.lit("Kto?")).alias("question"))
    entities = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("en_answer"), F.lit("MISC").alias("ner"))
    return translate.translated_questions(answers, questions, entities)


def titles_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the listed titles only, and the first of their words that is written large."""
    d = table(spark, sf_dir, "documents")
    wanted = d.where("doc_id % 7 = 0").select(F.col("source").alias("title")).distinct().where("title rlike '[02468]$'")
    rows = d.join(wanted, d["source"] == wanted["title"], "left_semi")
    return rows.select("doc_id", first_where(F.split("text", " "), lambda t: t.rlike(r"^\p{Lu}")).alias("first"))


def worked_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations that aren't translated yet, each once, through a service in batches."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("ordinal"), "text")
    done = c.where("ordinal = 0").select("text")
    found = dataset.work_off(c, done, lambda rows: rows.select("text", F.concat(F.lit("pl: "), "text").alias("translation")), 500)
    return found.select(F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.md5(F.encode("translation", "UTF-8")).alias("translation_md5")).distinct()


def original_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("soli miedzi (II) "), "p_name", F.lit(' " Into the Groove "')).alias("o"))
    return p.select("p_partkey", X.repaired_original(F.col("o")).alias("original"))


def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is skipped on the way to located answers, counted as the rows pass: lines as sentences, their third words as answers, every fifth of them with another original and every seventh with a sentence that its page hasn't."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    third = F.split_part("text", F.lit(" "), F.lit(3))
    rows = p.where("text like '% % %'").withColumn("answer", third).where(F.col("answer").rlike("^[a-z]{5,}$"))
    original = F.when(F.col("page_id") % 5 == 0, F.concat("answer", F.lit(" x"))).otherwise(F.upper("answer"))
    sentence = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("\x01"), "text")).otherwise(F.col("text"))
    matches = rows.select("page_id", sentence.alias("sentence"), "answer", original.alias("original_answer"))
    found, seen = dataset.checked(matches, p, lambda words: words)
    kept = written(found.select("page_id", "answer_start"), "checked")
    first, second = (s.get for s in seen)
    n = kept.count()
    dropped(kept)
    return spark.createDataFrame([(first["rows"], first["different"], second["rows"], second["incorrect"], n)], "answers long, different long, spans long, incorrect long, kept long")


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents of each source and language, as lines for reading."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    return report.first_lines(d, "source", ["lang"], "line", "doc_id")


_T = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"

QUERIES = {
    f.__name__: f
    for f in (frames_roundtrip, annotated_tokens, dump_streams, stream_batches, resumed_run, extended_articles, combined_articles, unquoted_titles, translated_data, titles_kept, worked_off, original_repairs, skip_counters, first_sentences)
}
ORACLE = {
    "frames_roundtrip": f"SELECT CAST(conv_id AS VARCHAR) AS title, conv_id || '-' || turn AS id, md5(text) AS question_md5, CAST(len({_T.format('text')}) AS INT) AS n FROM conversations",
    "annotated_tokens": f"""
WITH c AS (SELECT conv_id, {_T.format('arg_min(text, turn)')} AS w FROM conversations GROUP BY conv_id)
SELECT conv_id || '-' || turn AS qid, role AS answer, CAST(len(w) AS INT) AS n, CAST(len(list_filter(w, lambda x: regexp_matches(x, '[aeiou]$'))) AS INT) AS places, w[-1] AS last FROM conversations JOIN c USING (conv_id)""",
    "dump_streams": r"SELECT doc_id AS page_id, source || ': x' || doc_id AS title, md5(regexp_replace(text, '[\x00-\x1f]', ' ', 'g')) AS text_md5, true AS less_than_half FROM documents WHERE doc_id % 50 = 0",
    "stream_batches": """
WITH RECURSIVE d AS (SELECT source AS g, doc_id, length(text) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT g, doc_id, n, CASE WHEN n_chars >= 29500 THEN 0 ELSE n_chars END AS s, 0 AS batch, CASE WHEN n_chars >= 29500 THEN 1 ELSE 0 END AS nxt FROM d WHERE n = 1
  UNION ALL SELECT d.g, d.doc_id, d.n, CASE WHEN r.s + d.n_chars >= 29500 THEN 0 ELSE r.s + d.n_chars END, r.nxt, CASE WHEN r.s + d.n_chars >= 29500 THEN r.nxt + 1 ELSE r.nxt END FROM r JOIN d ON d.g = r.g AND d.n = r.n + 1)
SELECT g AS group_id, CAST(batch AS INT) AS batch, doc_id AS ordinal FROM r""",
    "resumed_run": "SELECT conv_id || '-' || turn AS id, CAST(length(text) AS INT) AS n FROM conversations",
    "extended_articles": """
WITH a AS (SELECT conv_id, count(DISTINCT role) AS p, count(DISTINCT role || text) AS q FROM conversations GROUP BY conv_id)
SELECT 'C%2B%2B_' || conv_id || '+x' AS title, CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS enwiki_page_id, 'C++_' || conv_id || '+x' AS enwiki_title, CASE WHEN conv_id % 3 <> 0 THEN conv_id + 1 END AS plwiki_page_id,
  CASE WHEN conv_id % 3 <> 0 THEN 'T' || conv_id END AS plwiki_title, CAST(p AS INT) AS paragraphs, CAST(q AS INT) AS questions FROM a""",
    "combined_articles": "SELECT 'C%2B%2B_' || conv_id || '+x' AS title, conv_id AS en_wiki_page_id, CAST(count(DISTINCT role) AS INT) AS paragraphs FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id",
    "unquoted_titles": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '%zz' ELSE p_name || '+ż' END AS title, '<' || p_brand || ' & óż>' AS text FROM part",
    "translated_data": """
SELECT o_orderkey AS qid, 'Kto to ?' AS question, unnest([lower(o_orderpriority), o_orderstatus]) AS answer, o_orderpriority AS en_answer, CASE WHEN o_orderkey % 5 <> 0 THEN 'MISC' END AS ner
FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0""",
    "titles_kept": r"""
SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^\p{Lu}'))[1] AS first FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND regexp_matches(source, '[02468]$'))""",
    "worked_off": "SELECT DISTINCT md5(text) AS text_md5, md5('pl: ' || text) AS translation_md5 FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE turn = 0)",
    "original_repairs": "SELECT p_partkey, 'soli miedzi(II)) ' || p_name || ' \"Into the Groove\"' AS original FROM part",
    "first_sentences": """
WITH r AS (SELECT source, lang, split_part(text, chr(10), 1) AS t, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, split_part(text, chr(10), 1)) AS k FROM documents)
SELECT source, 'lang: ' || lang || chr(10) || string_agg(k || '. ' || t, chr(10) ORDER BY k) AS lines FROM r WHERE k <= 5 GROUP BY source, lang""",
    "skip_counters": r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), m AS (SELECT doc_id FROM p WHERE t LIKE '% % %' AND regexp_full_match(split_part(t, ' ', 3), '[a-z]{5,}')),
n AS (SELECT count(*) AS a, count(*) FILTER (doc_id % 5 = 0) AS d, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS k FROM m)
SELECT a AS answers, d AS different, k AS spans, CAST(0 AS BIGINT) AS incorrect, k AS kept FROM n""",
}
