"""Queries on sentences, paragraphs and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sentences as S
from .tables import table

_STOP = ("the", "and", "de", "la")


def _lines(text):
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _words(text):
    return F.filter(F.split(F.lower(text), " "), lambda t: t != "")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), "text")
    return S.sentence_table(d, _lines, _words)


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("page_id", "sent_no", "title", F.size("tokens").alias("n_tokens"), F.md5(F.encode("raw_text", "UTF-8")).alias("md5"))


def sentence_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.sentence_pairs(_sentences(spark, sf_dir))
    return pairs.select("page_id", F.array_join(F.transform("sentence_nums", lambda n: n.cast("string")), ";").alias("nums"), F.size("tokens").alias("n_tokens"), F.md5(F.encode("raw_text", "UTF-8")).alias("md5"))


def sentence_modes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.both_modes(_sentences(spark, sf_dir))
    return rows.select(T.tag(F.col("page_id"), F.col("sentence_nums"), F.col("title")).alias("tag"), F.size("tokens").alias("n_tokens"))


def tag_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.both_modes(_sentences(spark, sf_dir)).select(T.tag_parts(T.tag(F.col("page_id"), F.col("sentence_nums"), F.col("title"))).alias("t"))
    return rows.select("t.page_id", F.element_at("t.sentence_nums", -1).alias("last_no"), T.plain_title(F.col("t.title")).alias("title"))


def article_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.whole_articles(_sentences(spark, sf_dir)).select("page_id", "title", F.size("tokens").alias("n_tokens"), F.md5(F.encode("raw_text", "UTF-8")).alias("md5"))


def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counters(_sentences(spark, sf_dir))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).select("page_id", "sent_no", T.without_stop_words(F.col("tokens"), _STOP).alias("w"))
    return rows.select("page_id", "sent_no", F.size("w").alias("n"), F.array_join("w", " ").alias("words"))


def paragraph_list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    merged = S.merged_list_paragraphs(d, F.lower("text").rlike("^[aeiou]"), F.char_length("text") % 3 == 2)
    return merged.select("doc_id", F.col("island").cast("long").alias("island"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


def remove_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wiki = F.regexp_replace(F.regexp_replace("html", "</?h1[^>]*>", "=="), "</?(h[2-6]|p)[^>]*>", "===")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(T.without_headers(wiki), "UTF-8")).alias("md5"))


def formatnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("in {{formatnum:"), F.col("l_orderkey").cast("string"), F.lit("}} and  {{formatnum:"), F.col("l_quantity").cast("int").cast("string"), F.lit("}}"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.single_blanks(T.formatted_numbers(text)).alias("text"))


def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("( "), F.col("text"), F.lit(" )"))
    edge = T.stripped_edges(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.cleaned_answer(text).alias("cleaned"), edge["text"].alias("stripped"), edge["removed"].alias("removed"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.affirmative(F.col("text"), F.col("role")).alias("sentence"), T.is_valid_question(F.col("text")).alias("valid"))


def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_(%C5%82)&'"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalized_title(name).alias("title"), T.normalized_title(F.col("p_name"), True).alias("wiki_title"))


_SENT = """
sent AS (SELECT doc_id AS page_id, source AS title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS sent_no, raw, list_filter(string_split(lower(raw), ' '), lambda x: x <> '') AS tokens
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE raw <> '' AND NOT starts_with(raw, 'Kategoria:') AND NOT contains(raw, '.jpg')),
nxt AS (SELECT *, lead(sent_no) OVER w AS no2, lead(raw) OVER w AS raw2, lead(tokens) OVER w AS tokens2, count(*) OVER (PARTITION BY page_id) AS n FROM sent WINDOW w AS (PARTITION BY page_id ORDER BY sent_no)),
pairs AS (SELECT page_id, title, CASE WHEN no2 IS NULL THEN CAST(sent_no AS VARCHAR) ELSE sent_no || ';' || no2 END AS nums, coalesce(no2, sent_no) AS last_no, len(tokens) + coalesce(len(tokens2), 0) AS n_tokens, CASE WHEN no2 IS NULL THEN raw ELSE raw || ' ' || raw2 END AS raw FROM nxt WHERE no2 IS NOT NULL OR n = 1)
"""

QUERIES = {f.__name__: f for f in (sentence_split, sentence_bigrams, sentence_modes_union, tag_codec, article_concat, corpus_counters, stop_words, paragraph_list_merge, remove_headers, formatnum, answer_cleanup, questions, title_normalize)}
ORACLE = {
    "sentence_split": f"WITH {_SENT} SELECT page_id, sent_no, title, CAST(len(tokens) AS INT) AS n_tokens, md5(raw) AS md5 FROM sent",
    "sentence_bigrams": f"WITH {_SENT} SELECT page_id, nums, CAST(n_tokens AS INT) AS n_tokens, md5(raw) AS md5 FROM pairs",
    "sentence_modes_union": f"""WITH {_SENT} SELECT page_id || '_' || sent_no || '_' || title || ' (sentence_1)' AS tag, CAST(len(tokens) AS INT) AS n_tokens FROM sent
UNION ALL SELECT page_id || '_' || nums || '_' || title || ' (sentence_2)', CAST(n_tokens AS INT) FROM pairs""",
    "tag_codec": f"WITH {_SENT} SELECT page_id, sent_no AS last_no, title FROM sent UNION ALL SELECT page_id, last_no, title FROM pairs",
    "article_concat": f"WITH {_SENT} SELECT page_id, title, CAST(sum(len(tokens)) AS INT) AS n_tokens, md5(string_agg(raw, ' ' ORDER BY sent_no)) AS md5 FROM sent GROUP BY page_id, title",
    "corpus_counters": f"WITH {_SENT} SELECT count(DISTINCT page_id) AS articles, count(*) AS sentences, CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) AS positions FROM sent",
    "stop_words": f"WITH {_SENT}, w AS (SELECT page_id, sent_no, list_filter(tokens, lambda x: x NOT IN ('the', 'and', 'de', 'la')) AS w FROM sent) SELECT page_id, sent_no, CAST(len(w) AS INT) AS n, array_to_string(w, ' ') AS words FROM w",
    "paragraph_list_merge": """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
f AS (SELECT *, regexp_matches(lower(text), '^[aeiou]') AS item, length(text) % 3 = 2 AS colon FROM p),
g AS (SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f),
a AS (SELECT *, item AND coalesce(max(CAST(colon AS INT)) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inn FROM g),
i AS (SELECT *, sum(CASE WHEN inn THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM a)
SELECT doc_id, CAST(island AS BIGINT) AS island, md5(string_agg(text, ' ' ORDER BY pos)) AS md5 FROM i GROUP BY doc_id, island""",
    "remove_headers": r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '={6}.+?={6}', '', 'g'), '={5}.+?={5}', '', 'g'), '={4}.+?={4}', '', 'g'), '={3}.+?={3}', '', 'g'), '={2}.+?={2}', '', 'g')) AS md5
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '</?h1[^>]*>', '==', 'g'), '</?(h[2-6]|p)[^>]*>', '===', 'g') AS w FROM pages)""",
    "formatnum": "SELECT l_orderkey, l_linenumber, 'in ' || l_orderkey || ' and ' || CAST(l_quantity AS INT) AS text FROM lineitem",
    "answer_cleanup": r"""
SELECT item_id, regexp_replace(regexp_replace('( ' || text || ' )', '^[()*]\s*', ''), '\s*[()]$', '') AS cleaned,
  regexp_replace(regexp_replace(text, '^[ .,!:;?`''$"]+', ''), '[ .,!:;?`''$"]+$', '') AS stripped, CAST(length(text) - length(regexp_replace(text, '^[ .,!:;?`''$"]+', '')) AS INT) AS removed FROM benchmark""",
    "questions": "SELECT conv_id, turn, lower(role) || ' ' || lower(regexp_replace(text, '[?.]$', '')) AS sentence, length(text) > 5 AND length(text) - length(replace(text, ' ', '')) > 1 AS valid FROM conversations WHERE role = 'user'",
    "title_normalize": "SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '_') || '_(ł)&'''), '[_,():&'']', '', 'g') AS title, regexp_replace(lower(p_name), '[ _,():&'']', '', 'g') AS wiki_title FROM part",
}
