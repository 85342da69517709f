"""Queries on vectors, containment and best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import last_sublist_position, sublist_position
from ..operators import match, retrieve, spans
from .tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("page"))
    return e, e.where("id % 50 = 0")


def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    return retrieve.nearest(corpus, queries, 20, 5)


def topk_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    pages = corpus.select("id", "page").join(queries.select(F.col("id").alias("query_id"), F.col("page").alias("q_page")), F.col("page") == F.col("q_page")).select("query_id", "id")
    return retrieve.on_pages(retrieve.nearest(corpus, queries, 20, 5), pages)


def self_retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    ranks = retrieve.self_ranks(corpus, 3, queries)
    return ranks.select("rank", "n", F.round("ratio", 6).alias("ratio"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")


def _words(c):
    return F.filter(F.split(F.lower(c), r"[ \n]+"), lambda t: t != "")


def sublist_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", _words(F.col("text")).alias("w")).where(F.size("w") > 12)
    middle = F.floor(F.size("w") / 2).cast("int")
    rows = rows.select("doc_id", "w", F.slice("w", middle, F.lit(3)).alias("needle"))
    return rows.select("doc_id", sublist_position(F.col("needle"), F.col("w")).alias("first"), last_sublist_position(F.slice("w", 3, 1), F.col("w")).alias("last"), sublist_position(F.reverse("needle"), F.col("w")).alias("reverse"))


def substring_then_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the lines of a source as answers, sought in the other documents of the language."""
    d = _docs(spark, sf_dir)
    answers = d.where("doc_id % 50 = 0").select("lang", F.substring_index("text", " ", 2).alias("answer")).where("answer rlike '^[A-Za-z]+ [a-z]+$'").distinct()
    answers = answers.select("lang", "answer", _words(F.col("answer")).alias("answer_tokens"))
    found = match.containing(d.select("doc_id", "lang", "text", _words(F.col("text")).alias("tokens")), answers, "lang", ["doc_id"])
    return found.select("doc_id", "answer")


def best_match_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.best_per_key(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_partkey", "l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


def merge_best_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", (F.col("n_chars") % 50).alias("score"))
    return match.merge_best(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["source", "lang"], "score", ["doc_id"])


def candidate_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select((F.col("doc_id") / 7).cast("long").alias("group_id"), F.col("doc_id").alias("place"), "text", F.when(F.col("doc_id") % 3 == 0, "Kanada").otherwise(F.col("source")).alias("title"), ((F.col("n_chars") % 100) / 100).alias("similarity"), (F.col("doc_id") % 40).cast("int").alias("page_rank"))
    return match.good_candidates(d).select("group_id", "place", "title", "similarity")


def compare_match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    # the older set has the labelled documents only, every fourth in lower case
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    new = d.select("doc_id", "source", "text")
    old = d.join(labelled, "doc_id").select("doc_id", "source", F.when(F.col("doc_id") % 4 == 0, F.lower("text")).otherwise(F.substr("text", F.col("n_chars").cast("int") / 2 + 1)).alias("text"))
    return match.compare(new, old, ["doc_id", "source"])


def span_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    p = d.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    m = p.where("text like '% % %'").select("page_id", F.col("text").alias("sentence"), F.split_part("text", F.lit(" "), F.lit(3)).alias("answer")).where("answer <> ''")
    found = spans.locate(m, p)
    exact = spans.is_exact(F.col("context"), F.col("answer_start"), F.col("answer"))
    return found.select("page_id", "answer", F.md5(F.encode("sentence", "UTF-8")).alias("sentence_md5"), F.col("answer_start").cast("long").alias("answer_start"), exact.alias("exact"))


def nth_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("t"))
    return rows.select("doc_id", *(spans.nth_position(F.col("t"), F.lit("en"), F.lit(n)).cast("long").alias(f"at_{n}") for n in (0, 2)))


def lemma_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words against those of the next one of its source; only ids are sorted by source, words meet by id."""
    d = _docs(spark, sf_dir)
    after = d.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next_id")).where("next_id is not null")
    words = d.select("doc_id", _words(F.col("text")).alias("a"))
    rows = words.join(after, "doc_id").join(words.select(F.col("doc_id").alias("next_id"), F.col("a").alias("b")), "next_id")
    return rows.select("doc_id", match.lemma_guard(F.col("a"), F.col("b")).alias("agree"))


_COS = "round(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))) / sqrt(list_dot_product(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)))), {0})"
_TOP = f"""
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, {_COS.format(5)} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) - 1 AS place FROM pairs)"""
_W = r"list_filter(string_split_regex(lower({0}), '[ \n]+'), lambda x: x <> '')"
_POS = "coalesce({2}(list_filter(range(0, CAST(greatest(len({1}) - len({0}), 0) + 1 AS BIGINT)), lambda i: list_slice({1}, i + 1, i + len({0})) = {0})), -1)"

QUERIES = {f.__name__: f for f in (topk_similar, topk_then_filter, self_retrieval_ranks, sublist_containment, substring_then_tokens, best_match_per_key, merge_best_of_two, candidate_quality_filter, compare_match_sets, span_locate, nth_answer, lemma_guard)}
ORACLE = {
    "topk_similar": f"WITH {_TOP} SELECT query_id, CAST(place AS INT) AS place, id, similarity FROM best WHERE place < 20",
    "topk_then_filter": f"WITH {_TOP} SELECT query_id, CAST(place AS INT) AS place, id, similarity FROM best WHERE place < 20 AND ql = cl",
    "self_retrieval_ranks": f"""
WITH pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS.format(6)} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) - 1 AS place FROM pairs),
r AS (SELECT q.vec_id, coalesce(max(CASE WHEN b.place < 3 THEN b.place END), -1) AS rank FROM embeddings q LEFT JOIN best b ON b.query_id = q.vec_id AND b.id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)
SELECT CAST(rank AS INT) AS rank, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS ratio FROM r GROUP BY rank""",
    "sublist_containment": f"""
WITH w AS (SELECT doc_id, {_W.format('text')} AS w FROM documents), n AS (SELECT doc_id, w AS h, list_slice(w, len(w) // 2, len(w) // 2 + 2) AS n, list_slice(w, 3, 3) AS l FROM w WHERE len(w) > 12)
SELECT doc_id, CAST({_POS.format('n', 'h', 'list_min')} AS INT) AS first, CAST({_POS.format('l', 'h', 'list_max')} AS INT) AS last, CAST({_POS.format('list_reverse(n)', 'h', 'list_min')} AS INT) AS reverse FROM n""",
    "substring_then_tokens": f"""
WITH a AS (SELECT DISTINCT lang, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS answer FROM documents WHERE doc_id % 50 = 0),
b AS (SELECT lang, answer, {_W.format('answer')} AS n FROM a WHERE regexp_matches(answer, '^[A-Za-z]+ [a-z]+$')), d AS (SELECT doc_id, lang, text, {_W.format('text')} AS h FROM documents)
SELECT doc_id, answer FROM d JOIN b USING (lang) WHERE contains(lower(text), lower(answer)) AND {_POS.format('n', 'h', 'list_min')} >= 0""",
    "best_match_per_key": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "merge_best_of_two": "SELECT doc_id, source, lang, score, input_no FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, input_no, doc_id) AS n FROM (SELECT doc_id, source, lang, n_chars % 50 AS score, CAST(doc_id % 2 AS INT) AS input_no FROM documents)) WHERE n = 1",
    "candidate_quality_filter": """
WITH d AS (SELECT doc_id // 7 AS group_id, doc_id AS place, text, CASE WHEN doc_id % 3 = 0 THEN 'Kanada' ELSE source END AS title, (n_chars % 100) / 100 AS similarity, doc_id % 40 AS page_rank FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, max(similarity) OVER (PARTITION BY group_id) AS best FROM d
  WHERE NOT ends_with(rtrim(text, ' '), ':') AND NOT regexp_matches(text, '^[*#]') AND NOT contains(lower(text), 'jpg') AND text <> '' AND page_rank < 30 AND NOT (title = 'Kanada' AND similarity < 0.8))
SELECT group_id, place, title, similarity FROM k WHERE n <= 10 AND best >= 0.6""",
    "compare_match_sets": """
WITH n AS (SELECT doc_id, source, text AS t FROM documents), o AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN lower(text) ELSE substr(text, n_chars // 2 + 1) END AS u FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT CASE WHEN u IS NULL THEN 'new' WHEN contains(t, u) THEN 'common' ELSE 'different' END AS kind, count(*) AS n FROM n LEFT JOIN o USING (doc_id, source) GROUP BY 1""",
    "span_locate": """
WITH p AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
a AS (SELECT page_id, pos, text AS sentence, split_part(text, ' ', 3) AS answer FROM p WHERE text LIKE '% % %' AND split_part(text, ' ', 3) <> ''),
c AS (SELECT a.page_id, a.pos, a.sentence, a.answer, arg_min(p.text, p.pos) AS context FROM a JOIN p ON a.page_id = p.page_id AND contains(p.text, a.sentence) GROUP BY ALL)
SELECT page_id, answer, md5(sentence) AS sentence_md5, instr(context, sentence) - 1 + instr(sentence, answer) - 1 AS answer_start, substr(context, instr(context, sentence) - 1 + instr(sentence, answer), length(answer)) = answer AS exact FROM c""",
    "nth_answer": """
WITH p AS (SELECT doc_id, string_split(text, 'en') AS p FROM documents)
SELECT doc_id, CAST(CASE WHEN len(p) > 1 THEN length(p[1]) ELSE -1 END AS BIGINT) AS at_0, CAST(CASE WHEN len(p) > 3 THEN length(p[1]) + length(p[2]) + length(p[3]) + 4 ELSE -1 END AS BIGINT) AS at_2 FROM p""",
    "lemma_guard": f"""
WITH w AS (SELECT doc_id, source, {_W.format('text')} AS a FROM documents), l AS (SELECT *, lead(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w)
SELECT doc_id, len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: length(a[i]) <= 4 AND substr(a[i], 1, 3) <> substr(b[i], 1, 3) AND substr(a[i], 1, 2) <> substr(b[i], 1, 2))) = 0 AS agree FROM l WHERE b IS NOT NULL""",
}
