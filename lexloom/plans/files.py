"""Queries on the readers and writers: files are written from the tables and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import link, nest, retrieve, sentences
from ..sources import files
from .tables import scratch, table, written_lines


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _insert(name: str, *values: Column) -> Column:
    return F.concat(F.lit(f"INSERT INTO `{name}` VALUES ("), F.concat_ws(",", *(v.cast("string") for v in values)), F.lit("),(-1"), F.lit(",0" * (len(values) - 1)), F.lit(");"))


def wiki_page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("'s "), F.col("p_partkey").cast("string"))
    values = (F.col("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, 14).otherwise(0), _quoted(name), F.lit("''"), F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0), *(F.lit(0),) * 8)
    path = written_lines(p.select(_insert("page", *values).alias("value")), "page-dump")
    return files.read_page_dump(spark, path).where("page_id >= 0")


def wiki_langlinks_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lang = F.when(F.col("c_custkey") % 3 == 0, "pl").otherwise("de")
    lines = c.select(_insert("langlinks", F.col("c_custkey"), F.concat(F.lit("'"), lang, F.lit("'")), _quoted(F.concat("c_name", F.lit(" (a, b) O'Hara")))).alias("value"))
    return files.read_langlinks_dump(spark, written_lines(lines, "langlinks-dump"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by title from their dump, resolved against pages: lines as links from their part to their supplier's name."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    target = _quoted(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    lines = li.select(_insert("pagelinks", F.col("l_partkey"), F.when(F.col("l_linenumber") == 7, 4).otherwise(0), target, F.lit(0)).alias("value"))
    links = files.read_pagelinks_dump(spark, written_lines(lines, "pagelinks-dump"))
    return link.resolve_links(links, s.select(F.col("s_suppkey").cast("int").alias("page_id"), F.col("s_name").alias("title")))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition between the tags of a dump's root."""
    line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
    yield line("<mediawiki>")
    yield from batches
    yield line("</mediawiki>")


def _wiki(spark: SparkSession, sf_dir: str) -> str:
    """Documents as pages of an XML dump, in two name spaces, some of them redirects, one line each."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("#REDIRECT [["), F.col("source"), F.lit("]]"))).otherwise(escaped)
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\x00-\x20]")).select("doc_id", "source", F.regexp_replace(text, r"[\x00-\x1f]", " ").alias("t"))
    number = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<page><title>"), "source", F.lit(" "), number, F.lit("</title><ns>"), F.when(F.col("doc_id") % 4 == 1, "6").otherwise("0"), F.lit("</ns><id>"), number,
        F.lit('</id><revision><text xml:space="preserve">'), "t", F.lit("</text></revision></page>"),
    )
    return written_lines(d.select(page.alias("value")).mapInArrow(_rooted, "value string"), "wiki")


def wiki_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_wiki(spark, _wiki(spark, sf_dir))
    return rows.select("page_id", "title", F.md5(F.encode(F.trim("text"), "UTF-8")).alias("text_md5"))


def wiki_xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects too, of both name spaces, of the labelled pages only."""
    pages = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")).distinct()
    return files.read_wiki(spark, _wiki(spark, sf_dir), ("0", "6"), pages, True).select("page_id", "title", F.col("text").startswith("#REDIRECT").alias("redirect"))


def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with markup around them, written as XML dumps, and read as plain articles."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\w"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\[\]{}<>|&'=#]", ""), r"[\x00-\x20]+", " "))
    text = F.concat(F.lit("[[File:a.png|thumb|see [[b|c]] here]]'''"), plain, F.lit("''' {{x|{{y}}}}[[page|label]] <ref>z</ref>{{formatnum:12}} &amp;\n== Przypisy ==\nrest"))
    path = scratch(spark, "pages")
    files.write_pages(d.select(F.col("doc_id").alias("page_id"), F.concat("source", F.lit(" & "), F.col("doc_id").cast("string")).alias("title"), text.alias("text")), path)
    rows = files.read_articles(spark, path)
    return rows.select("page_id", "title", F.md5(F.encode(F.regexp_replace("text", r"\s+$", ""), "UTF-8")).alias("text_md5"))


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines "pl ||| en" in files of unlike sizes, in the order of the parts: the last of a repeated title counts."""
    line = F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(" ||| "), F.col("p_name")))
    p = table(spark, sf_dir, "part").repartitionByRange(7, F.sqrt("p_partkey")).sortWithinPartitions("p_partkey").select(line.alias("value"))
    return files.read_titles(spark, written_lines(p, "titles"))


def dump_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat_ws(":", (F.col("c_custkey") * 100).cast("string"), F.col("c_custkey").cast("string"), "c_mktsegment", "c_name").alias("value"))
    return files.read_index(spark, written_lines(c, "index"))


def pairs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderpriority"), F.lit(' "x" y')).alias("title"))
    path = scratch(spark, "pairs")
    files.write_pairs(rows, path)
    return files.read_pairs(spark, path, "o_orderkey long, title string")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a CSV file with a header, and their translations where there is one."""
    n = table(spark, sf_dir, "nation")
    path = scratch(spark, "cities")
    n.select(F.col("n_name").alias("city"), F.lit("x, y").alias("country"), F.lit("z").alias("subcountry"), F.col("n_nationkey").alias("geonameid")).write.option("header", True).csv(path)
    return files.read_cities(spark, path, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("en"), F.concat(F.lit("Miasto "), "n_name").alias("pl")))


def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations nested, written as one JSON document, read and flattened."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("conv_id").cast("string").alias("title"), F.col("role").alias("context"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lower("text").alias("answer"), F.lit(0).alias("answer_start"))
    path = scratch(spark, "corpus")
    files.write_corpus(nest.nest(rows), path)
    flat = nest.flatten(files.read_corpus(spark, path))
    return flat.select("title", "context", F.md5(F.encode("question", "UTF-8")).alias("question_md5"), F.md5(F.encode("answer", "UTF-8")).alias("answer_md5"))


def predictions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a file, each with the predictions of a thousand conversations."""
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 1000).alias("part"), F.struct(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("value")).alias("e"))
    path = scratch(spark, "predictions")
    c.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).repartition("part").write.partitionBy("part").text(path)
    rows = files.read_predictions(spark, f"{path}/part=*")
    return rows.select("id", F.md5(F.encode("prediction", "UTF-8")).alias("md5"))


def namespaces_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("title"))
    return sentences.skip_namespaces(p, ("small", "large"))


def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: themselves at depth 0, the suppliers of their lines by number of lines at depth 1."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").alias("sim_page_id")).count()
    similar = n.select("page_id", "sim_page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("count"), "sim_page_id")) - 1).alias("rank"))
    both = [link.related_pages(pages, similar, k).withColumn("depth", F.lit(k)) for k in (0, 1)]
    return both[0].unionByName(both[1])


def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return link.one_to_one(c, o, "c_custkey")


def recall_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 20 nearest vectors are of the query's page."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("page"))
    found = retrieve.nearest(e.select("id", "vector"), e.where("id % 50 = 0"), 20, 5)
    rows = found.join(e.select("id", "page"), "id").join(e.select(F.col("id").alias("query_id"), F.col("page").alias("own")), "query_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("page") == F.col("own")).alias("n"))


_DOUBLES = "list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE))"
_COS = "round(list_dot_product({q}, {c}) / sqrt(list_dot_product({q}, {q})) / sqrt(list_dot_product({c}, {c})), 5)".format(q=_DOUBLES.format("q"), c=_DOUBLES.format("c"))
_WIKI = r"w AS (SELECT doc_id, source || ' ' || doc_id AS title, regexp_replace(text, '[\x00-\x1f]', ' ', 'g') AS t FROM documents WHERE regexp_matches(text, '[^\x00-\x20]'))"

QUERIES = {f.__name__: f for f in (wiki_page_dump, wiki_langlinks_dump, resolved_links, wiki_xml, wiki_xml_pages, wiki_articles, title_pairs, dump_index, pairs_roundtrip, cities, corpus_roundtrip, predictions_json, namespaces_skipped, related_pages, one_to_one, recall_of_pages)}
ORACLE = {
    "wiki_page_dump": "SELECT CAST(p_partkey AS INT) AS page_id, p_name || '''s ' || p_partkey AS title FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    "wiki_langlinks_dump": "SELECT CAST(c_custkey AS INT) AS page_id, c_name || ' (a, b) O''Hara' AS title FROM customer WHERE c_custkey % 3 = 0",
    "resolved_links": "SELECT DISTINCT CAST(l_partkey AS INT) AS src, CAST(l_suppkey AS INT) AS dst FROM lineitem WHERE l_linenumber <> 7 AND l_partkey <> l_suppkey AND l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier)",
    "wiki_xml": f"WITH {_WIKI} SELECT doc_id AS page_id, title, md5(trim(t, ' ')) AS text_md5 FROM w WHERE doc_id % 11 <> 0 AND doc_id % 4 <> 1",
    "wiki_xml_pages": f"WITH {_WIKI} SELECT doc_id AS page_id, title, doc_id % 11 = 0 AS redirect FROM w WHERE doc_id IN (SELECT doc_id FROM labels)",
    "wiki_articles": r"""
WITH t AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(text, '[\[\]{}<>|&''=#]', '', 'g'), '[\x00-\x20]+', ' ', 'g'), ' ') AS t FROM documents WHERE regexp_matches(text, '[0-9A-Za-z_]'))
SELECT doc_id AS page_id, source || ' & ' || doc_id AS title, md5(t || ' label 12 &') AS text_md5 FROM t""",
    "title_pairs": "SELECT p_name AS en, CAST(max(p_partkey) AS VARCHAR) AS pl FROM part WHERE p_partkey % 6 <> 0 GROUP BY p_name",
    "dump_index": "SELECT c_custkey * 100 AS \"offset\", c_custkey AS page_id, c_mktsegment || ':' || c_name AS title FROM customer",
    "pairs_roundtrip": "SELECT o_orderkey, o_orderpriority || ' \"x\" y' AS title FROM orders",
    "cities": "SELECT n_name AS city FROM nation UNION SELECT 'Miasto ' || n_name FROM nation WHERE n_nationkey % 2 = 0",
    "corpus_roundtrip": "SELECT CAST(conv_id AS VARCHAR) AS title, role AS context, md5(text) AS question_md5, md5(lower(text)) AS answer_md5 FROM conversations",
    "predictions_json": "SELECT conv_id || '-' || turn AS id, md5(text) AS md5 FROM conversations",
    "namespaces_skipped": "SELECT p_partkey, split_part(p_name, ' ', 1) || ':' || p_brand AS title FROM part WHERE split_part(p_name, ' ', 1) NOT IN ('small', 'large')",
    "related_pages": """
WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT l_partkey AS page_id, l_suppkey AS other_page_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) - 1 AS INT) AS rank, CAST(1 AS INT) AS depth FROM n WHERE l_partkey IN (SELECT p_partkey FROM part))
SELECT p_partkey AS page_id, p_partkey AS other_page_id, CAST(0 AS INT) AS rank, CAST(0 AS INT) AS depth FROM part UNION ALL SELECT * FROM r""",
    "one_to_one": "SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "recall_of_pages": f"""
WITH pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, {_COS} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM pairs)
SELECT query_id, count(*) FILTER (ql = cl) AS n FROM best WHERE n <= 20 GROUP BY query_id""",
}
