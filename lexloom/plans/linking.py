"""Queries on links, graphs, filters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import link, match, report
from .tables import table


def link_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles: a nation by key, or a fallback by segment; the nation's region in the other language by name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0")
    titles = c.select(F.concat_ws("/", "c_custkey", "c_nationkey").alias("title"))
    pages = c.where("c_nationkey % 3 <> 0").select(F.concat_ws("/", "c_custkey", "c_nationkey").alias("k"), F.col("c_nationkey").alias("v"))
    redirects = c.where("c_custkey % 2 = 0").select(F.concat_ws("/", "c_custkey", "c_nationkey").alias("k"), (F.col("c_nationkey") % 7).alias("v"))
    links = nation.select(F.col("n_nationkey").alias("page_id"), F.concat_ws(" ", F.lit("in"), "n_name").alias("title"))
    others = nation.where("n_nationkey % 2 = 0").select(F.concat_ws("_", F.lit("in"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("k"), F.col("n_regionkey").alias("v"))
    manual = nation.where("n_nationkey % 3 = 1").select(F.concat_ws("_", F.lit("in"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("k"), F.lit(99).alias("v"))
    return link.link_articles(titles, pages, redirects, links, others, manual)


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "#history").otherwise("")).alias("t"))
    keys = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2), ("MACHINERY#history", 3)], "k string, v int")
    return link.section_fallback(c, "t", keys, "v").select("c_custkey", "v")


def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as pages that are told apart by their number: a line links its part to its supplier."""
    return link.edges(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


def graph_edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.adjacency(_graph(spark, sf_dir)).select("src", F.size("neighbours").alias("degree"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(3,), (70,), (499,)], "id long")
    return link.within(_graph(spark, sf_dir), seeds, 2)


def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unfinished(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("normal"))
    return link.title_collisions(rows).select("normal", F.size("titles").alias("n"), F.get("titles", F.lit(0)).alias("first"))


def category_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_category(table(spark, sf_dir, "events"), F.col("event_type"), F.col("value") > 50)


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return report.by_category(d, F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("lang")), F.col("quality") == 0)


def translation_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(table(spark, sf_dir, "benchmark"), F.size(F.split("text", " ")))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_type", F.explode(props).alias("key", "v")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("try_cast(v as bigint)")).alias("most"))


_EDGES = "edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"
_REPORT = """
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n_all, count(*) FILTER (NOT x) AS n_original, count(*) FILTER (x) AS n_extended FROM r GROUP BY ROLLUP (category)"""

QUERIES = {f.__name__: f for f in (link_with_fallback, section_lookup, last_duplicate, graph_edges_distinct, graph_adjacency, graph_two_hop, semi_filter, anti_resume, title_collisions, category_report_rollup, language_report, translation_histograms, json_props)}
ORACLE = {
    "link_with_fallback": """
WITH c AS (SELECT c_custkey || '/' || c_nationkey AS title, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey WHEN c_custkey % 2 = 0 THEN c_nationkey % 7 END AS page_id FROM customer)
SELECT title, page_id, CASE WHEN n_name IS NOT NULL THEN 'in ' || n_name END AS other_title, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey WHEN n_nationkey % 3 = 1 THEN 99 END AS other_page_id
FROM c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON n_nationkey = page_id""",
    "section_lookup": "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END END AS INT) AS v FROM customer",
    "last_duplicate": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "graph_edges_distinct": f"WITH {_EDGES} SELECT src, dst FROM edges",
    "graph_adjacency": f"WITH {_EDGES} SELECT src, CAST(count(*) AS INT) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM edges GROUP BY src",
    "graph_two_hop": f"""
WITH {_EDGES}, e AS (SELECT * FROM edges), s AS (SELECT unnest([3, 70, 499]) AS id), a AS (SELECT id FROM s UNION SELECT dst FROM e WHERE src IN (SELECT id FROM s))
SELECT CAST(id AS BIGINT) AS id FROM (SELECT id FROM a UNION SELECT dst FROM e WHERE src IN (SELECT id FROM a))""",
    "semi_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "anti_resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "title_collisions": "SELECT split_part(p_name, ' ', 1) AS normal, CAST(count(DISTINCT p_name) AS INT) AS n, min(p_name) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1",
    "category_report_rollup": f"WITH r AS (SELECT event_type AS category, value > 50 AS x FROM events) {_REPORT}",
    "language_report": f"WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'OTHER' ELSE lang END AS category, quality = 0 AS x FROM documents JOIN labels USING (doc_id)) {_REPORT}",
    "translation_histograms": "SELECT CAST(len(string_split(text, ' ')) AS INT) AS value, count(*) AS n FROM benchmark GROUP BY 1",
    "json_props": "SELECT event_type, k AS key, count(*) AS n, max(TRY_CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS most FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL",
}
