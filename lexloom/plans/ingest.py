"""Queries on sources, markup and incremental operators, over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import clean, without_file_links
from ..sources import devset, files
from ..streaming.incremental import category_windows
from .tables import table


def devset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the line format, one file each: the role as title, turns as questions."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), c)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array(F.lit("# note"), line("T", F.col("role")), F.lit(""), line("C", F.lit("context")), line("Q", F.regexp_replace("text", "\n", " ")), F.lit("A: a; b ;"), F.lit("====")), "\n").alias("t"))
    text = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("text"))
    rows = devset.parse(text.withColumnRenamed("conv_id", "file_id"))
    return rows.select("id", "title", "context", "question", F.array_join("answers", "|").alias("answers"))


def dump_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tuples of a dump, with escaped quotes and nulls."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name = F.when(F.col("p_partkey") % 7 == 0, "NULL").otherwise(F.concat(F.lit("'"), F.col("p_name"), F.lit("\\'s (x),'")))
    lines = p.select(F.concat(F.lit("INSERT INTO `t` VALUES ("), F.col("p_partkey").cast("string"), F.lit(","), name, F.lit(","), F.col("p_size").cast("string"), F.lit("),(-1,'',1.5e3);")).alias("value"))
    f = files.dump_rows(lines, 3).where(F.col("fields")[0] != "-1")
    return f.select(F.col("fields")[0].cast("long").alias("p_partkey"), F.col("fields")[1].alias("name"), F.col("fields")[2].cast("int").alias("p_size"))


def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with file links that hold links, templates, quotes and an appendix."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[\[\]{}<>|&'=]", "").alias("t"))
    wiki = F.concat(F.lit("[[File:a.png|thumb|see [[b|c]] here]]'''"), F.col("t"), F.lit("''' {{x|{{y}}}}[[page|label]] {{formatnum:12}}\n== Przypisy ==\nrest"))
    return b.select("item_id", clean(wiki).alias("text"), without_file_links(F.concat(F.lit("[[Image:x]]"), F.col("t"), F.lit("[[File:open"))).alias("kept"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = category_windows(table(spark, sf_dir, "events"), "ts", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "category", "n")


QUERIES = {f.__name__: f for f in (devset_parse, dump_parse, markup_clean, event_windows)}
ORACLE = {
    "devset_parse": """
SELECT 1000000 + row_number() OVER (ORDER BY conv_id, turn) AS id, role AS title, 'context' AS context, trim(replace(text, chr(10), ' '), ' ') AS question, 'a|b' AS answers FROM conversations""",
    "dump_parse": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name || '''s (x),' END AS name, p_size FROM part",
    "markup_clean": r"""
WITH b AS (SELECT item_id, regexp_replace(text, '[\[\]{}<>|&''=]', '', 'g') AS t FROM benchmark)
SELECT item_id, t || ' label 12' || chr(10) AS text, t || '[[File:open' AS kept FROM b""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d %H') AS start, event_type AS category, count(*) AS n FROM events GROUP BY ALL",
}
