"""Linking of articles across languages, and graphs of page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_title, unquoted


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last in the order (a column without ties within a key)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def lookup_with_fallback(rows: DataFrame, key: str, table: DataFrame, fallback: DataFrame, out: str) -> DataFrame:
    """rows with the value (column v) of their key in table (k, v), or else in fallback (k, v), as column out; null where neither has it."""
    a, b = table.select(F.col("k").alias("_ka"), F.col("v").alias("_va")), fallback.select(F.col("k").alias("_kb"), F.col("v").alias("_vb"))
    return rows.join(a, rows[key] == a["_ka"], "left").join(b, rows[key] == b["_kb"], "left").withColumn(out, F.coalesce("_va", "_vb")).drop("_ka", "_kb", "_va", "_vb")


def link_articles(titles: DataFrame, pages: DataFrame, redirects: DataFrame, langlinks: DataFrame, other_pages: DataFrame, manual: DataFrame) -> DataFrame:
    """(title, page_id, other_title, other_page_id): titles found by page title or redirect, then through language links, whose
    targets are found by title (blanks as underscores) or by a manual table. Unmatched titles have nulls."""
    rows = lookup_with_fallback(titles.select("title"), "title", pages, redirects, "page_id")
    rows = rows.join(langlinks.select(F.col("page_id").alias("_l"), F.col("title").alias("_t")), rows["page_id"] == F.col("_l"), "left").drop("_l")
    rows = lookup_with_fallback(rows.withColumn("_u", F.replace("_t", F.lit(" "), F.lit("_"))), "_u", other_pages, manual, "other_page_id")
    return rows.select("title", "page_id", F.col("_t").alias("other_title"), "other_page_id")


def section_fallback(rows: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """The value of a title, or of the part before its #section."""
    whole = rows.withColumn("_page", F.split_part(key, F.lit("#"), F.lit(1)))
    a, b = (table.select(F.col("k").alias(f"_k{i}"), F.col("v").alias(f"_v{i}")) for i in (0, 1))
    return whole.join(a, whole[key] == a["_k0"], "left").join(b, whole["_page"] == b["_k1"], "left").withColumn(out, F.coalesce("_v0", "_v1")).drop("_page", "_k0", "_k1", "_v0", "_v1")


def edges(links: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self loops."""
    return links.select("src", "dst").where("src <> dst").distinct()


def adjacency(graph: DataFrame) -> DataFrame:
    """(src, neighbours): sorted."""
    return graph.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def within(graph: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id): the seeds (id) and what is reachable from them in at most `depth` steps."""
    found = seeds.select("id").distinct()
    for _ in range(depth):
        found = found.unionByName(graph.join(found, graph["src"] == found["id"], "left_semi").select(F.col("dst").alias("id"))).distinct()
    return found


def extend_articles(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Nested articles (title, ...) with enwiki_page_id, enwiki_title (the title, %XX decoded), plwiki_page_id and plwiki_title of links (title, page_id, other_title, other_page_id); nulls where a title has no link.

    Only titles and their links meet in a shuffle of their own; of links that share a title one counts, the smallest.
    """
    known = links.select(F.col("title").alias("_t"), F.struct("page_id", "other_page_id", "other_title").alias("_l")).groupBy("_t").agg(F.min("_l").alias("_l"))
    rows = articles.withColumn("enwiki_title", unquoted(F.col("title"))).join(known, F.col("enwiki_title") == F.col("_t"), "left")
    return rows.select(*articles.columns, F.col("_l.page_id").alias("enwiki_page_id"), "enwiki_title", F.col("_l.other_page_id").alias("plwiki_page_id"), F.col("_l.other_title").alias("plwiki_title"))


def combined(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Nested articles (title, ...) whose normalised title is a page's (page_id, title), with its en_wiki_page_id; others go. A normalised title that two articles or two pages share fails the job that reads it."""
    left = articles.withColumn("_title", normalized_title(F.col("title")))
    right = pages.select(normalized_title(F.col("title")).alias("_title"), F.col("page_id").alias("en_wiki_page_id"))
    # titles without a partner don't matter, and may repeat
    some = right.join(left.select("_title"), "_title", "left_semi")
    return one_to_one(left.join(right.select("_title"), "_title", "left_semi"), some, "_title").drop("_title")


def title_collisions(titles: DataFrame, normal: str = "normal") -> DataFrame:
    """(normal, titles): normalised titles that several titles share."""
    return titles.groupBy(normal).agg(F.array_sort(F.collect_set("title")).alias("titles")).where(F.size("titles") > 1)


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of links (src, dst_title) whose source is a page and whose target's title one is (page_id, title)."""
    known = links.join(pages.select(F.col("page_id").alias("_p")), F.col("src") == F.col("_p"), "left_semi")
    return edges(known.join(pages.select(F.col("page_id").alias("dst"), F.col("title").alias("_t")), F.col("dst_title") == F.col("_t")).select("src", "dst"))


def related_pages(pages: DataFrame, similar: DataFrame, depth: int) -> DataFrame:
    """(page_id, other_page_id, rank): the page itself (depth 0), or its similar pages (page_id, sim_page_id, rank) (depth 1)."""
    if depth == 0:
        return pages.select("page_id", F.col("page_id").alias("other_page_id"), F.lit(0).alias("rank")).distinct()
    if depth == 1:
        return pages.select("page_id").distinct().join(similar, "page_id").select("page_id", F.col("sim_page_id").alias("other_page_id"), "rank")
    raise ValueError("depth is 0 or 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined by a key that neither may repeat; a repeated key fails the job that reads it."""

    def single(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))))).drop("_n")

    return single(left).join(single(right), key)
