"""Sentence tables: splitting, sliding pairs, whole articles, and their union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sentence_table(articles: DataFrame, split: Callable[[Column], Column] = T.sentences, tokenize: Callable[[Column], Column] = T.tokens, stop: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, sent_no, title, tokens, raw_text) of articles (page_id, title, text). Categories and pictures go before numbering."""
    return numbered(articles.select("page_id", "title", split(F.col("text")).alias("sentences")), tokenize, stop)


def numbered(articles: DataFrame, tokenize: Callable[[Column], Column] = T.tokens, stop: tuple[str, ...] = ()) -> DataFrame:
    """sentence_table() of articles (page_id, title, sentences) that are split already, as by boundaries.learned_sentences()."""
    kept = F.filter("sentences", T.is_prose)
    rows = articles.select("page_id", "title", F.posexplode(kept).alias("sent_no", "raw_text"))
    return rows.select("page_id", "sent_no", "title", T.without_stop_words(tokenize(F.col("raw_text")), stop).alias("tokens") if stop else tokenize(F.col("raw_text")).alias("tokens"), "raw_text")


def skip_namespaces(articles: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return articles.where(~F.col("title").rlike("^(%s):" % "|".join(prefixes)))


def sentence_pairs(sentences: DataFrame) -> DataFrame:
    """Rows of neighbouring sentences of a page: (page_id, sentence_nums, title, tokens, raw_text); a page's only sentence is a row as it is."""
    w = Window.partitionBy("page_id").orderBy("sent_no")
    rows = sentences.select("*", F.lead("sent_no").over(w).alias("_no"), F.lead("tokens").over(w).alias("_tokens"), F.lead("raw_text").over(w).alias("_raw"), F.count(F.lit(1)).over(Window.partitionBy("page_id")).alias("_n"))
    pair = F.col("_no").isNotNull()
    return rows.where(pair | (F.col("_n") == 1)).select(
        "page_id", F.when(pair, F.array("sent_no", "_no")).otherwise(F.array("sent_no")).alias("sentence_nums"), "title",
        F.when(pair, F.concat("tokens", "_tokens")).otherwise(F.col("tokens")).alias("tokens"), F.when(pair, F.concat_ws(" ", "raw_text", "_raw")).otherwise(F.col("raw_text")).alias("raw_text"),
    )


def single_rows(sentences: DataFrame) -> DataFrame:
    return sentences.select("page_id", F.array("sent_no").alias("sentence_nums"), "title", "tokens", "raw_text")


def both_modes(sentences: DataFrame) -> DataFrame:
    """Single sentences and pairs, told apart by their titles."""
    mark = lambda df, n: df.withColumn("title", F.concat("title", F.lit(f" (sentence_{n})")))
    return mark(single_rows(sentences), 1).unionByName(mark(sentence_pairs(sentences), 2))


def whole_articles(sentences: DataFrame) -> DataFrame:
    """(page_id, title, tokens, raw_text): a page's sentences in order."""
    parts = F.array_sort(F.collect_list(F.struct("sent_no", "tokens", "raw_text")))
    rows = sentences.groupBy("page_id", "title").agg(parts.alias("_p"))
    return rows.select("page_id", "title", F.flatten(F.col("_p.tokens")).alias("tokens"), F.array_join(F.col("_p.raw_text"), " ").alias("raw_text"))


def merged_list_paragraphs(paragraphs: DataFrame, item: Column, colon: Column) -> DataFrame:
    """(doc_id, island, text): a paragraph that ends with a colon takes in the run of list items after it.

    paragraphs: doc_id, pos, text; item and colon say what is a list item and what ends with a colon.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = paragraphs.select("doc_id", "pos", "text", item.alias("_item"), colon.alias("_colon"))
    rows = rows.withColumn("_grp", F.sum(F.when(F.col("_item"), 0).otherwise(1)).over(order))
    before = Window.partitionBy("doc_id", "_grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.col("_item") & (F.coalesce(F.max(F.col("_colon").cast("int")).over(before), F.lit(0)) == 1))
    rows = rows.withColumn("island", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(order))
    merged = rows.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_p"))
    return merged.select("doc_id", "island", F.array_join(F.col("_p.text"), " ").alias("text"))


def paragraphs(articles: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text): blank lines part paragraphs; a heading right before a list becomes its introduction, other headings go."""
    text = F.regexp_replace(F.col(text_col), r"={2,6}\s*([^=\n]+?)\s*={2,6}\s{0,10}\n(?=\* )", "$1: \n\n")
    text = T.without_headers(text)
    rows = articles.select("doc_id", F.posexplode(F.split(text, r"\n{2,}")).alias("pos", "text"))
    return rows.select("doc_id", "pos", T.single_blanks(F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("text")).where("text <> ''")


def counters(sentences: DataFrame) -> DataFrame:
    """One row: articles, sentences and token positions."""
    return sentences.agg(F.count_distinct("page_id").alias("articles"), F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("positions"))
