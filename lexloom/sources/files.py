"""Readers of corpora, predictions, dumps, pages, title lists and index files, and the writers beside them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import clean
from ..functions.text import is_redirect
from ..operators.link import last_wins
from . import schemas


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A nested question-answering document (one JSON value a file)."""
    return spark.read.schema(schemas.QA_CORPUS).option("multiLine", True).json(path)


def write_corpus(nested: DataFrame, path: str) -> None:
    """Articles (ordinal, title, paragraphs) as JSON documents in the order of their ordinals: a file for each range of them, each a whole document {"data": [...]} of one line an article, so that no row or task holds the corpus.

    read_corpus() reads the folder as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["value"])
        before = None
        for batch in batches:
            for article in batch.column(0).to_pylist():
                yield line(['{"data": [' if before is None else before + ","])
                before = article
        if before is not None:
            yield line([before + "]}"])

    rows = nested.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    rows.select(F.to_json(F.struct("title", "paragraphs")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schemas.PREDICTIONS)).alias("id", "prediction"))


# A value of a dump: a number, NULL, or a quoted string with backslash escapes.
_VALUE = r"(?:NULL|-?[\d.eE+-]+|'(?:[^'\\]|\\.)*')"


def dump_rows(lines: DataFrame, n_fields: int) -> DataFrame:
    """(fields: array of strings) of each tuple in the lines (value) of INSERT statements; NULL as null, escapes undone.

    Tuples may stand one a line or many in a statement; lines without any give no rows.
    """
    one = r"\(" + ",".join([_VALUE] * n_fields) + r"\)"
    tuples = lines.select(F.explode(F.regexp_extract_all("value", F.lit(f"({one})"), 1)).alias("t"))
    raw = F.regexp_extract_all("t", F.lit(f"({_VALUE})"), 1)
    plain = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.char_length(x) - 2), r"\\(.)", "$1")
    return tuples.select(F.transform(raw, lambda x: F.when(x == "NULL", F.lit(None)).when(x.startswith("'"), plain(x)).otherwise(x)).alias("fields"))


def read_page_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title) of articles that aren't redirects."""
    f = dump_rows(spark.read.text(path), 13)
    return f.where((F.col("fields")[1] == "0") & (F.col("fields")[4] == "0")).select(F.col("fields")[0].cast("int").alias("page_id"), F.col("fields")[2].alias("title"))


def read_langlinks_dump(spark: SparkSession, path: str, lang: str = "pl") -> DataFrame:
    f = dump_rows(spark.read.text(path), 3)
    return f.where(F.col("fields")[1] == lang).select(F.col("fields")[0].cast("int").alias("page_id"), F.col("fields")[2].alias("title"))


def read_pagelinks_dump(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst_title) of links between articles."""
    f = dump_rows(spark.read.text(path), 4)
    return f.where((F.col("fields")[1] == "0") & (F.col("fields")[3] == "0")).select(F.col("fields")[0].cast("int").alias("src"), F.col("fields")[2].alias("dst_title"))


def read_wiki(spark: SparkSession, path: str, namespaces: tuple[str, ...] = ("0",), pages: DataFrame | None = None, redirects: bool = False) -> DataFrame:
    """(page_id, title, text) of an XML dump (also compressed), of these namespaces and, if given, pages (page_id); without empty texts."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(schemas.WIKI_PAGE).load(path)
    rows = rows.where(F.col("ns").isin(*namespaces)).select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text")).where("text <> ''")
    if not redirects:
        rows = rows.where(~is_redirect(F.col("text")))
    return rows if pages is None else rows.join(pages.select("page_id"), "page_id", "left_semi")


def read_articles(spark: SparkSession, path: str, namespaces: tuple[str, ...] = ("0",), pages: DataFrame | None = None) -> DataFrame:
    """(page_id, title, text) of an XML dump as plain text: read_wiki() with the markup cleaned, without articles of which nothing is left."""
    rows = read_wiki(spark, path, namespaces, pages)
    return rows.withColumn("text", clean(F.col("text"))).where(F.col("text").rlike(r"\S"))


def write_pages(pages: DataFrame, path: str, namespace: str = "0") -> None:
    """Pages (page_id, title, text) as XML dumps, a file a task, as read_wiki() reads them; what XML can't hold (control characters) becomes a blank."""
    text = F.struct(F.octet_length("text").alias("_bytes"), F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", " ").alias("_VALUE"))
    rows = pages.where("page_id is not null").select("title", F.lit(namespace).alias("ns"), F.col("page_id").alias("id"), F.struct(text.alias("text")).alias("revision"))
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(en, pl) of lines "pl ||| en"; of repeated titles the last, in the order of the files' names, whichever task reads which part of them."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("_no"))
    parts = F.split("value", r"\|\|\|")
    rows = lines.where(F.size(parts) == 2).select(F.trim(parts[1]).alias("en"), F.trim(parts[0]).alias("pl"), "_no")
    return last_wins(rows, "en", "_no").select("en", "pl")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, page_id, title) of lines "offset:id:title"; titles may hold colons."""
    parts = F.split("value", ":", 3)
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), parts[2].alias("title"))


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Space-delimited files, quoted where needed."""
    return spark.read.schema(schema).csv(path, sep=" ", escape='"')


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=" ", escape='"')


def read_cities(spark: SparkSession, path: str, translations: DataFrame | None = None) -> DataFrame:
    """(city): names and, with translations (en, pl), their translations."""
    names = spark.read.schema("city string, country string, subcountry string, geonameid long").csv(path, header=True).select("city")
    if translations is not None:
        names = names.unionByName(names.join(translations, F.col("city") == F.col("en")).select(F.col("pl").alias("city")))
    return names.distinct()
