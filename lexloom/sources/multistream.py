"""Compressed dumps of many streams: pages are read by the index, and only the streams that hold wanted ones."""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_title
from .frames import filesystem

#: The endings of a dump and of its index, and pages of a stream.
DUMP, INDEX, PAGES = ".xml.bz2", "-index.txt", 100


def write_dump(pages: DataFrame, path: str, pages_per_stream: int = PAGES) -> DataFrame:
    """Dumps of pages (page_id, title, text) in a folder, one for each partition, each page_id once: streams of some pages, and an index with a line "offset:id:title" for each page.

    Gives (file, pages, bytes) of what was written. A partition's files have names of its number, so that a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = filesystem(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/dump-{TaskContext.get().partitionId():06d}"
        lines, held, at, n = [], [], 0, 0
        with system.open_output_stream(name + DUMP, compression=None) as f:

            def flush() -> int:
                if not held:
                    return at
                root = ElementTree.Element("pages")
                for page_id, title, text in held:
                    page = ElementTree.SubElement(root, "page")
                    for tag, value in (("title", title), ("id", str(page_id)), ("text", text)):
                        ElementTree.SubElement(page, tag).text = value
                    lines.append(f"{at}:{page_id}:{title}\n")
                data = bz2.compress("".join(ElementTree.tostring(p, "unicode") for p in root).encode())
                f.write(data)
                held.clear()
                return at + len(data)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(row)
                    n += 1
                    if len(held) == pages_per_stream:
                        at = flush()
            at = flush()
        with system.open_output_stream(name + INDEX) as f:
            f.write("".join(lines).encode())
        yield pa.RecordBatch.from_arrays([pa.array([name + DUMP]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["file", "pages", "bytes"])

    rows = pages.select(F.col("page_id").cast("long"), "title", "text").where("page_id is not null and title is not null and text is not null")
    return rows.mapInArrow(run, "file string, pages long, bytes long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, title) of all indexes in a folder, the file being the dump's."""
    parts = F.split("value", ":", 3)
    lines = spark.read.text(path, pathGlobFilter=f"*{INDEX}").select("value", "_metadata.file_path").where(F.size(parts) == 3)
    return lines.select(F.regexp_replace("file_path", F.lit(INDEX.replace(".", r"\.") + "$"), F.lit(DUMP)).alias("file"), parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), parts[2].alias("title"))


def streams(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, start, end, page_ids): the streams that hold pages whose normalised title is one of wanted (title); the end of a file's last stream is null."""
    ends = listed.select("file", "offset").distinct().withColumn("end", F.lead("offset").over(Window.partitionBy("file").orderBy("offset")))
    asked = wanted.select(normalized_title(F.col("title"), True).alias("_n")).distinct()
    found = listed.join(asked, normalized_title(F.col("title"), True) == F.col("_n"), "left_semi")
    return found.groupBy("file", "offset").agg(F.collect_set("page_id").alias("page_ids")).join(ends, ["file", "offset"]).select("file", F.col("offset").alias("start"), "end", "page_ids")


def read_streams(ranges: DataFrame) -> DataFrame:
    """(page_id, title, text, bytes) of the wanted pages of streams (file, start, end, page_ids); bytes: what was read of the file for a stream, with its first page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = filesystem(file)
                with system.open_input_file(place) as f:
                    f.seek(start)
                    data = f.read() if end is None else f.read(end - start)
                out = []
                for page in ElementTree.fromstring(b"<pages>" + bz2.decompress(data) + b"</pages>"):
                    if int(page.findtext("id")) in set(wanted):
                        out.append((int(page.findtext("id")), page.findtext("title"), page.findtext("text") or "", 0 if out else len(data)))
                columns = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "title", "text", "bytes"])

    return ranges.repartition("file", "start").select("file", "start", "end", "page_ids").mapInArrow(run, "page_id long, title string, text string, bytes long")


def read_wanted(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(page_id, title, text, bytes) of the pages of a folder's dumps whose title is wanted (title); no other stream is read."""
    return read_streams(streams(index(spark, path), wanted))
