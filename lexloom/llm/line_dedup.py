"""Substring dedup by hashing short paragraphs: runs of consecutive lines or sentences.

A text is cut into pieces, its sentences and lines. From each piece on, as many as it takes to reach `least_words` words are one unit, so
that units don't depend on where a text begins, and a passage that is set into other texts holds the same units
everywhere. A unit is normalised (lower case, white space collapsed); all units with equal digests are one class, and the
earliest in the order of (doc_id, text hash, position) stays. The pieces of all others go, with their offsets in the original text retained.
Short lines that many texts share, such as headings and notices, are units only together with what stands beside them, and stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize

#: Patterns of a piece; the pieces of a text joined are the text.
SENTENCES, LINES, PARAGRAPHS = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", r"[^\n]*\n+|[^\n]+", r"(?:[^\n]|\n(?!\n))*\n\n+|(?:[^\n]|\n(?!\n))+\n?"
#: Words of a unit: half of a passage of fifty, so that wherever such a passage is cut into sentences it holds whole units.
LEAST_WORDS = 25
#: Units of a batch that is sent on.
UNIT_ROWS = 1 << 16


def pieces(text: str, pattern: re.Pattern) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """Start, end, number of words and normal form of each piece of the text that has a word."""
    start, end, size, norm = [], [], [], []
    for m in pattern.finditer(text):
        words = m.group().lower().encode("utf-8", "surrogatepass").split()  # splits at \x20 and \x09-\x0D only
        if words:
            start.append(m.start())
            end.append(m.end())
            size.append(len(words))
            norm.append(b" ".join(words))
    return start, end, size, norm


def runs(size: list[int], least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the units, by number of piece: the shortest run from each piece on that has least_words words; the last one is there a second
    time, up to the text's end, where that is longer."""
    ends = np.cumsum(np.array(size, np.int64))
    if not len(ends) or ends[-1] < least_words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = ends - np.array(size, np.int64)
    a = np.flatnonzero(ends[-1] - before >= least_words)
    b = np.searchsorted(ends, before[a] + least_words) + 1
    if b[-1] < len(ends):
        a, b = np.append(a, a[-1]), np.append(b, len(ends))
    return a, b


def _units(pattern: str, least_words: int) -> Callable:
    """(doc_id, th, a, b, d1, d2) of each unit of each text: pieces a to b (excluded), a digest of 128 bits."""
    compiled, digest = re.compile(pattern), xxhash.xxh3_128_digest

    def send(batch: pa.RecordBatch, row: list, a: list, b: list, d: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate(row))
        both = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
        ends = (pa.array(np.concatenate(x).astype(np.int32)) for x in (a, b))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *ends, pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "th", "a", "b", "d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, d = [], [], [], []
            for i in range(batch.num_rows):
                _, _, size, norm = pieces(batch.column(2)[i].as_py() or "", compiled)
                first, last = runs(size, least_words)
                for k in range(0, len(first), UNIT_ROWS):
                    x, y = first[k : k + UNIT_ROWS], last[k : k + UNIT_ROWS]
                    row.append(np.full(len(x), i))
                    a.append(x)
                    b.append(y)
                    d += [digest(b" ".join(norm[p:q])) for p, q in zip(x.tolist(), y.tolist())]
                    if len(d) >= UNIT_ROWS:
                        yield send(batch, row, a, b, d)
                        row, a, b, d = [], [], [], []
            if d:
                yield send(batch, row, a, b, d)

    return frugal(run)


def units(docs: DataFrame, least_words: int = LEAST_WORDS, pattern: str = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, a, b, d1, d2) of each unit; th is a hash of the text."""
    text = F.col(text_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return base.mapInArrow(_units(pattern, least_words), f"doc_id {kind}, th long, a int, b int, d1 long, d2 long")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, pattern: str = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, a, b): pieces that go, of each unit that has an earlier one. A unit that overlaps its first occurrence loses what lies beyond that.

    Digests are counted in partial aggregates, and only those that occur twice are joined with their units, so that
    a unit that very many documents share is one row on its side of the join, and adaptive execution can split the other.
    """
    rows = units(docs, least_words, pattern, id_col, text_col)
    place = F.struct("doc_id", "th", "a", "b")
    first = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    first = materialize(first.where("n > 1").select("d1", "d2", "first"), "units-first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = rows.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    later = later.select("doc_id", "th", F.when(same, F.greatest("a", F.col("first.b"))).otherwise(F.col("a")).alias("a"), "b")
    return later.where("a < b")


def _cut(pattern: str, least_words: int) -> Callable:
    compiled = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out, removed, kept = [], [], [], []
            for i in range(batch.num_rows):
                text, gone, copy = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                start, end, size, _ = pieces(text, compiled)
                if copy > 1:
                    gone = [{"a": 0, "b": len(size)}] if sum(size) >= least_words else []
                edges, went = [], np.zeros(len(size) + 1, np.int64)
                for x in sorted(gone or [], key=lambda x: (x["a"], x["b"])):
                    went[x["a"]] += 1
                    went[x["b"]] -= 1
                    a, b = start[x["a"]], end[x["b"] - 1]
                    if edges and a <= edges[-1]:
                        edges[-1] = max(edges[-1], b)
                    else:
                        edges += [a, b]
                n.append(len(size))
                out.append(int((np.cumsum(went)[:-1] > 0).sum()))
                removed.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                bounds = [0, *edges, len(text)]
                kept.append("".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())], ["doc_id", "n_units", "n_removed", "removed", "kept"])

    return frugal(run)


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, pattern: str = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_units, n_removed, removed (start and end in code points, of the original text) and kept.

    n_units counts the pieces (sentences and lines) that have a word, n_removed those that go: the pieces of units of at least least_words words that
    occur earlier. removed holds the maximal runs, kept is the text without them. Texts with fewer words have no unit and stay; texts of any
    length are taken whole, one at a time. Of rows with the same doc_id and text the first keeps what it has, the others lose all pieces (as far as
    the text has a unit). A null text counts as empty (kept: empty) and null doc_ids come first in the order; equal texts of
    different doc_ids are ordered by doc_id. The document's other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    gone = repeats(docs, least_words, pattern, id_col, text_col).distinct()
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("th"))
    base = base.select("*", F.coalesce("doc_id", zero).alias("_k"), F.isnull("doc_id").alias("_n"))
    gone = gone.select(F.coalesce("g_id", zero).alias("_k"), F.isnull("g_id").alias("_n"), F.col("g_th").alias("th"), "gone")
    rows = base.join(gone.hint("shuffle_hash"), ["_k", "_n", "th"], "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("_k", "_n", "th").orderBy(F.lit(1))))
    schema = f"doc_id {kind}, n_units long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    return rows.select("doc_id", "text", "gone", "copy").mapInArrow(_cut(pattern, least_words), schema)
