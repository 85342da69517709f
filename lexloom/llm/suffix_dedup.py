"""Suffix-array dedup by prefix-free parsing.

A text is parsed at rolling-hash triggers: the trigger of a start position is the least hash of the q-grams in the window
that begins there (the leftmost of equals), so that equal strings of `least` bytes always have their trigger
at the same place. The starts that share a trigger, extended by `least` bytes, are a phrase; each start lies in
exactly one. The dictionary holds the distinct phrases, the parse says how often each occurs:

* a phrase that occurs twice makes all its starts repeated, whatever stands around it;
* other repeats lie in phrases with the same trigger context (the bytes right of the trigger that every start of a phrase
  holds). Only these phrases of the dictionary are compared, first as blocks of a few starts in the same way; what is then
  left, at the ends of repeats, is ranked: the suffixes of the phrases at hand are sorted by prefix doubling to the depth
  of `least` bytes, which gives exact classes of equal strings; weighted by the parse's counts, the classes are
  combined over all tasks by their digests.

The order of the corpus's suffixes matters here only as far as two are equal to the depth of `least`, so classes
are combined instead of merging sorted lists; nothing needs more memory than a block, and a phrase or string that very
many documents share is counted where it is read before it is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize

LEAST = 200
QGRAM = 16
#: Starts whose q-grams are looked at for a trigger: a power of two, and QGRAM + REACH <= LEAST.
REACH = 128
#: Starts parsed at a time, and bytes of a block of phrases whose suffixes are ranked at a time.
PARSE_STARTS, BLOCK_BYTES = 1 << 22, 1 << 22
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def triggers(text: bytes, least: int = LEAST, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, trigger) of each phrase of a text."""
    parts = [_triggers(text, at, min(len(text), at + PARSE_STARTS + least - 1), least, reach) for at in range(0, len(text) - least + 1, PARSE_STARTS)]
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _triggers(text: bytes, lo: int, hi: int, least: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = hi - lo
    q = min(QGRAM, least - reach)
    word = np.ndarray((n - 7,), "<u8", text, lo, (1,)) if n >= 8 else None
    if q >= 16:
        h = word[: n - 15] * _A
        h ^= (word[8 : n - 7] * _B) >> np.uint64(29)
    else:  # small parameters, in tests
        q = 1
        h = np.frombuffer(text, np.uint8, n, lo).astype(np.uint64) * _A
        h ^= h >> np.uint64(31)
    h *= _C
    h ^= h >> np.uint64(33)
    h *= _A
    bits = np.uint64(24)
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while k < reach:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    at = (v[: n - least + 1] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return lo + first, np.diff(np.append(first, len(at))), lo + at[first]


def suffix_classes(block: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """The rank of block[s : s + depth] for each start s, equal for equal strings: prefix doubling from 8 bytes."""
    data = np.frombuffer(block + bytes(8), np.uint8)
    have = min(8, depth)
    key = np.zeros(len(block), np.uint64)
    for i in range(have):
        key = (key << np.uint64(8)) | data[i : i + len(block)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while have < depth:
        step = min(have, depth - have)  # the second half may overlap the first
        key = rank << np.uint64(32)
        key[: len(rank) - step] |= rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank[starts].astype(np.int64)


def _long(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


#: Starts of a block, the second and finer cut of phrases.
BLOCK_STARTS = 16
_COLUMNS = ["doc_id", "th", "key", "digest", "n", "first", "count", "ahead"]


def _collapse(batch: pa.RecordBatch, row, key, digest, n, first, count, ahead) -> Iterator[pa.RecordBatch]:
    """A row for each (key, digest) of the batch with its number (2: several), and the starts that are repeated in it as rows with n = 0."""
    order = np.lexsort((digest, key))
    heads = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])]))
    total, size, some = np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(order))), order[heads]
    known = np.sort(order[(np.repeat(total, size) > 1) & (n[order] == 1)])  # in the order of the documents
    if len(known):  # neighbours in a document are joined
        at = np.flatnonzero(np.concatenate([[True], (row[known][1:] != row[known][:-1]) | (first[known][1:] != first[known][:-1] + count[known][:-1])]))
        k_row, k_first, k_count = row[known][at], first[known][at], np.add.reduceat(count[known], at)
    else:
        k_row = k_first = k_count = np.empty(0, np.int64)
    zero = np.zeros(len(k_row), np.int64)
    spread = (k_first.astype(np.uint64) * _A ^ k_row.astype(np.uint64) * _B).view(np.int64)  # a key of no meaning
    rows = pa.array(np.concatenate([row[some], k_row]))
    small = lambda x: pa.array(np.concatenate(x).astype(np.int32))
    out = [
        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([key[some], spread])), pa.array(np.concatenate([digest[some], zero])),
        small((np.minimum(total, 2), zero)), pa.array(np.concatenate([first[some], k_first])), small((count[some], k_count)), small((ahead[some], zero)),
    ]
    for i in range(0, len(rows), 1 << 16):
        yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in out], _COLUMNS)


def _phrases(least: int, reach: int) -> Callable:
    """The phrases of whole texts. key: the bytes that all starts of a trigger hold; digest: the phrase."""
    h, right = xxhash.xxh3_64_intdigest, least - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, count, trigger, key, digest = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if text is None or len(text) < least:
                    continue
                a, n, t = triggers(text, least, reach)
                row.append(np.full(len(a), i))
                first.append(a)
                count.append(n)
                trigger.append(t)
                key += [h(text[x : x + right]) for x in t.tolist()]
                digest += [h(text[x:y]) for x, y in zip(a.tolist(), (a + n + (least - 1)).tolist())]
            if row:
                row, first, count, trigger = map(np.concatenate, (row, first, count, trigger))
                yield from _collapse(batch, row, _long(key), _long(digest), np.ones(len(row), np.int64), first, count, trigger - first)

    return frugal(run)


def _blocks(least: int) -> Callable:
    """Listed phrases cut into blocks of BLOCK_STARTS starts, in line with their triggers, which equal strings share. key: the bytes that all
    starts of a whole block hold; digest: the block."""
    h, wide = xxhash.xxh3_64_intdigest, min(BLOCK_STARTS, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, first, count, key, digest = [], [], [], [], [], []
            for i, (text, phrases) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                for e in phrases:
                    trigger, at, end = e["first"] + e["ahead"], e["first"], e["first"] + e["count"]
                    while at < end:
                        last = trigger - (trigger - at) // wide * wide  # the last start of at's block
                        stop = min(end, last + 1)
                        row.append(i)
                        n.append(e["n"])
                        first.append(at)
                        count.append(stop - at)
                        key.append(h(text[last : last + least - wide + 1]))
                        digest.append(h(text[at : stop + least - 1]))
                        at = stop
            if row:
                row, n, first, count = (np.array(x, np.int64) for x in (row, n, first, count))
                yield from _collapse(batch, row, _long(key), _long(digest), n, first, count, np.zeros(len(row), np.int64))

    return frugal(run)


def _windows(least: int) -> Callable:
    """The single starts of listed blocks: the suffixes of all blocks at hand are ranked, a class of equal strings is a row."""
    h = xxhash.xxh3_64_intdigest

    def classes(batch: pa.RecordBatch, entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        """entries: (row, n, first, count, bytes)"""
        data = b"".join(e[4] for e in entries)
        row, n, first, count = (np.array([e[i] for e in entries], np.int64) for i in range(4))
        base = np.cumsum([0, *(len(e[4]) for e in entries)])[:-1]
        which = np.repeat(np.arange(len(entries)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        ranks = suffix_classes(data, base[which] + inside, least)
        order = np.argsort(ranks, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], ranks[order][1:] != ranks[order][:-1]]))
        some = (base[which] + inside)[order[heads]].tolist()
        # a class's digest stands for its rank from here on
        key, digest = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        size = np.diff(np.append(heads, len(order)))
        key[order] = np.repeat(_long([h(data[s : s + least], 1) for s in some]), size)
        digest[order] = np.repeat(_long([h(data[s : s + least]) for s in some]), size)
        one = np.ones(len(which), np.int64)
        yield from _collapse(batch, row[which], key, digest, n[which], (first[which] + inside), one, 0 * one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, (text, phrases) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                for e in phrases:
                    held.append((i, e["n"], e["first"], e["count"], text[e["first"] : e["first"] + e["count"] + least - 1]))
                    size += len(held[-1][4])
                    if size > BLOCK_BYTES:
                        yield from classes(batch, held)
                        held, size = [], 0
            if held:
                yield from classes(batch, held)

    return frugal(run)


def spans_of(first: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (start, end) that the strings of `least` bytes at these starts cover."""
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((first + count + (least - 1))[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def _settle(found: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(known, open): starts that these rows show to be repeated, and the dictionary of distinct phrases that aren't settled.

    A key with several phrases leaves all of them open, one of each with its count; what occurs twice as a whole is known already.
    """
    keys = found.where("n > 0").groupBy("key").agg(F.sum("n").alias("total"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    keys = keys.where("total > 1").select("key", (F.col("low") != F.col("high")).alias("mixed"))
    rows = materialize(found.join(keys, "key", "left").where("n = 0 or mixed is not null"), f"suffix-{label}")
    at = ["doc_id", "th", "first", "count"]
    known = rows.where("n = 0 or (n = 1 and not mixed)").select(at)
    mixed = rows.where("n > 0 and mixed")
    entries = mixed.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("th", "first", "doc_id", "count", "ahead")).alias("at"))
    entries = materialize(entries, f"suffix-{label}-dictionary")
    known = known.unionByName(mixed.where("n = 1").join(entries.where("n > 1").select("key", "digest"), ["key", "digest"], "left_semi").select(at))
    phrase = F.struct(F.least("n", F.lit(2)).cast("int").alias("n"), F.col("at.first").alias("first"), F.col("at.count").alias("count"), F.col("at.ahead").alias("ahead"))
    return known, entries.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th")).agg(F.collect_list(phrase).alias("phrases"))


def repeated_starts(docs: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """(doc_id, th, first, count): runs of starts whose string of `least` bytes starts elsewhere too.

    docs: doc_id, th (hash of the text), text. Runs may overlap and repeat. Equal rows of docs share their runs: what such a
    document holds occurs twice, so its phrases are known at once and it doesn't matter which of the rows is meant.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, key long, digest long, n int, first long, count int, ahead int"

    def texts(wanted: DataFrame) -> DataFrame:
        hit = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["w_id"]) & (docs["th"] == wanted["w_th"]))
        return hit.select("doc_id", "th", "text", "phrases")

    known, phrases = _settle(docs.mapInArrow(_phrases(least, reach), schema), "phrases")
    more, blocks = _settle(texts(phrases).mapInArrow(_blocks(least), schema), "blocks")
    strings = materialize(texts(blocks).mapInArrow(_windows(least), schema), "suffix-strings")
    at = ["doc_id", "th", "first", "count"]
    twice = strings.where("n > 0").groupBy("key", "digest").agg(F.sum("n").alias("total")).where("total > 1").select("key", "digest")
    last = strings.where("n = 1").join(twice, ["key", "digest"], "left_semi").select(at)
    return known.unionByName(more).unionByName(strings.where("n = 0").select(at)).unionByName(last)


def _cut(least: int, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, starts, ends, kept = [], [], [], [], []
            for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                text = text or b""
                if runs.is_valid:
                    flat = runs.values.flatten()
                    a, b = spans_of(flat[0].to_numpy(), flat[1].to_numpy(), least)
                else:
                    a = b = np.empty(0, np.int64)
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                left = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                n.append(len(text))
                removed.append(len(text) - len(left))
                starts.append(a)
                ends.append(b)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore"))
            spans = pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), *spans, pa.array(kept, pa.string()), *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "span_start", "span_end", "kept", *batch.schema.names[3:]])

    return frugal(run)


def remove_repeats(docs: DataFrame, least: int = LEAST, reach: int = REACH, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, span_start, span_end (removed byte runs) and kept, what is left of the text.

    Every byte goes that a string of `least` bytes covers which also starts anywhere else, in the same text or another.
    kept is a string, without code points that a run cuts in two; with digest=True it is the SHA-256 of the remaining bytes
    instead. Null texts count as empty; texts shorter than `least` stay; repeated rows, doc_ids and null doc_ids are documents of
    their own; a text may be as long as a row can be, and is parsed whole; an empty table gives no rows; other columns are carried along (a name that clashes with the result's or a working one gets the prefix "in_").
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = repeated_starts(base, least, reach).distinct()
    runs = runs.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    taken = {"doc_id", "text", "th", "runs", "r_id", "r_th", "n_bytes", "n_removed", "span_start", "span_end", "kept"}
    extra = [F.col(c).alias(f"in_{c}" if c in taken else c) for c in docs.columns if c not in (id_col, text_col)]
    if digest:
        extra = []
    full = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *extra)
    names = full.columns[3:]
    joined = full.join(runs.hint("shuffle_hash"), full["doc_id"].eqNullSafe(runs["r_id"]) & (full["th"] == runs["r_th"]), "left")
    joined = joined.select("doc_id", "text", "runs", *names)
    schema = ", ".join([f"doc_id {full.schema['doc_id'].dataType.simpleString()}", "n_bytes long, n_removed long, span_start array<bigint>, span_end array<bigint>, kept string", *(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in names)])
    return joined.mapInArrow(_cut(least, digest), schema)
