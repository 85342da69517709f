"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression: each code point is mapped to its class, each class change is a
transition function that resets the state "where did this run begin" and every other code point is one that keeps it.
Such functions compose associatively (the later reset wins), so the state at all positions is one scan: a running maximum
over the positions of the resets. The slices between boundaries go through pair merging, whose results are cached; their offsets
are kept, so that any slice of the ids can be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Fixed values of the pattern: the endings that an apostrophe forms a token with.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Slices kept in a worker's cache, and the longest that are.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Bytes from which merging uses a heap.
HEAP_BYTES = 96


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point, from the Unicode properties L, N and White_Space."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(pattern, points)]] = kind
    return table


def slice_starts(text: str) -> np.ndarray:
    """The positions (code points) at which the pattern's matches begin; they cover the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = class_table()[points]
    at = np.arange(n)
    reset = np.empty(n, bool)
    reset[0] = True
    np.not_equal(kind[1:], kind[:-1], out=reset[1:])
    run = np.maximum.accumulate(np.where(reset, at, 0))  # scan of the composed transition functions
    starts = reset.copy()
    # white space before something else leaves its last character over: a blank goes to what follows, another stands alone
    first = np.flatnonzero(reset[1:] & (kind[:-1] == SPACE)) + 1
    last = first - 1
    starts[last] = True
    starts[first] = points[last] != 0x20
    # an apostrophe that begins a match, with one of the endings
    for i in np.flatnonzero((points == 0x27) & (run == at)).tolist():
        if i and points[i - 1] == 0x20:
            continue
        for ending in CONTRACTIONS:
            if text.startswith(ending, i + 1):
                starts[i + 1] = False
                if (end := i + 1 + len(ending)) < n:
                    starts[i + 2 : end] = False
                    starts[end] = True if kind[end] != SPACE else starts[end]
                break
    return np.flatnonzero(starts)


class Bpe:
    """Encoder and decoder by the ranks of a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        most = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * most
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(most)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The pair of lowest rank, the leftmost of equals, is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) >= HEAP_BYTES:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return tuple(ranks[x] for x in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked parts, so that a text without boundaries takes n log n."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] - i != size:
                continue  # one of the two has been merged since
            end[i], after[i], end[j] = end[j], after[j], 0
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]] - i))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i] - h))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i])

    def encode(self, text: str) -> tuple[list[int], np.ndarray, list[tuple[int, ...]]]:
        """(ids, start of each slice in code points, ids of each slice)."""
        starts = slice_starts(text)
        bounds = starts.tolist()
        pieces = [text[a:b] for a, b in zip(bounds, [*bounds[1:], len(text)])]
        cache, own = self.cache, {}
        for piece in set(pieces).difference(cache):
            ids = self.merge(piece.encode("utf-8"))
            (cache if len(piece) <= CACHE_CHARS else own)[piece] = ids
        if own:
            found = [own[x] if x in own else cache[x] for x in pieces]
        else:
            found = list(map(cache.__getitem__, pieces))
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return list(chain.from_iterable(found)), starts, found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Once in each Python worker."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, slice_start, slice_ids): per document its ids, and for each slice where it begins (code points)
    and at which id. A null text counts as empty; repeated rows are kept; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            firsts = [np.cumsum([0, *map(len, found)])[:-1].astype(np.int64) for _, _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([ids for ids, _, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s, _ in rows], pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "ids", "slice_start", "slice_ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frugal(run), f"doc_id {kind}, ids array<int>, slice_start array<bigint>, slice_ids array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the bytes of a table with doc_id and ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), f"doc_id {kind}, text binary").withColumn("text", F.col("text").cast("string"))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode() and of decode() of its ids, without moving the ids.

    A null or an empty text has no ids, and digests of nothing; a null doc_id stays null; repeated rows are kept, each with the same digests; of pairs of equal rank the leftmost is merged; a text may be as long as a row
    can be, also without any boundary (merging takes n log n); an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")[0]
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
