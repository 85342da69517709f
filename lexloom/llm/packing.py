"""Packing of tokenised documents into sequences of a fixed window.

Each document is cut at multiples of the window; what remains has 1 to window - 1 tokens, so that the histogram of the
remainders has fewer bins than the window however many documents there are. Shallow combinations of
two to five lengths that fill the window are enumerated; non-negative least squares gives how often each is to
be used so that together they use up the histogram; the counts are rounded down, and what they leave is packed
greedily: first by combinations that fill the window exactly, then end to end, cutting a document at each window's end.
Only the histogram reaches the driver; documents find their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, partitions

WINDOW = 4096
#: Words in each of the two generations of a worker's cache, and words encoded as one text.
CACHE_WORDS, GROUP_WORDS = 300_000, 128
#: ASCII marks that end a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Combinations enumerated of each depth, and rounds of the solver.
COMBINATIONS = {3: 24_000, 4: 24_000, 5: 12_000}
ROUNDS = 400
#: Documents that are cut at a window's end, up to which they are broadcast (24 bytes each); a shuffled join beyond it.
BROADCAST_ROWS = 200_000


# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """The ids of a tokenizers file whose pre-tokens never hold ASCII white space, through a cache of words."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = int(end_id).to_bytes(4, "little")
        self.cache: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are one pre-token each, so that many are encoded as one text and parted at the ends of words."""
        cache = self.cache
        texts = [w.decode("utf-8") for w in words]
        plain = [(w, t) for w, t in zip(words, texts) if t.isalpha()]
        others = [(w, t) for w, t in zip(words, texts) if not t.isalpha()]
        parts = [plain[i : i + GROUP_WORDS] for i in range(0, len(plain), GROUP_WORDS)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(t for _, t in part) for part in parts], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                cache.update(zip((w for w, _ in part), (raw[x:y] for x, y in zip([0, *ends], ends))))
            else:
                others += part
        for (word, _), got in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
            cache[word] = array("I", got.ids).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Letters or digits and the marks that end their word are pre-tokens of their own, so only stems are encoded."""
        cache, before = self.cache, self.before
        new, whole = {}, set()
        for w in set(words).difference(cache):
            if (known := before.get(w)) is not None:
                cache[w] = known
                continue
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem[-1:].isalnum() and b"<|" not in w:
                new[w] = stem
                whole.update((stem, w[len(stem) :]))
            else:
                whole.add(w)
        for w in whole.difference(cache):
            if (known := before.get(w)) is not None:
                cache[w] = known
        self._encode(list(whole.difference(cache)))
        for w, stem in new.items():
            cache[w] = cache[stem] + cache[w[len(stem) :]]

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids, the end id last."""
        # the file's normaliser lower-cases; its special tokens are matched before that
        words = (text if b"<|" in text else text.lower()).split()
        found = list(map(self.cache.get, words))
        if None in found:
            self.learn(words)
            found = list(map(self.cache.__getitem__, words))
            if len(self.cache) > CACHE_WORDS:
                self.before, self.cache = self.cache, {}  # what is still in use comes back
        found.append(self.end)
        return b"".join(found)


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """Once in each Python worker."""
    return WordTokenizer(path, end_id)


def token_counts(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """(doc_id, text_hash, n, crcs): tokens of each row with the end id, and the CRC-32 of each window of them.

    keep_words: whether a worker keeps the words it has seen for its next task, which saves time and takes some 100 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, end_id)
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                ids = own.ids(text or b"")
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "crcs"])
        if not keep_words:
            del own
            tokenizer.cache_clear()

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, text_hash long, n long, crcs array<bigint>")


def cut_digests(docs: DataFrame, cuts: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cuts (doc_id, text_hash, ..., start, length) with the CRC-32 of these slices of their documents' ids."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    wanted = cuts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("slices"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    hit = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])).select(texts["doc_id"], texts["text_hash"], "slices", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tokenizer(path, end_id)
            out = []
            for slices, text in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                ids = own.ids(text or b"")
                out.append([{"start": x["start"], "length": x["length"], "crc": zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])])} for x in slices])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "text_hash", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = hit.mapInArrow(frugal(run), f"doc_id {kind}, text_hash long, found array<struct<start:bigint,length:bigint,crc:bigint>>").dropDuplicates(["doc_id", "text_hash"])
    found = found.select("doc_id", "text_hash", F.inline("found"))
    at = [cuts["doc_id"].eqNullSafe(found["doc_id"]), *(cuts[c] == found[c] for c in ("text_hash", "start", "length"))]
    return cuts.join(found, at).select(*(cuts[c] for c in cuts.columns), found["crc"].alias("ids_crc32"))


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """For each length the ranks from 0 that combinations take: runs of (first rank, copies in a sequence, first
    sequence, offset of the first copy); ranks beyond the last run lie end to end from tail_start, sequences from n_sequences on."""

    window: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    taken: dict[int, int] = field(default_factory=dict)
    tail_start: dict[int, int] = field(default_factory=dict)
    n_sequences: int = 0
    tail_tokens: int = 0

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            self.runs.setdefault(length, []).append((self.taken.get(length, 0), copies, self.n_sequences, at))
            self.taken[length] = self.taken.get(length, 0) + copies * times
            at += copies * length
        self.n_sequences += times


def combinations(counts: np.ndarray, window: int, seed: int = 7) -> list[tuple[int, ...]]:
    """Combinations of two to five present lengths with the sum `window`: all pairs, and of the deeper ones a fixed number,
    drawn in proportion to the histogram."""
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    found = {(window - a, a) for a in present.tolist() if a <= window // 2 and counts[window - a] and (2 * a < window or counts[a] > 1)}
    rng = np.random.default_rng(seed)
    weight = np.cumsum(counts[present].astype(float))
    for depth, number in COMBINATIONS.items():
        drawn = present[np.searchsorted(weight, rng.random((number, depth - 1)) * weight[-1], side="right").clip(0, len(present) - 1)]
        rest = window - drawn.sum(1)
        ok = (rest > 0) & (counts[rest.clip(0, window - 1)] > 0)
        found.update(map(tuple, (-np.sort(-np.column_stack([drawn[ok], rest[ok]]), axis=1)).tolist()))
    return sorted(found, reverse=True)


def least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|^2 / counts, A the lengths in each combination: accelerated projected gradient."""
    rows = np.concatenate([np.array(c) for c in combos])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))
    forward = lambda x: np.bincount(rows, x[cols], len(counts)) * scale
    back = lambda r: np.bincount(cols, (r * scale)[rows], len(combos))
    # the largest eigenvalue by power iteration
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, target = 1 / (1.05 * norm), counts * scale
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def make_plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for counts[length] remainders of each length below the window."""
    plan, left = Plan(window), counts.astype(np.int64).copy()
    combos = combinations(left, window)
    if combos:
        repeats = np.floor(least_squares(combos, left.astype(float)) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable").tolist():
            if repeats[j] <= 0:
                break
            times = min(int(repeats[j]), min(int(left[a]) // combos[j].count(a) for a in set(combos[j])))
            if times > 0:
                plan.use(combos[j], times)
                for a in combos[j]:
                    left[a] -= times
    # greedily: the longest length, filled up by the longest that still fits
    tail = np.zeros_like(left)
    present = sum(1 << int(a) for a in np.flatnonzero(left))
    while present:
        taken: dict[int, int] = {}
        gap, mask = window, present
        while gap and (fits := mask & ((1 << (gap + 1)) - 1)):
            a = fits.bit_length() - 1
            k = min(gap // a, int(left[a]))
            taken[a] = k
            gap -= a * k
            mask &= ~(1 << a)
        times = min(int(left[a]) // k for a, k in taken.items())
        if gap:  # nothing fills this window up; its longest length is laid end to end below
            a = max(taken)
            tail[a] += left[a]
            left[a] = 0
        else:
            plan.use(tuple(a for a, k in taken.items() for _ in range(k)), times)
            for a, k in taken.items():
                left[a] -= k * times
        for a in taken:
            if not left[a]:
                present &= ~(1 << a)
    for a in np.flatnonzero(tail)[::-1].tolist():
        plan.tail_start[a] = plan.tail_tokens
        plan.tail_tokens += int(tail[a]) * a
    return plan


# ---------------------------------------------------------------- pieces


def _placed(plan: Plan):
    """Adds (sequence_id, offset, stream) to remainders; stream: where one that lies in the tail begins there, else null."""
    runs = {a: np.array(r, np.int64) for a, r in plan.runs.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            sequence, offset, stream = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
            for a in np.unique(length).tolist():
                own = np.flatnonzero(length == a)
                k, taken = rank[own], plan.taken.get(a, 0)
                late = k >= taken
                stream[own[late]] = plan.tail_start.get(a, 0) + (k[late] - taken) * a
                if not late.all():
                    r = runs[a]
                    k, at = k[~late], own[~late]
                    j = np.searchsorted(r[:, 0], k, side="right") - 1
                    sequence[at] = r[j, 2] + (k - r[j, 0]) // r[j, 1]
                    offset[at] = r[j, 3] + (k - r[j, 0]) % r[j, 1] * a
            yield rows.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset, stream=stream)

    return run


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is tokenised as it stands (null text: empty, which is the end id alone); repeated rows and repeated or
    null doc_ids are separate documents; a text may be as long as a row can be, and is cut into as many pieces as it takes; documents of equal length are packed in any
    order; other columns are ignored, whatever their names; an empty table gives no pieces. Sequences are
    numbered from 0 without gaps; only the last one that lies end to end can be shorter than the window.
    """
    spark = docs.sparkSession
    counted = materialize(token_counts(docs, path, end_id, window, id_col, text_col, keep_words).withColumn("rid", F.monotonically_increasing_id()), "pack-counts")
    rest = F.col("n") % window
    histogram = np.zeros(window, np.int64)
    for r in counted.where(rest > 0).groupBy(rest.alias("a")).count().collect():  # one row a length, fewer than the window
        histogram[r["a"]] = r["count"]
    plan = make_plan(histogram, window)
    tail_sequences = -(-plan.tail_tokens // window)
    full_base = plan.n_sequences + tail_sequences

    # ranks within a length and the number of full windows before, in buckets so that no length is one task's work
    bucket = F.pmod(F.xxhash64("rid"), F.lit(max(64, partitions(spark)))).cast("int").alias("bucket")
    rows = counted.select("*", bucket, rest.alias("a"), F.floor(F.col("n") / window).alias("full"))
    sums = rows.groupBy("a", "bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("full").alias("f"))
    before = Window.partitionBy("a").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums, "pack-sums")
    ranks = sums.select("a", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rank0"))
    per_bucket = sums.groupBy("bucket").agg(F.sum("f").alias("f"))  # a row a bucket
    fulls = per_bucket.select("bucket", F.coalesce(F.sum("f").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full0"))
    inside = Window.partitionBy("bucket").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.select("*", F.coalesce(F.sum("full").over(inside), F.lit(0)).alias("full_in")).select("*", (F.row_number().over(Window.partitionBy("bucket", "a").orderBy("rid")) - 1).alias("rank_in"))
    ranked = ranked.join(ranks, ["a", "bucket"]).join(fulls, "bucket")
    ranked = materialize(ranked.select("doc_id", "text_hash", "n", "crcs", "a", "full", (F.col("rank0") + F.col("rank_in")).alias("rank"), (F.col("full0") + F.col("full_in") + full_base).alias("first_full")), "pack-ranked")

    whole = ranked.where("full > 0").select("doc_id", "n", "first_full", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("i", "crc"))
    whole = whole.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    kind = docs.schema[id_col].dataType.simpleString()
    ends = ranked.where("a > 0").select("doc_id", "text_hash", "n", (F.col("full") * window).cast("long").alias("start"), F.col("a").cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("rank").cast("long").alias("rank"))
    placed = ends.mapInPandas(_placed(plan), f"doc_id {kind}, text_hash long, n long, start long, length long, ids_crc32 long, sequence_id long, offset long, stream long")
    placed = materialize(placed, "pack-placed")
    sequence, offset = F.floor(F.col("stream") / window) + plan.n_sequences, F.col("stream") % window
    fits = (F.col("stream") < 0) | (offset + F.col("length") <= window)
    kept = placed.where(fits).select("doc_id", "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), F.when(F.col("stream") < 0, F.col("sequence_id")).otherwise(sequence).alias("sequence_id"), F.when(F.col("stream") < 0, F.col("offset")).otherwise(offset).alias("offset"))

    head = (window - offset).alias("head")
    over = placed.where(~fits).select("doc_id", "text_hash", "n", "start", "length", head, sequence.alias("sequence_id"), offset.alias("offset"))
    parts = F.array(
        F.struct("start", F.col("head").alias("length"), "sequence_id", "offset"),
        F.struct((F.col("start") + F.col("head")).alias("start"), (F.col("length") - F.col("head")).alias("length"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )
    cuts = over.select("doc_id", "text_hash", "n", F.inline(parts))
    if plan.tail_tokens > window:
        cuts = cut_digests(docs, materialize(cuts, "pack-cuts"), path, end_id, id_col, text_col)
        cuts = cuts.select("doc_id", "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
        kept = kept.unionByName(cuts)
    return whole.unionByName(kept)
