"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints at most 3 bits apart differ in at most
one bit in one of the halves, so enumerating the Hamming ball of radius 1 around each half and looking the values up
in the table of that half finds every such pair; the complete distance is then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize
from .graph import connected_components, forest

#: Rows of one key beyond which its comparisons are dealt to several tasks as tiles.
HOT_KEY_ROWS = 8192
TILE_ROWS = 4096


def shingle_digests(text: bytes | None, words_per_shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles (A-Z lower-cased), repeats included, some at a time.

    Fewer words than a shingle takes are one shingle; without words there is none. None counts as empty.
    """
    words = (text or b"").lower().split()
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    h = xxhash.xxh64_intdigest
    if n == 1:
        yield np.array([h(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 16):
        yield np.array([h(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype=np.uint64)


def _majority(digests: Iterator[np.ndarray], words: int) -> list[int]:
    """A bit is 1 if it is set in more than half of the digests; words after the first are of the digests mixed anew."""
    counts, n = np.zeros((words, 64), np.int64), 0
    for d in digests:
        n += len(d)
        for k in range(words):
            if k:
                d = (d ^ (d >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                d ^= d >> np.uint64(29)
            counts[k] += np.unpackbits(d.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(c * 2 > n).tobytes(), "big") for c in counts]


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    return _majority(shingle_digests(text, words_per_shingle, seed), 1)[0]


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words_per_shingle, seed) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frugal(run), f"doc_id {kind}, fp long")


def _linked(table: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between the rows of table, and from them to near, as stars."""
    a = b = np.empty(0, np.int64)
    both = np.concatenate([table, near])
    step = max(1, (1 << 20) // max(1, len(both)))
    for i in range(0, len(table), step):
        x = table[i : i + step]
        r, c = np.nonzero(np.bitwise_count((x[:, None] ^ both[None, :]).view(np.uint64)) <= most)
        keep = x[r] != both[c]
        if keep.any():
            a, b = forest(np.concatenate([a, x[r[keep]]]), np.concatenate([b, both[c[keep]]]))
    return a, b


def _runs(most: int):
    """Verifies all keys of a bucket at once: small runs by shifted comparison, others by blocks."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates()
        key, tile = rows["key"].to_numpy(), rows["tile"].to_numpy()
        fp, exact = rows["fp"].to_numpy(), rows["exact"].to_numpy()
        order = np.lexsort((fp, ~exact, tile, key))
        key, tile, fp, exact = key[order], tile[order], fp[order], exact[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        found_a, found_b = [], []
        for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            m = int(exact[at : at + n].sum())  # those whose own segment is the key come first
            if m:
                a, b = _linked(fp[at : at + m], fp[at + m : at + n], most)
                found_a.append(a)
                found_b.append(b)
        if not found_a:
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
        return pd.DataFrame({"u": a, "v": b})

    return verify


def hamming_links(fps: DataFrame, most: int = 3, hot_rows: int = HOT_KEY_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp: long) at most `most` (<= 3) bits apart.

    Not every pair is returned, but the returned pairs have the same components. A pair in which a half differs by one
    bit is sought from the side whose bit is 0 only. Keys with more than hot_rows rows are cut into
    tiles of tile_rows, and each pair of tiles is a task's group of its own; no pair is left out.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments of radius 1 find distances up to 3")
    halves = F.array(*(F.struct(F.lit(s).cast("long").alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")) for s in (0, 1)))
    own = fps.select("fp", F.inline(halves)).select("fp", "seg", "half")
    tag = F.shiftleft("seg", 32)
    flips = F.filter(F.expr("transform(sequence(0, 31), i -> shiftleft(1L, i))"), lambda bit: F.col("half").bitwiseAND(bit) == 0)
    keys = own.select("fp", tag.bitwiseOR(F.col("half")).alias("key"), F.lit(True).alias("exact"))
    balls = own.select("fp", "seg", "half", F.explode(flips).alias("bit")).select("fp", tag.bitwiseOR(F.col("half")).bitwiseOR(F.col("bit")).alias("key"), F.lit(False).alias("exact"))
    # only values that are in the table can match: the rest of each ball goes before anything is gathered
    balls = balls.join(keys.select("key").distinct(), "key", "left_semi").select("fp", "key", "exact")
    rows = materialize(keys.unionByName(balls), "simhash-keys")
    crowd = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("m")).where("n > 1 and m > 0")
    rows = rows.join(crowd, "key")
    quiet = rows.where(F.col("n") <= hot_rows).select("key", F.lit(0).cast("long").alias("tile"), "fp", "exact")
    tiles = F.ceil(F.col("n") / tile_rows).cast("long")
    mine = F.pmod(F.xxhash64("fp"), tiles)
    # a tile meets each other tile once: group (i, j), i <= j
    hot = rows.where(F.col("n") > hot_rows).select("key", "fp", "exact", tiles.alias("k"), mine.alias("i"))
    hot = hot.select("key", "fp", "exact", "k", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    hot = hot.select("key", (F.least("i", "j") * F.col("k") + F.greatest("i", "j") + 1).alias("tile"), "fp", "exact")
    buckets = quiet.unionByName(hot).withColumn("bucket", F.pmod(F.xxhash64("key", "tile"), F.lit(_buckets(fps))))
    return buckets.groupBy("bucket").applyInPandas(lambda rows: _runs(most)(rows[["key", "tile", "fp", "exact"]]), "u long, v long")


def _buckets(df: DataFrame) -> int:
    return 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def simhash_groups(docs: DataFrame, words_per_shingle: int = 3, most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most `most` bits.

    Rows that repeat a doc_id are kept and each has its own fingerprint; empty tables give no rows; null and
    wordless texts have the fingerprint zero, which links like any other; columns besides the two named are ignored. A null
    doc_id is kept: its row has its fingerprint's component. A very long text has the fingerprint of all its shingles; a bit that just half of them have is 0.
    """
    fps = materialize(fingerprints(docs, words_per_shingle, seed, id_col, text_col), "simhash-fps")
    each = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-each")
    links = connected_components(hamming_links(each.select("fp"), most), "simhash")
    class_of = each.join(links, each["fp"] == links["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    class_of = materialize(class_of, "simhash-class")
    lowest = class_of.groupBy("class").agg(F.min("least").alias("component_id"))
    named = materialize(class_of.join(lowest, "class").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- by similarity

#: Chance with which a pair of just the wanted similarity is to be a candidate, at least.
CHANCE = 0.99
#: Standard deviations by which a pair's distance may lie above the mean before its shingles are left uncompared: of the whole fingerprint, and of the one word of it that
#: goes with each ball.
SPREAD, WORD_SPREAD = 6, 4
#: Bits of a segment beyond the logarithm of the number of documents, so that chance matches grow in proportion to these; documents whose balls are made at a time.
MORE_BITS, BALL_ROWS = 3, 2_048
#: Ball entries of a bucket; rows of a key up to which all its pairs are compared at once; sets of a tile of a crowd.
BUCKET_ENTRIES, SMALL_KEY, CROWD_TILE = 1 << 18, 16, 512
#: Documents whose shingles a worker sends on at a time.
SET_ROWS = 128
#: Rows that go, up to which their keys are broadcast (16 bytes each); a shuffled join beyond it.
BROADCAST_ROWS = 1_000_000


def bit_chance(similarity: float) -> float:
    """The chance that a bit of the fingerprints of two sets of this Jaccard similarity differs: their angle as a part of the half circle."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, bits: int, spread: float = SPREAD) -> int:
    """The bits in which two fingerprints may differ: so many standard deviations above the mean at this similarity."""
    p = bit_chance(similarity)
    return int(bits * p + spread * math.sqrt(bits * p * (1 - p)))


class Index(NamedTuple):
    """Segments and their bits; 64-bit words of a fingerprint."""

    segments: int
    bits: int
    words: int


def index_for(n: int, similarity: float, chance: float = CHANCE) -> Index:
    """The index for n documents: segments a few bits wider than the logarithm of n, and as many as it takes for a pair of this similarity to differ in at most
    two bits of one of them with the wanted chance."""
    bits = min(max(16, math.ceil(math.log2(max(n, 2))) + MORE_BITS), 56)
    p = bit_chance(similarity)
    near = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    segments = max(1, math.ceil(math.log(1 - chance) / math.log(1 - near))) if near < 1 else 1
    return Index(segments, bits, -(-segments * bits // 64))


def shingle_set(text: bytes | None, words_per_shingle: int, seed: int) -> np.ndarray:
    """The sorted distinct digests of the text's shingles."""
    parts = list(shingle_digests(text, words_per_shingle, seed))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def segment_values(f: np.ndarray, index: Index) -> np.ndarray:
    """The segments of fingerprints f (rows of words), one column each."""
    out, mask = np.empty((len(f), index.segments), np.uint64), np.uint64((1 << index.bits) - 1)
    for j in range(index.segments):
        word, at = divmod(j * index.bits, 64)
        value = f[:, word] >> np.uint64(at)
        if at + index.bits > 64:
            value = value | f[:, word + 1] << np.uint64(64 - at)
        out[:, j] = value & mask
    return out


def _features(words_per_shingle: int, seed: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, size, wide = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                x = shingle_set(text, words_per_shingle, seed)
                uid.append(xxhash.xxh3_64_intdigest(x.tobytes()))
                size.append(len(x))
                wide.append(_majority((x[i : i + (1 << 16)] for i in range(0, len(x), 1 << 16)), words))
            prints = pa.array(list(np.array(wide, np.uint64).view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(uid, np.uint64).view(np.int64)), pa.array(size, pa.int64()), prints], ["doc_id", "th", "uid", "m", "f"])

    return run


def _balls(index: Index, buckets: int):
    """(bucket, key, uid, word): the balls of radius 1 around all segments of each fingerprint (uid, f), packed by bucket of the key, each entry with a word of the fingerprint that
    the segment isn't from (as far as there is one). Two segments at most 2 bits apart have a value in both their balls."""
    flips = np.concatenate([[0], 1 << np.arange(index.bits)]).astype(np.uint64)
    tags = (np.arange(index.segments) << index.bits).astype(np.uint64)
    other = [(j * index.bits // 64 + 2) % index.words for j in range(index.segments)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, index.words)
            for i in range(0, len(uids), BALL_ROWS):
                f, uid = prints[i : i + BALL_ROWS], uids[i : i + BALL_ROWS]
                key = ((segment_values(f, index)[:, :, None] ^ flips) | tags[None, :, None]).reshape(-1)
                owner = np.repeat(np.arange(len(uid)), index.segments * len(flips))
                word = np.broadcast_to(f[:, other][:, :, None], (len(f), index.segments, len(flips))).reshape(-1)
                bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, order[x:y]) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:])) if y > x]
                packed = [pa.array([np.ascontiguousarray(v[at]).tobytes() for _, at in rows], pa.binary()) for v in (key, uid[owner], word)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *packed], ["bucket", "key", "uid", "word"])

    return run


def _meet(limit: int, small: int):
    """(u, v, hot): pairs with a common key whose words are near. Of small keys all; of the crowded keys (hot) stars that connect what all their near pairs would connect: each
    row meets one of its key, and what isn't near that one all others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, uid, word = (np.frombuffer(b"".join(rows[x]), np.uint64 if x == "word" else np.int64) for x in ("key", "uid", "word"))
        order = np.lexsort((uid, key))
        key, uid, word = key[order], uid[order], word[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        found = [np.empty((0, 3), np.int64)]

        def put(a: np.ndarray, b: np.ndarray, hot: int) -> None:
            found.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), hot)]), axis=0))

        near = lambda a, b: (np.bitwise_count(word[a] ^ word[b]) <= limit) & (uid[a] != uid[b])
        left = np.repeat(first + size, size) - np.arange(len(key))  # rows of the key from this one on
        at = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
        for d in range(1, small):
            at = at[left[at] > d]
            if not len(at):
                break
            some = at[near(at, at + d)]
            put(uid[some], uid[some + d], 0)
        x = y = np.empty(0, np.int64)
        for a, n in zip(first[size > small].tolist(), size[size > small].tolist()):
            own = np.arange(a, a + n)
            # the row with the least mixed uid, so that keys of the same crowd have the same few centres
            centre = np.full(n, a + int((uid[own].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).argmin()))
            close = near(own, centre)
            x, y = forest(np.concatenate([x, uid[own[close]]]), np.concatenate([y, uid[centre[close]]]))
            odd = own[~close]
            for i in range(0, len(odd), 256):
                some = odd[i : i + 256]
                r, c = np.nonzero((np.bitwise_count(word[some, None] ^ word[None, a : a + n]) <= limit) & (uid[some, None] != uid[None, a : a + n]))
                x, y = forest(np.concatenate([x, uid[some[r]]]), np.concatenate([y, uid[a + c]]))
        put(x, y, 1)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "hot": pairs[:, 2].astype(bool)})

    return run


def _exact(similarity: float, columns: int = 4_096):
    """The links between the sets (uid, c, s) of a tile as stars, between different components c only: numbers of common shingles as products of matrices."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("uid")
        uid, c, n = rows["uid"].to_numpy(), rows["c"].to_numpy(), len(rows)
        size = np.array([len(x) for x in rows["s"]], np.int64)
        owner = np.repeat(np.arange(n), size)
        _, column, times = np.unique(np.concatenate([np.empty(0, np.int64), *rows["s"]]), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # what one set only has is in no intersection
        keep = times[column] > 1
        owner, column = owner[keep], shared[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        last = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, last, columns):
            a, b = np.searchsorted(column, [lo, lo + columns])
            x = np.zeros((n, min(columns, last - lo)), np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            common += x @ x.T
        alike = common >= similarity * (size[:, None] + size[None, :] - common)
        r, k = np.nonzero(np.triu(alike & (c[:, None] != c[None, :]), 1))
        u, v = forest(uid[r], uid[k])
        return pd.DataFrame({"u": u, "v": v})

    return run


def _sets(words_per_shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SET_ROWS):
                found = [shingle_set(x, words_per_shingle, seed) for x in batch.column(0).slice(i, SET_ROWS).cast(pa.binary()).to_pylist()]
                uid = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["uid", "s"])

    return run


def _shingles_of(uids: DataFrame, each: DataFrame, docs: DataFrame, words_per_shingle: int, seed: int) -> DataFrame:
    """(uid, s): the sets of these (uid), made anew from one text each."""
    texts = materialize(each.join(uids, "uid", "left_semi").select(F.col("th").alias("g_th")), "simhash-compared")
    wanted = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("_th")).join(wanted, F.col("_th").eqNullSafe(F.col("g_th")), "left_semi").select("text")
    sets = materialize(rows.mapInArrow(frugal(_sets(words_per_shingle, seed)), "uid long, s array<bigint>").dropDuplicates(["uid"]), "simhash-sets")
    discard(texts)
    return sets


def _alike(pairs: DataFrame, each: DataFrame, docs: DataFrame, words_per_shingle: int, similarity: float, seed: int) -> DataFrame:
    """Of the pairs (u, v) those whose sets of shingles have at least this Jaccard similarity."""
    need = pairs.select(F.col("u").alias("uid")).unionByName(pairs.select(F.col("v").alias("uid"))).distinct()
    sets = _shingles_of(need, each, docs, words_per_shingle, seed)
    both = pairs.join(sets.select(F.col("uid").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("uid").alias("v"), F.col("s").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("m"))
    out = materialize(both.where(F.col("n") >= F.lit(similarity) * (F.col("m") - F.col("n"))).select("u", "v"), "simhash-alike")
    discard(sets)
    return out


def similar_links(each: DataFrame, docs: DataFrame, index: Index, words_per_shingle: int, similarity: float, seed: int) -> DataFrame:
    """(node, component) of the sets (each: uid, th, m: their size, f: their fingerprint) that links of at least this Jaccard similarity connect.

    Multi-index hashing: the balls of radius 1 around each segment of both fingerprints meet where the segments are at most 2 bits apart. Pairs that meet are verified by the
    complete distance and then by their shingles. Of a key that very many sets share first each is compared with one of them; crowds that this hasn't connected are
    compared exactly in tiles of sets, which return links as stars, so that no pair of a large group is a row.
    """
    n = each.count()
    buckets = max(16, -(-n * index.segments * (index.bits + 1) // BUCKET_ENTRIES))
    limit = most_bits(similarity, 64, WORD_SPREAD)
    balls = each.select("uid", "f").mapInArrow(_balls(index, buckets), "bucket int, key binary, uid binary, word binary")
    met = balls.groupBy("bucket").applyInPandas(_meet(limit, SMALL_KEY), "u long, v long, hot boolean")
    met = materialize(met.groupBy("u", "v").agg(F.max("hot").alias("hot")), "simhash-met")
    wide = lambda x: each.select(F.col("uid").alias(x), F.col("m").alias(f"m_{x}"), F.col("f").alias(f"f_{x}"))
    differing = sum((F.bit_count(F.get("f_u", F.lit(i)).bitwiseXOR(F.get("f_v", F.lit(i)))) for i in range(index.words)), F.lit(0))
    # the smaller set can't be less than this part of the larger
    sized = F.least("m_u", "m_v") >= F.lit(similarity) * F.greatest("m_u", "m_v")
    crowds = connected_components(met.where("hot").select("u", "v"), "simhash-crowds").select(F.col("node").alias("uid"), F.col("component").alias("crowd"))
    crowds = materialize(crowds, "simhash-crowds")
    # the near pairs of small keys, and each set of a crowd with one of it; pairs inside a crowd wait: either these connect it, or its tiles compare all of it
    own = lambda x: crowds.select(F.col("uid").alias(x), F.col("crowd").alias(f"crowd_{x}"))
    outside = met.where("not hot").select("u", "v").join(own("u"), "u", "left").join(own("v"), "v", "left").where("crowd_u is null or crowd_v is null or crowd_u <> crowd_v").select("u", "v")
    wanted = outside.unionByName(crowds.where("uid <> crowd").select(F.least("uid", "crowd").alias("u"), F.greatest("uid", "crowd").alias("v"))).distinct()
    near = wanted.join(wide("u"), "u").join(wide("v"), "v").where(sized & (differing <= most_bits(similarity, 64 * index.words))).select("u", "v")
    near = materialize(near, "simhash-pairs")
    links = _alike(near, each, docs, words_per_shingle, similarity, seed)
    joined = materialize(connected_components(links, "simhash-stars"), "simhash-stars")
    # crowds, as far as the links so far don't connect them: a crowd's tiles of sets are compared with one another
    crowds = materialize(crowds.join(joined, crowds["uid"] == joined["node"], "left").select("uid", "crowd", F.coalesce("component", "uid").alias("c")), "simhash-crowds")
    mixed = crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("crowd", F.ceil(F.col("n") / CROWD_TILE).cast("long").alias("k"))
    crowds = materialize(crowds.join(mixed, "crowd"), "simhash-mixed")
    if crowds.isEmpty():
        discard(met, near)
        return joined
    sets = _shingles_of(crowds.select("uid"), each, docs, words_per_shingle, seed)
    # a tile meets each other tile once: group (i, j), i <= j
    rows = crowds.join(sets, "uid").select("uid", "crowd", "c", "s", "k", F.pmod(F.xxhash64("uid"), F.col("k")).alias("i"))
    rows = rows.select("uid", "crowd", "c", "s", "k", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    rows = rows.select("uid", "crowd", "c", "s", (F.least("i", "j") * F.col("k") + F.greatest("i", "j")).alias("tile"))
    more = materialize(rows.groupBy("crowd", "tile").applyInPandas(lambda x: _exact(similarity)(x[["uid", "c", "s"]]), "u long, v long"), "simhash-more")
    out = joined if more.isEmpty() else connected_components(links.unionByName(more), "simhash-wide")
    discard(met, near, crowds, sets)
    return out


def similar_groups(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, th, class): th is the XXH64 of the text; rows of a class are linked by texts whose sets of shingles have at least
    the Jaccard similarity `similarity` (0.8 or more). Linked pairs are compared exactly; a pair of just this similarity is a candidate with a chance of CHANCE, a more similar one with a greater one.

    Rows that repeat a doc_id or a text are kept; texts that are null or without words are one class; texts of any length are taken whole; a null doc_id is kept;
    columns besides the two are ignored, whatever their names; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    index = index_for(docs.count(), similarity)
    fps = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(frugal(_features(words_per_shingle, seed, index.words)), f"doc_id {kind}, th long, uid long, m long, f array<bigint>")
    fps = materialize(fps, "simhash-wide")
    each = materialize(fps.groupBy("uid").agg(F.min("th").alias("th"), F.first("m").alias("m"), F.first("f").alias("f")), "simhash-wide-each")
    links = similar_links(each, docs, index, words_per_shingle, similarity, seed)
    named = materialize(each.select("uid").join(links, each["uid"] == links["node"], "left").select("uid", F.coalesce("component", "uid").alias("class")), "simhash-wide-class")
    return fps.select("doc_id", "th", "uid").join(named, "uid").select("doc_id", "th", "class")


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest (doc_id, text hash), nulls last; all columns stay.

    Of equal rows one stays. Texts that are null, or without words, are one group. Null doc_ids, very long texts, other columns of any name and an empty table as in
    similar_groups(). Texts are not shuffled unless very many rows go.
    """
    groups = materialize(similar_groups(docs, words_per_shingle, similarity, seed), "simhash-groups")
    rank = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "th")
    # what stays is looked up by document, so that a large class meets nowhere but in partial minima
    first = groups.groupBy("class").agg(F.min(rank).alias("first")).select(F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"))
    each = groups.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(first, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "n", F.col("f_th").isNotNull().alias("stays"))
    each = materialize(each.where("n > 1 or not stays"), "simhash-gone")
    gone, twice = each.select("g_id", "g_th"), each.where("stays").select("g_id", "g_th")
    if each.count() <= BROADCAST_ROWS:
        gone, twice = F.broadcast(gone), F.broadcast(twice)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_th") == F.col("g_th"))
    rest = rows.join(gone, same, "left_anti")
    # of a repeated row that stays, one copy
    again = rows.join(twice, same, "left_semi").dropDuplicates(["_id", "_th"])
    return rest.unionByName(again).select("_row.*")
