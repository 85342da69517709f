"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are UTF-8 bytes and its order is 5, so that an n-gram is an exact integer key whatever the language.
Interpolated probabilities factor into terms that n-grams have on their own: with
    delta(w_1..w_n) = log p(w_n | w_1..w_n-1) - log gamma(w_1..w_n-1) - log p(w_n | w_2..w_n-1)
for seen n-grams (0 otherwise) and log gamma of seen contexts (0 otherwise), the logarithm of a probability is the sum of the delta of all
suffixes of its n-gram and of the log gamma of all suffixes of its context, the empty one with the uniform distribution included. So each n-gram is looked up independently, which makes
scoring an equi-join of counts that is sharded by n-gram: texts are read in chunks; a chunk asks each shard of the model
for its distinct n-grams, and the answers go back to the chunk, which sums them by document.

Thresholds are quantiles of the perplexities of trusted documents that were held out, for each language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

ORDER = 5
#: Bytes of text in a chunk, n-grams that a shard of the model is meant to hold, and bytes of text whose chunks share a copy of a shard: a chunk asks
#: a shard for some 50 kB at most, so that a task that answers reads some 25 MB whatever the size of the corpus.
CHUNK_BYTES, SHARD_NGRAMS, PART_BYTES = 8 << 20, 65_536, 4 << 30
#: One in so many trusted documents is held out for the thresholds, which are this quantile.
FOLDS, QUANTILE = 5, 0.995
#: Trusted doc_ids up to which they are broadcast (8 bytes each); a shuffled join beyond it.
BROADCAST_IDS = 2_000_000
#: Entries up to which n-gram numbers come from a direct table.
TABLE = 1 << 25
_TAG = 40


# ---------------------------------------------------------------- chunks


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows (doc_id, lang, text as binary) with at most CHUNK_BYTES of text, or one longer row."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for i, n in enumerate(pc.binary_length(batch.column(2)).fill_null(0).to_pylist()):
            if size and size + n > CHUNK_BYTES:
                held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i
            size += n
        held.append(batch.slice(at))
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


class Ngrams:
    """The n-grams of a chunk's texts: the distinct keys of order 5, and the number of the one that ends at each byte."""

    def __init__(self, table: pa.Table):
        texts = [x or b"" for x in table.column(2).to_pylist()]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        pad = bytes(ORDER - 1)
        data = np.frombuffer(pad + pad.join(texts), np.uint8)
        ends = np.cumsum(self.lengths + (ORDER - 1))
        inside = np.ones(len(data), bool)
        for k in range(ORDER - 1):
            starts = ends - self.lengths - 1 - k
            inside[starts] = False
        # the number of the n-gram that ends at each byte, order by order
        symbols = np.flatnonzero(np.bincount(data, minlength=256))
        dense = np.zeros(256, np.int32)
        dense[symbols] = np.arange(len(symbols))
        sym = dense[data]
        number, keys = sym, symbols.astype(np.int64)
        for _ in range(ORDER - 1):
            entries = len(keys) * len(symbols)
            code = np.empty(len(sym), np.int32 if entries < 1 << 31 else np.int64)
            np.multiply(number[:-1], len(symbols), out=code[1:], casting="unsafe", dtype=code.dtype)
            code[:1] = 0
            code += sym
            if entries <= TABLE:
                there = np.zeros(entries, bool)
                there[code] = True
                codes = np.flatnonzero(there)
                number = (np.cumsum(there, dtype=np.int32) - np.int32(1))[code]
            else:
                codes, number = np.unique(code, return_inverse=True)
            keys = keys[codes // len(symbols)] << 8 | symbols[codes % len(symbols)]
        number = number[inside]
        seen = np.bincount(number, minlength=len(keys))
        kept = np.flatnonzero(seen)  # without those that end in padding
        index = np.zeros(len(keys), np.int64)
        index[kept] = np.arange(len(kept))
        self.keys, self.counts, self.number = keys[kept], seen[kept], index[number]

    def requests(self) -> np.ndarray:
        """Sorted tagged keys of all that the chunk's probabilities depend on."""
        parts = [np.zeros(1, np.int64), self.keys | ORDER << _TAG]
        for n in range(ORDER - 1, 0, -1):
            mask = (1 << 8 * n) - 1
            parts.append(np.unique(np.concatenate([self.keys & mask, self.keys >> 8 & mask])) | n << _TAG)
        return np.sort(np.concatenate(parts))

    def sums(self, wanted: np.ndarray, delta: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """The log-probability of each document, from the answers to the requests."""
        total = np.full(len(self.keys), gamma[0])
        for n in range(1, ORDER + 1):
            total += delta[np.searchsorted(wanted, self.keys & ((1 << 8 * n) - 1) | n << _TAG)]
            if n < ORDER:
                total += gamma[np.searchsorted(wanted, self.keys >> 8 & ((1 << 8 * n) - 1) | n << _TAG)]
        full = np.flatnonzero(self.lengths)
        out = np.zeros(len(self.lengths))
        if len(full):
            out[full] = np.add.reduceat(total[self.number], (np.cumsum(self.lengths) - self.lengths)[full])
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress well."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


def _chunk_id(table: pa.Table) -> int:
    """Of what the chunk holds; equal chunks get equal answers."""
    h = xxhash.xxh3_64(repr(table.column(0).to_pylist()).encode())
    for text in table.column(2).to_pylist():
        h.update(b"\0" if text is None else text)
        h.update(b"\1")
    return int(np.uint64(h.intdigest()).astype(np.int64))


# ---------------------------------------------------------------- model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches):
        own = Ngrams(table)
        for i in range(0, len(own.keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(own.keys[i : i + (1 << 16)]), pa.array(own.counts[i : i + (1 << 16)].astype(np.int64))], ["key", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and 3 or more (Chen and Goodman); 0.5, 1 and 1.5 where the counts of counts don't give any."""
    out = []
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and y else k / 2
        out.append(d if 0 < d < k else k / 2)
    return tuple(out)


def train(texts: DataFrame) -> DataFrame:
    """The model from texts (doc_id, lang, text): (key, delta, gamma), keys tagged with their order; empty without text.

    Counts are sums over chunks, continuation counts of an order are counts of the distinct n-grams of the next; both are partial aggregates
    by n-gram. Probabilities join each order with its contexts and with the order below.
    """
    level = materialize(texts.mapInArrow(_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "kn-counts")
    levels = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialize(levels[n + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    below, model, contexts, spent = None, [], {}, list(levels.values())
    for n in range(1, ORDER + 1):
        c = F.col("c")
        of = levels[n].agg(*(F.count_if(c == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()  # one row
        d = discounts(*of)
        less = F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        ctx = F.shiftright("key", 8)
        stats = levels[n].groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("s"), F.sum(less).alias("free"))
        stats = stats.select("ctx", "s", (F.col("free") / F.col("s")).alias("g"))
        rows = levels[n].select("key", "c", ctx.alias("ctx"), less.alias("less")).join(stats, "ctx")
        own = (F.col("c") - F.col("less")) / F.col("s")
        if n == 1:
            p, base = own + F.col("g") / 256, F.log(F.col("g") / 256)
            rows = rows.select("key", p.alias("p"), (F.log(p) - base).alias("delta"))
            contexts[0] = stats.select(F.col("ctx").alias("key"), base.alias("gamma"))  # one row, key 0
        else:
            low = below.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(low, "suffix")
            p = own + F.col("g") * F.col("q")
            rows = rows.select("key", p.alias("p"), (F.log(p) - F.log(F.col("g") * F.col("q"))).alias("delta"))
            contexts[n - 1] = stats.select(F.col("ctx").bitwiseOR(F.lit(n - 1 << _TAG)).alias("key"), F.log("g").alias("gamma"))
        below = materialize(rows, "kn-level")
        spent.append(below)
        model.append(below.select(F.col("key").bitwiseOR(F.lit(n << _TAG)).alias("key"), F.col("delta").cast("float").alias("delta")))
    deltas, gammas = model[0], contexts[0]
    for n in range(1, ORDER):
        deltas, gammas = deltas.unionByName(model[n]), gammas.unionByName(contexts[n])
    # a context that no n-gram ends with (a text's beginning) has a gamma only
    both = deltas.join(gammas, "key", "full_outer").select("key", F.coalesce("delta", F.lit(0.0)).cast("float").alias("delta"), F.coalesce("gamma", F.lit(0.0)).cast("float").alias("gamma"))
    out = materialize(both, "kn-model")
    discard(*spent)
    return out


# ---------------------------------------------------------------- scores


def _ask(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            wanted = Ngrams(table).requests()
            chunk, where = _chunk_id(table), shard_of(wanted, shards)
            rows = [(s, _pack(np.diff(own, prepend=0))) for s in range(shards) if len(own := wanted[where == s])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["shard", "chunk", "keys"])

    return run


def _answer(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a group the shard's delta and gamma, in the order of its keys."""
    model = model.sort_values("key")
    keys = model["key"].to_numpy(np.int64)
    delta, gamma = (np.append(model[c].to_numpy(np.float32), np.float32(0)) for c in ("delta", "gamma"))
    out = []
    for packed in asked["keys"]:
        wanted = np.cumsum(_unpack(packed, "<i8"))
        at = np.searchsorted(keys, wanted).clip(0, max(0, len(keys) - 1))
        at = np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), np.int64)
        out.append(_pack(np.concatenate([delta[at], gamma[at[wanted < ORDER << _TAG]]])))
    return pd.DataFrame({"shard": asked["shard"].to_numpy(np.int32), "chunk": asked["chunk"].to_numpy(np.int64), "values": out})


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(table.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([_chunk_id(table)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])


def _score(shards: int) -> Callable:
    def run(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        found = dict(zip(answers["shard"].tolist(), answers["values"].tolist()))
        for packed in held["rows"]:
            table = pa.ipc.open_stream(packed).read_all()
            own = Ngrams(table)
            wanted = own.requests()
            where = shard_of(wanted, shards)
            delta, gamma = np.zeros(len(wanted)), np.zeros(len(wanted))
            for s in range(shards):
                at = np.flatnonzero(where == s)
                if not len(at):
                    continue
                if s not in found:
                    raise RuntimeError("a chunk has no answers: the documents weren't read alike twice")
                low = at[wanted[at] < ORDER << _TAG]
                values = _unpack(found[s], "<f4")
                delta[at], gamma[low] = values[: len(at)], values[len(at) :]
            sums = own.sums(wanted, delta, gamma)
            with np.errstate(invalid="ignore", divide="ignore"):
                each = np.exp(-sums / own.lengths)
            out.append(pd.DataFrame({"doc_id": table.column(0).to_pandas(), "lang": table.column(1).to_pandas(), "n_bytes": own.lengths, "perplexity": np.where(own.lengths > 0, each, np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "lang": [], "n_bytes": [], "perplexity": []})

    return run


def _read_alike(df: DataFrame) -> bool:
    """Whether df is read from files and only projected, filtered and joined with broadcast tables, so that its rows come in the same order whenever a plan reads it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search(r"Exchange hash|Exchange range|Exchange Round|Exchange Single|Sort |Limit|Sample|Python|Pandas|Arrow|InMemoryTableScan|ExistingRDD|Generate|Aggregate", plan) and "FileScan" in plan


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity): perplexity a byte of each row; null for empty texts and without a model.

    docs: doc_id, lang, text (binary). Its rows are read twice in one plan, for what chunks ask and for their scores; unless they come from files as they
    are, which gives the same chunks both times, they are written to a table first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = model.count()
    if not size:
        return docs.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"))
    if not _read_alike(docs):
        docs = materialize(docs, "kn-documents")
    shards = max(1, -(-size // SHARD_NGRAMS))
    asked = docs.mapInArrow(_ask(shards), "shard int, chunk long, keys binary")
    # chunks are numbered in groups, and each group has a copy of the model: what meets in a task stays bounded
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    groups = max(1, -(-n_bytes // PART_BYTES))
    asked = asked.withColumn("part", F.pmod("chunk", F.lit(groups)).cast("int"))
    keyed = model.mapInPandas(_with_shard(shards), "key long, delta float, gamma float, shard int").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    answers = asked.groupBy("shard", "part").cogroup(keyed.groupBy("shard", "part")).applyInPandas(_answer_group, "shard int, chunk long, values binary")
    held = docs.mapInArrow(_carry, "chunk long, rows binary")
    scores = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_score_group(shards), f"doc_id {kind}, lang string, n_bytes long, perplexity double")
    return scores.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.col("perplexity")))


def _with_shard(shards: int) -> Callable:
    def run(frames):
        for rows in frames:
            yield rows.assign(shard=shard_of(rows["key"].to_numpy(np.int64), shards).astype(np.int32))

    return run


def _answer_group(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    return _answer(asked, model)


def _score_group(shards: int) -> Callable:
    score = _score(shards)
    return lambda held, answers: score(held, answers)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(t_id, fold): documents whose labels all say quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("t_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good")
    return ids.select("t_id", F.pmod(F.xxhash64("t_id"), F.lit(FOLDS)).alias("fold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, lang: Column | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) for each row of docs (doc_id, text, lang; other columns are ignored).

    The model is trained on all trusted documents but those held out; the threshold of a language is the quantile of its held-out
    documents' perplexities. A row is kept unless its perplexity is above the threshold: null and empty texts, and languages
    without held-out documents, are kept with nulls. Texts of any length are scored whole, a very long one as a chunk of its own; repeated rows are scored one by one, a perplexity that ties with the threshold is kept, a null lang is a language of its own, and without
    labels all is kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if lang is None else lang
    base = docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    ids = materialize(trusted_ids(labels), "kn-trusted")
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    trusted = base.join(known.where("fold > 0"), F.col("doc_id") == F.col("t_id"), "left_semi")
    scores = materialize(perplexities(base, train(trusted)), "kn-scores")
    held = scores.join(ids.where("fold = 0"), F.col("doc_id") == F.col("t_id"), "left_semi").where("perplexity is not null")
    limits = materialize(held.groupBy(F.col("lang").alias("l_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")), "kn-limits")
    rows = scores.join(limits, scores["lang"] == limits["l_lang"], "left").drop("l_lang")
    return rows.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
