"""BPE encoding and decoding through a lexicon of frequent words: a minimal acyclic transducer.

Words are the matches of the byte-level pattern. All are counted over all documents; those whose share of the running words reaches a
threshold (which bounds their number) are encoded once and compiled, in sorted order, into the minimal subsequential transducer: states with
the same continuations are one state, so that words share prefixes and suffixes, and the ids are put out as early as all words through a transition agree.
The automaton is a file of flat arrays that Spark hands to each executor; the workers of an executor map the same copy into memory
and walk the distinct words of a slice through it at once, one byte a step. Words that it doesn't hold are merged exactly, also all at once, one merge of each a step.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slice_starts
from .common import discard, materialize, release, shared_dir

#: A word is frequent from this share of all running words on, which bounds the lexicon to 100,000 words; and longest bytes of such a word.
SHARE, WORD_BYTES = 1e-5, 64
#: Rows and bytes of text whose words a worker holds at a time; words that it puts into digits at a time.
ROWS, TEXT_BYTES, WORDS = 4_096, 8 << 20, 1 << 16
#: Ids from which merging uses a heap.
HEAP_IDS = 96


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each range, one range after another."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all parts, where each begins, and its length."""
    size = np.array(list(map(len, parts)), np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """The byte-level BPE model of a tokenizers file: exact merges, decoding, and added tokens, which are cut out of a text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.of_byte = [vocabulary[c] for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [tuple(pair) for pair in pairs]
        self.merges = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.raw, self.digits = flat(self.bytes_of), flat([b"%d," % i for i in range(len(self.bytes_of))])
        # the pairs in order of a number that stands for both; the pairs of bytes once more in a square
        number = np.array([a * len(self.bytes_of) + b for a, b in self.merges], np.int64)
        order = np.argsort(number)
        self.pair, self.pair_rank = number[order], np.array(list(self.merges.values()), np.int64)[order]
        self.of_byte_array, self.made_array = np.array(self.of_byte, np.int64), np.array([*self.made, -1], np.int64)
        self.byte_rank = self.ranks(np.repeat(self.of_byte_array, 256), np.tile(self.of_byte_array, 256))

    def starts(self, text: str) -> np.ndarray:
        """Where (code points) the matches of the pattern and the added tokens of a text begin; they cover it."""
        if not self.cut or not self.cut.search(text):
            return slice_starts(text)
        found, at = [np.empty(0, np.int64)], 0
        for part in self.cut.split(text):
            if part:
                found.append(np.array([at]) if part in self.added else slice_starts(part) + at)
            at += len(part)
        return np.concatenate(found)

    def words(self, text: str) -> list[str]:
        """The matches of the pattern and the added tokens of a text, in order."""
        bounds = self.starts(text).tolist()
        return [text[a:b] for a, b in zip(bounds, [*bounds[1:], len(text)])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, as many as there are merges where there is none."""
        number = left * len(self.bytes_of) + right
        at = np.minimum(np.searchsorted(self.pair, number), max(len(self.pair) - 1, 0))
        return np.where(self.pair[at] == number, self.pair_rank[at], len(self.made)) if len(self.pair) else np.full(len(number), len(self.made))

    def merge_all(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that lie in text from first on, none empty, one after another; and how many each has. All words go together, a merge of each a step, as merge() does it for one."""
        none, count = len(self.made), size.copy()
        raw = text[spread(first, size)]
        ids, word = self.of_byte_array[raw], np.repeat(np.arange(len(size)), size)
        rank = np.full(len(raw), none)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.byte_rank[raw[inside].astype(np.int64) << 8 | raw[inside + 1]]
        done_word, done_ids = [], []
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(ids))))
            if not (open_ := low < none).all():
                done_word.append(word[~open_]), done_ids.append(ids[~open_])
                ids, word, rank, low = ids[open_], word[open_], rank[open_], low[open_]
            at = np.flatnonzero(rank == low)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at  # the leftmost of equals
            ids[at] = self.made_array[low[at]]
            count[word[at]] -= 1
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, word, rank, at = ids[kept], word[kept], rank[kept], at - np.arange(len(at))
            # the pairs with the new id on either side
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                rank[left] = np.where((right > left) & (word[left] == word[right]), self.ranks(ids[left], ids[right]), none)
        if not done_ids:
            return np.empty(0, np.int64), count
        return np.concatenate(done_ids)[np.argsort(np.concatenate(done_word), kind="stable")], count

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of a word: the pair of the earliest merge, the leftmost of equals, is merged until none is left."""
        if word in self.added:
            return (self.added[word],)
        ids, merges = [self.of_byte[b] for b in word.encode()], self.merges
        if len(ids) >= HEAP_IDS:
            return self._merge_long(ids)
        none = len(self.made)
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            ids[i : i + 2] = [self.made[low]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merges.get((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over linked ids, so that a text without boundaries takes n log n."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j, new = after[i], self.made[rank]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := merges.get((new, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if before[i] >= 0 and (rank := merges.get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (rank, before[i]))
        return tuple(i for i in ids if i >= 0)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """Once in each Python worker; what it holds needn't be looked through for garbage again."""
    tokenizer = Tokenizer(path)
    gc.freeze()
    return tokenizer


def _shared(a: tuple, b: tuple) -> tuple:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return a[:n]


class Builder:
    """The minimal subsequential transducer of sorted words and their ids, a word at a time; only the last word's path is open."""

    def __init__(self) -> None:
        self.last = b""
        self.path: list[list] = [self._state()]  # {label: [target, output]}, final, output at the end
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []

    @staticmethod
    def _state() -> list:
        return [{}, False, ()]

    def _close(self, depth: int) -> None:
        """States of the path deeper than depth are final; equal ones become one."""
        path = self.path
        while len(path) > depth + 1:
            edges, final, output = path.pop()
            key = (final, output, tuple((label, *edges[label]) for label in sorted(edges)))
            if (at := self.register.get(key)) is None:
                at = self.register[key] = len(self.states)
                self.states.append(key)
            path[-1][0][self.last[len(path) - 1]][0] = at

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if word <= self.last and self.path[0][0] or not word:
            raise ValueError("words come sorted, each once, none empty")
        same = len(_shared(tuple(word), tuple(self.last)))
        self._close(same)
        path = self.path
        for depth in range(same):  # what not all words of a transition share moves on to the next ones
            edge = path[depth][0][word[depth]]
            common = _shared(edge[1], ids)
            if rest := edge[1][len(common) :]:
                edge[1] = common
                state = path[depth + 1]
                for onward in state[0].values():
                    onward[1] = rest + onward[1]
                if state[1]:
                    state[2] = rest + state[2]
            ids = ids[len(common) :]
        for depth in range(same, len(word)):
            path[depth][0][word[depth]] = [-1, ids if depth == same else ()]
            path.append(self._state())
        path[-1][1:] = [True, ids if same == len(word) else ()]
        self.last = word

    def arrays(self) -> dict[str, np.ndarray]:
        """Flat arrays: the transitions sorted by state and label, where each leads and what it puts out; what ends put out."""
        self._close(0)
        root = self.path[0]
        states = [*self.states, (root[1], root[2], tuple((label, *root[0][label]) for label in sorted(root[0])))]
        outputs: dict[tuple, int] = {(): 0}
        key, target, output, end = [], [], [], []
        for s, (final, at_end, edges) in enumerate(states):
            end.append(outputs.setdefault(at_end, len(outputs)) if final else -1)
            for label, to, out in edges:
                key.append(s << 8 | label)
                target.append(to)
                output.append(outputs.setdefault(out, len(outputs)))
        sizes = np.cumsum([0, *map(len, outputs)])
        return {"key": np.array(key, np.int64), "target": np.array(target, np.int64), "output": np.array(output, np.int64), "end": np.array(end, np.int64), "first": sizes.astype(np.int64), "ids": np.array(list(chain.from_iterable(outputs)), np.int64)}


ARRAYS = ("key", "target", "output", "end", "first", "ids")


def compiled(entries: Iterable[tuple[str, tuple[int, ...]]]) -> bytes:
    """The automaton's file: the lengths of its arrays, then the arrays."""
    builder = Builder()
    for word, ids in sorted((word.encode(), ids) for word, ids in entries):
        builder.add(word, ids)
    arrays = builder.arrays()
    return b"".join([np.array([len(arrays[k]) for k in ARRAYS], np.int64).tobytes(), *(arrays[k].tobytes() for k in ARRAYS)])


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        at = len(ARRAYS)
        for name, n in zip(ARRAYS, whole[:at].tolist()):
            setattr(self, name, whole[at : at + n])
            at += n
        self.root = len(self.end) - 1

    def look_up(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None where the lexicon doesn't hold it."""
        held, ids, count = self.walk(*flat([w.encode() for w in words]))
        ids, bounds = ids.tolist(), np.cumsum([0, *count]).tolist()
        return [tuple(ids[a:b]) if h else None for h, a, b in zip(held.tolist(), bounds, bounds[1:])]

    def walk(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words that lie in text from start on the lexicon holds, the ids of these one after another, and how many each word has; all words go a byte a step."""
        n = len(size)
        if not n or not len(self.key):
            return np.zeros(n, bool), np.empty(0, np.int64), np.zeros(n, np.int64)
        state = np.full(n, self.root, np.int64)
        state[size > WORD_BYTES] = -1
        whose, what = [], []
        at = np.flatnonzero(state >= 0)
        for step in range(WORD_BYTES):
            at = at[size[at] > step]
            if not len(at):
                break
            key = state[at] << 8 | text[start[at] + step]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[edge] == key
            state[at[~there]] = -1
            at, edge = at[there], edge[there]
            state[at] = self.target[edge]
            output = self.output[edge]
            some = output > 0
            whose.append(at[some])
            what.append(output[some])
        end = np.where(state >= 0, self.end[state], -1)
        whose.append(np.flatnonzero(end > 0))
        what.append(end[end > 0])
        held = end >= 0
        who, put = np.concatenate(whose), np.concatenate(what)
        who, put = who[held[who]], put[held[who]]
        order = np.argsort(who, kind="stable")
        who, put = who[order], put[order]
        first = self.first[put]
        count = self.first[put + 1] - first
        return held, self.ids[spread(first, count)], np.bincount(who, count, n).astype(np.int64)


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    """The executor's copy of the file; its workers share the pages."""
    return Lexicon(SparkFiles.get(name))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and, beyond single rows, TEXT_BYTES bytes of column 1; at the end memory goes back to the system."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(size, before + TEXT_BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end
    release()


class Words:
    """The words of a slice's texts: how many a text has, where they begin in it (code points), and which of the slice's distinct words each is."""

    def __init__(self, tokenizer: Tokenizer, texts: list[str | None]):
        starts, offsets, raws, at = [], [], [], 0
        for text in texts:
            starts.append(begin := tokenizer.starts(text or ""))
            raws.append(raw := (text or "").encode())
            if len(raw) > len(text or ""):
                begin = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)[begin]
            offsets.append(begin + at)
            at += len(raw)
        self.n, self.starts = np.array(list(map(len, starts)), np.int64), np.concatenate([np.empty(0, np.int64), *starts])
        offsets = np.concatenate([*offsets, [at]]).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(raws))).dictionary_encode()
        self.which, self.distinct = found.indices.to_numpy(), found.dictionary

    def ids(self, tokenizer: Tokenizer, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in these each distinct word's begin, and how many it has: out of the lexicon, else merged."""
        _, offsets, text = self.distinct.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(self.distinct) + 1] if len(self.distinct) else np.zeros(1, np.int64)
        text, begin, size = np.frombuffer(text or b"", np.uint8), offsets[:-1], np.diff(offsets)
        held, ids, count = lexicon.walk(text, begin, size)
        whole = [at for token in tokenizer.added if (at := pc.index(self.distinct, pa.scalar(token, pa.large_string())).as_py()) >= 0]
        alone = size >= HEAP_IDS
        alone[whole] = True
        alone &= ~held
        rest = np.flatnonzero(~held & ~alone)
        merged, count[rest] = tokenizer.merge_all(text, begin[rest], size[rest])
        single = [tokenizer.merge(self.distinct[at].as_py()) for at in np.flatnonzero(alone).tolist()]
        count[alone] = list(map(len, single))
        order = np.concatenate([np.flatnonzero(held), rest, np.flatnonzero(alone)])
        first = np.empty(len(size), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([ids, merged, *map(np.array, single)]).astype(np.int64), first, count


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts; the null word has the number of all running words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in slices(batches):
            words = Words(tokenizer, batch.column(1).to_pylist())
            counts = np.bincount(words.which, minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.distinct.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.append(counts, len(words.which)), pa.int64())], ["word", "n"])

    texts = docs.select(F.lit(0).alias("_"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", share: float = SHARE) -> str:
    """The name of a file that every executor gets: the automaton of the words whose share of all running words is at least share.

    At most 1 / share words of at most 64 bytes reach the driver, whatever the corpus. Words that occur once are never frequent. The file lies in the shared
    folder, from which Spark fetches a copy to each executor, also to one that starts later.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, path, text_col).where("word is null or n > 1"), "word-counts")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    tokenizer = load(path)
    frequent = counts.where((F.col("n") >= F.lit(max(2.0, share * total))) & (F.octet_length("word") <= WORD_BYTES)).select("word").collect()
    data = compiled((r["word"], tokenizer.merge(r["word"])) for r in frequent if r["word"] not in tokenizer.added)
    discard(counts)
    return _hand_out(spark, data)


def _hand_out(spark: SparkSession, data: bytes) -> str:
    name = f"lexicon-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = system.create(at)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(at.makeQualified(system.getUri(), system.getWorkingDirectory()).toString())
    return name


def encode(docs: DataFrame, path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, word_start, word_ids): per document its ids, and for each word where it begins (code points) and at which id.

    lexicon: a name from compile_lexicon(); by default that of these documents. The ids don't depend on it. A null text counts as empty and has no ids; repeated
    rows are kept, each with the same ids; ties don't arise; texts may be as long as a row can be, also without any boundary; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    name = lexicon or compile_lexicon(docs, path, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, automaton = load(path), mapped(name)
        for batch in slices(batches):
            words = Words(tokenizer, batch.column(1).to_pylist())
            ids, first, count = words.ids(tokenizer, automaton)
            n = count[words.which]
            by_word, by_text = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(words.n)])
            columns = (by_word[by_text], ids[spread(first[words.which], n)].astype(np.int32)), (by_text, words.starts), (by_text, by_word[:-1] - np.repeat(by_word[by_text[:-1]], words.n))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)) for at, values in columns)], ["doc_id", "ids", "word_start", "word_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, word_start array<bigint>, word_ids array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids, any ids of the vocabulary; null ids count as none, bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
        release()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode() and of decode() of its ids, without moving the ids; rows as in encode()."""
    name = compile_lexicon(docs, path, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, automaton = load(path), mapped(name)
        for batch in slices(batches):
            words = Words(tokenizer, batch.column(1).to_pylist())
            ids, first, count = words.ids(tokenizer, automaton)
            n, digits, text = _digests(tokenizer, words, ids, first, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digits, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(tokenizer: Tokenizer, words: Words, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[str], list[str]]:
    """How many ids each text of a slice has, the digest of their digits, and that of what they decode to; a few words at a time, wherever texts end."""
    of_digits, of_text = [hashlib.sha256() for _ in words.n], [hashlib.sha256() for _ in words.n]
    decoder, ends, total = codecs.getincrementaldecoder("utf-8")("replace"), np.cumsum(words.n), np.zeros(len(words.n), np.int64)
    for at in range(0, len(words.which), WORDS):
        which = words.which[at : at + WORDS]
        some = ids[spread(first[which], count[which])]
        at_ids = np.concatenate([[0], np.cumsum(count[which])])
        texts = np.arange(np.searchsorted(ends, at, "right"), min(np.searchsorted(ends, at + len(which)) + 1, len(ends)))
        bounds = at_ids[np.minimum(np.append(ends[texts] - words.n[texts], ends[texts[-1]]) - at, len(which)).clip(0)]
        total[texts] += np.diff(bounds)
        for (table, begin, size), is_text in ((tokenizer.digits, False), (tokenizer.raw, True)):
            out = table[spread(begin[some], size[some])].tobytes()
            cuts = np.concatenate([[0], np.cumsum(size[some])])[bounds].tolist()
            for i, a, b in zip(texts.tolist(), cuts, cuts[1:]):
                last = ends[i] <= at + len(which)
                if is_text:
                    of_text[i].update(decoder.decode(out[a:b], last).encode())
                else:
                    of_digits[i].update(out[a : b - (last and b > a)])  # no comma at the end
    return total, [x.hexdigest() for x in of_digits], [x.hexdigest() for x in of_text]
