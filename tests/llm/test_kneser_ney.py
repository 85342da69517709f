import math
import random
from collections import Counter, defaultdict

import pytest

from lexloom.llm import kneser_ney as K

PAD = b"\0" * (K.ORDER - 1)


class Brute:
    """The model by its definition, recursively."""

    def __init__(self, texts):
        self.counts = {K.ORDER: Counter()}
        for t in texts:
            t = PAD + t
            for i in range(K.ORDER - 1, len(t)):
                self.counts[K.ORDER][t[i - K.ORDER + 1 : i + 1]] += 1
        for n in range(K.ORDER - 1, 0, -1):
            self.counts[n] = Counter(x[1:] for x in self.counts[n + 1])
        self.d = {n: K.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))) for n, c in self.counts.items()}
        self.stats = {n: defaultdict(lambda: [0, 0.0]) for n in self.counts}
        for n, c in self.counts.items():
            for x, v in c.items():
                s = self.stats[n][x[:-1]]
                s[0] += v
                s[1] += self.d[n][min(v, 3) - 1]

    def p(self, x):
        n = len(x)
        if not n:
            return 1 / 256
        if x[:-1] not in self.stats[n]:
            return self.p(x[1:])
        total, free = self.stats[n][x[:-1]]
        v = self.counts[n][x]
        return (v - self.d[n][min(v, 3) - 1] if v else 0) / total + free / total * self.p(x[1:])

    def perplexity(self, t):
        full = PAD + t
        return math.exp(-sum(math.log(self.p(full[i - K.ORDER + 1 : i + 1])) for i in range(K.ORDER - 1, len(full))) / len(t))


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(["the ", "thé", "an", "d ", "er", "\0", "x", ".\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("ngrams", [65_536, 40])
def test_brute_force(spark, monkeypatch, ngrams):
    monkeypatch.setattr(K, "SHARD_NGRAMS", ngrams)
    trained, scored = texts(1, 60), [*texts(2, 50), "", None, "€ unseen \U0001f600", *["same text"] * 5]
    rows = [(i, "en", bytearray(t.encode()) if t is not None else None) for i, t in enumerate(scored)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text binary").repartition(3).cache()
    source = spark.createDataFrame([(i, "en", bytearray(t.encode())) for i, t in enumerate(trained)], "doc_id long, lang string, text binary").repartition(4)
    own = Brute([t.encode() for t in trained])
    got = {r.doc_id: r for r in K.perplexities(df, K.train(source)).collect()}
    assert len(got) == len(scored)
    for i, t in enumerate(scored):
        if not t:
            assert got[i].perplexity is None and got[i].n_bytes == 0
        else:
            assert got[i].perplexity == pytest.approx(own.perplexity(t.encode()), rel=1e-4)


def test_small_chunks(monkeypatch):
    import pyarrow as pa

    data = [x.encode() for x in texts(4, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["en"] * 40), pa.array(data, pa.binary())], ["doc_id", "lang", "text"])
    whole = Counter()
    for t in K.chunks(iter([batch])):
        own = K.Ngrams(t)
        whole.update(dict(zip(own.keys.tolist(), own.counts.tolist())))
    for size, table in ((100, 1 << 25), (333, 0)):
        monkeypatch.setattr(K, "CHUNK_BYTES", size)
        monkeypatch.setattr(K, "TABLE", table)
        parts, seen = Counter(), []
        for t in K.chunks(iter([batch.slice(0, 13), batch.slice(13, 0), batch.slice(13)])):
            own = K.Ngrams(t)
            parts.update(dict(zip(own.keys.tolist(), own.counts.tolist())))
            seen += t.column(0).to_pylist()
        assert parts == whole and seen == list(range(40))


def test_classify(spark):
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choice(["the", "an", "er", "ing", "ed"]) for _ in range(rng.randrange(1, 4))) for _ in range(80))
    junk = lambda: " ".join("".join(rng.choices("qxzj#$%&", k=5)) for _ in range(80))
    docs = [(i, clean() if i % 4 else junk(), "en" if i % 3 else None, 1.0) for i in range(400)] + [(500, None, "en", 1.0), (501, "", "xx", 1.0), (None, junk(), "en", 1.0), (502, junk(), "xx", 1.0)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, perplexity double")
    rows = K.classify(df, labels).collect()
    assert len(rows) == len(docs)
    right = sum(r.kept == bool(r.doc_id % 4) for r in rows if r.doc_id is not None and r.doc_id < 400)
    assert right > 375
    assert {r.doc_id: r.kept for r in rows if r.doc_id is None or r.doc_id >= 500} == {500: True, 501: True, 502: True, None: False}
    assert K.classify(df, labels.limit(0)).where("kept").count() == len(docs)
    assert K.classify(df.limit(0), labels).count() == 0
