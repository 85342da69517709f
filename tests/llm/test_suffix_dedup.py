import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import suffix_dedup as S


def brute(texts, least):
    """(removed bytes, spans, digest of the rest) by counting every string."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        inner = gone[1:-1]
        out.append((int(inner.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~inner])).hexdigest()))
    return out


def texts(seed, n, alphabet, long):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(rng.randrange(5, long))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, long)))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a : rng.randrange(len(s) // 2, len(s))], " ".join(word() for _ in range(rng.randrange(0, long)))]
        out.append(" ".join(parts))
    out += [None, "", "ab" * 300, "a" * 500, "a" * 400, out[0], out[0], out[1][1:], "é" * 150, shared[0], "x" + shared[0] + "y"]
    return out


@pytest.mark.parametrize("least, reach, alphabet", [(200, 128, "abcdefgh é"), (8, 4, "ab "), (20, 16, "abc")])
def test_brute_force(spark, least, reach, alphabet):
    data = texts(least, 60, alphabet, 90)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(data)], "doc_id long, text string, n_removed long").repartition(5)
    rows = {r.doc_id: (r.n_removed, len(r.span_start), r.kept) for r in S.remove_repeats(docs, least, reach, digest=True).collect()}
    assert [rows[i] for i in range(len(data))] == brute(data, least)


def test_edges(spark):
    odd = spark.createDataFrame([(1, "a" * 250, 5, 6)], "doc_id long, text string, th int, runs int")
    assert [r.in_th + r.in_runs + r.n_removed for r in S.remove_repeats(odd).collect()] == [261]
    schema = "doc_id long, text string, kept int, lang string"
    assert S.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = S.remove_repeats(spark.createDataFrame([(None, "q" * 300, 1, "en"), (7, None, 2, None), (7, "only once " + "z" * 10, 3, "de"), (8, "r" + "s" * 100, 4, "fr")] * 2, schema)).collect()
    assert sorted((r.doc_id or 0, r.in_kept, r.n_removed, r.kept[:4]) for r in rows) == sorted([(0, 1, 300, ""), (7, 2, 0, ""), (7, 3, 0, "only"), (8, 4, 0, "rsss")] * 2)


def test_classes_are_exact():
    block = b"abcabcabdabcab" * 3
    starts = np.arange(len(block) - 11)
    ranks = S.suffix_classes(block, starts, 11)
    strings = [block[s : s + 11] for s in starts]
    for i in starts:
        for j in starts:
            assert (ranks[i] < ranks[j]) == (strings[i] < strings[j])


def test_parse_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choices("abcd ", k=3000)).encode()
    whole = S.triggers(text)
    monkeypatch.setattr(S, "PARSE_STARTS", 700)
    parts = S.triggers(text)
    assert np.repeat(whole[2], whole[1]).tolist() == np.repeat(parts[2], parts[1]).tolist()
