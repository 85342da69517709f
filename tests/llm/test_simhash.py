import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import graph as G
from lexloom.llm import simhash as S


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, most):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 64)
    for i in range(len(ids)):
        least[find(i)] = min(least[find(i)], ids[i])
    return {(ids[i], least[find(i)]) for i in range(len(ids))}


def test_query_by_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one", "a b", "A  b\x0bc", "É é\x1cx y z"]
    for _ in range(40):
        words = [rng.choice(["alpha", "beta", "Gamma", "delta", "é"]) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 200))]
        for _ in range(5):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "edit"
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, class int").repartition(5)
    rows = S.simhash_groups(df).select("doc_id", S.fingerprint_hex().alias("hex"), "component_id").collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert {(r.doc_id, r.hex) for r in rows} == {(i, f"{f:016x}") for i, f in zip(ids, fps)}
    assert {(r.doc_id, r.component_id) for r in rows} == classes(ids, fps, 3)


@pytest.mark.parametrize("hot, tile", [(8192, 4096), (10, 4)])
def test_links(spark, hot, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64).tolist()
    fps = set(base)
    for _ in range(400):
        x = base[rng.integers(0, 30)] if rng.random() < 0.5 else rng.choice(list(fps))
        for b in rng.integers(0, 63, rng.integers(1, 5)):
            x = int(x) ^ 1 << int(b)
        fps.add(int(x))
    ids = sorted(fps)
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    got = {r.node: r.component for r in G.connected_components(S.hamming_links(df, 3, hot, tile)).collect()}
    unsigned = [x & (1 << 64) - 1 for x in ids]
    assert {(i, got.get(i, i)) for i in ids} == classes(ids, unsigned, 3)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert S.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = S.simhash_groups(spark.createDataFrame([(3, "x y z w"), (3, "x y z w"), (None, "x y z w"), (2, None), (9, "")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (2, 2), (3, 3), (3, 3), (9, 2)]


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 600)]
    edges = chain + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (1, 0)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    got = {r.node: r.component for r in G.connected_components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent) if x in got} and all(find(x) == x and all(x not in e or e[0] == e[1] for e in edges) for x in set(parent) - set(got))


def test_keep_one(spark):
    rng = random.Random(6)
    docs, n = [], 0
    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(1 + group % 4):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(300)] = f"e{rng.randrange(100)}"
            docs.append((group * 10 + k, " ".join(own), "en"))
        n += 1
    docs += [(5000, docs[0][1], "en"), (None, docs[0][1], "en"), (5001, None, "en"), (5002, "", "de"), docs[4], docs[4]]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, th string, g_id int, g_th int").repartition(6)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    must = {g * 10 for g in range(60)} | {5001}
    assert must <= ids and len(ids - must) <= 1  # all copies are more alike than 0.8
    assert S.keep_one(df.limit(0)).count() == 0
    far = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100)), "en") for i in range(50)], "doc_id long, text string, th string")
    assert S.keep_one(far).count() == 50
    assert kept.count() == len(ids)


def test_index():
    for n in (1, 1000, 10**6, 10**9):
        found = S.index_for(n, 0.8)
        assert found.bits >= math.log2(n) + 3 and found.words * 64 >= found.segments * found.bits
    rng = np.random.default_rng(5)
    for n in (1000, 10**6):
        index, p = S.index_for(n, 0.8), S.bit_chance(0.8)
        flips = rng.random((20_000, index.segments, index.bits)) < p
        assert (flips.sum(2) <= 2).any(1).mean() > 0.985
    f = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    index = S.Index(11, 23, 4)
    whole = [sum(int(w) << 64 * k for k, w in enumerate(row)) for row in f]
    assert S.segment_values(f, index).tolist() == [[x >> 23 * j & (1 << 23) - 1 for j in range(11)] for x in whole]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("tile, small, bits", [(512, 64, 3), (8, 4, 3), (5, 2, 3), (8, 2, 12)])
def test_similar_groups_by_brute_force(spark, monkeypatch, tile, small, bits):
    """Pairs of a similarity from 0.7 to 0.95, a chain and a large group against all pairs compared."""
    monkeypatch.setattr(S, "CROWD_TILE", tile)
    monkeypatch.setattr(S, "SMALL_KEY", small)
    monkeypatch.setattr(S, "MORE_BITS", bits)
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    texts = []
    for i in range(240):
        n = rng.choice([60, 150, 300])
        words, j = fresh(n), 0.7 + i % 26 / 100
        new = round((1 - 2 * j / (1 + j)) * n)
        texts += [" ".join(words), " ".join(words[: n - new] + fresh(new))]
    chain = fresh(200)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[18:] + fresh(18)
    crowd = fresh(100)
    for _ in range(30):
        texts.append(" ".join(crowd[: rng.randrange(78, 100)] + fresh(8)))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[find(i)] = find(j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r["class"] for r in S.similar_groups(df).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 150 and found >= 0.99 * len(pairs)
    # nothing is linked that isn't alike
    assert all(find(i) == find(j) for i in range(len(texts)) for j in range(i) if got[i] == got[j])
