import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import hard_negatives as H
from lexloom.llm.q12_hard_negatives import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, x string, uid string, rank int"


def brute(rows, is_anchor, positives=5, negatives=10):
    rows = [(n, i, [math.floor(256 * c) for c in e], label) for n, (i, e, label) in enumerate(rows) if e is not None and label is not None and all(c is not None and math.isfinite(c) for c in e)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for n, i, q, label in rows:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(q, x)), j, m, other) for m, j, x, other in rows if m != n and len(x) == len(q)]
        for s, p, *_ in sorted((r for r in scored if r[3] == label), key=order)[:positives]:
            hard = sorted((r for r in scored if r[3] != label and 30 * s <= 100 * r[0] <= 90 * s), key=order)[:negatives]
            out += [(i, p, rank, r[1], s, r[0]) for rank, r in enumerate(hard, 1)]
    return sorted(out, key=str)


def test_sliced_scores_equal_products():
    rng = np.random.default_rng(3)
    for top in (3, 300, 1 << 20, 1 << 28):
        q, x = rng.integers(-top, top, (9, 5)), rng.integers(-top, top, (70, 5))
        want = q @ x.T
        least = np.sort(want, axis=1)[:, -4]
        for bound in (np.full(9, -(1 << 62)), least):
            i, j, s = H.sliced_scores(q, x, lambda i, j, low, high: high >= bound[i])
            assert sorted(zip(i.tolist(), j.tolist(), s.tolist())) == [(a, b, want[a, b]) for a in range(9) for b in range(70) if want[a, b] >= bound[a]]
    with pytest.raises(OverflowError):
        H.sliced_scores(np.full((1, 4), 1 << 31), np.full((2, 4), 1 << 31) + np.arange(2)[:, None], lambda i, j, low, high: high >= low)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "PART", 90), monkeypatch.setattr(H, "BLOCK", 7), monkeypatch.setattr(H, "TILE", 16)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(300):
        c = rng.choice(centres)
        e = [round((x + rng.gauss(0, 0.7)) / 3, 1 if seed else 6) for x in c]  # coarse: ties
        rows.append((i, e, rng.choice([0, 0, 1, 2])))
    rows += rows[:40]  # repeated rows
    rows += [(400, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 1), (800, [0.5] * 6, None), (None, [0.1] * 6, 1), (None, None, None)]
    rows += [(900, [], 1), (910, [], 1), (911, [], 2), (1000, [1.0, 2.0], 1), (1001, [1.0, 1.5], 1), (1002, [1.0, 1.0], 0)]  # other lengths
    rows += [(10 * i + 2000, [0.0] * 6, 3) for i in range(3)]
    df = spark.createDataFrame([(*r, "a", "b", 7) for r in rows], SCHEMA)
    found = H.mine(df, F.col("vec_id") % 10 == 0)
    want = brute(rows, lambda i: i % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and len(want) > 500


def test_empty_and_large(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1e30], 1, "", "", 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        H.mine(one, F.col("vec_id") % 10 == 0).collect()


def test_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, lambda i: i % 100 == 0)
