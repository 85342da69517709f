import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x int, n string, component string"


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in e] for e in vectors])
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return c @ vectors / np.sqrt(values), values / (c * c).sum() * n, deviation


def holds(found, vectors, k=8):
    want, explained, deviation = brute(vectors, k)
    got = np.full(want.shape, np.nan)
    for r in found:
        assert r["n"] == len(vectors) and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert len(found) == got.size
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-7


@pytest.mark.parametrize("decay,most_passes", [(2.0, 6), (1.02, 12)])
def test_equals_the_eigenvectors(spark, decay, most_passes):
    rng = np.random.default_rng(1)
    d = 40
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    vectors = (rng.standard_normal((600, d)) * decay ** -np.arange(d)) @ turn
    df = spark.createDataFrame([(i, e.tolist(), 1, "a", "b") for i, e in enumerate(vectors)], SCHEMA).repartition(5)
    holds(W.whiten(df).collect(), vectors)
    rows = df.select(F.transform("embedding", lambda c: F.floor(c * 1024) + 100_000).alias("x"))
    fit = W.Fit(rows, 600, d, 8)
    assert fit.passes <= most_passes


def test_power_passes_find_what_stands_out(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((500, 64))
    vectors[:, :8] *= 50 * 2.0 ** -np.arange(8) + 300
    df = spark.createDataFrame([(i, e.tolist(), 1, "a", "b") for i, e in enumerate(vectors)], SCHEMA)
    holds(W.whiten(df).collect(), vectors)


def test_edges(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((50, 3))
    rows = [(i, e.tolist()) for i, e in enumerate(vectors)]
    rows += [(91, None), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("-inf"), 2.0]), (95, []), (96, [5.0, 5.0]), (97, [1.0]), (97, [1.0]), (None, [2.0, 2.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA)
    found = W.whiten(df).collect()
    holds([r for r in found if r["vec_id"] is not None and r["vec_id"] < 50], vectors, 3)
    rest = sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found if r["vec_id"] is None or r["vec_id"] >= 50)
    nothing = (0, 0.0, 0.0, 0.0)
    assert rest == [*((0, k, 1, *nothing) for k in range(1, 5)), (96, 1, 1, *nothing), (96, 2, 1, *nothing), (97, 1, 2, *nothing), (97, 1, 2, *nothing)]
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("embedding is null")).count() == 0
    with pytest.raises(Exception, match="too large"):
        W.whiten(spark.createDataFrame([(0, [1e30], 1, "", "")], SCHEMA)).collect()


def test_repeated_rows_weigh_as_often_as_they_occur(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 5)) * [5, 4, 3, 2, 1]
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 40, 0)])
    df = spark.createDataFrame([(i, e.tolist(), 1, "a", "b") for i, e in enumerate(vectors)], SCHEMA)
    holds(W.whiten(df).collect(), vectors, 5)
