import numpy as np
import pytest

from lexloom.llm import embedding_dedup as E


def brute(ids, vectors, threshold):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n, parent = len(ids), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.float64(vectors[i]), np.float64(vectors[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted((ids[i], links[i], least[find(i)], ids[i] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize("cell, home, present", [(4096, 2048, 8192), (20, 7, 11)])
def test_brute_force(spark, monkeypatch, cell, home, present):
    monkeypatch.setattr(E, "CELL_VECTORS", cell)
    monkeypatch.setattr(E, "HOME_BLOCK", home)
    monkeypatch.setattr(E, "PRESENT_BLOCK", present)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    vectors = [list(map(float, np.float32(v))) for v in base]
    for _ in range(150):
        v = base[rng.integers(0, 40)]
        vectors.append(list(map(float, np.float32(v + rng.normal(size=16) * rng.choice([0, 0.1, 0.2, 0.3])))))
    vectors += [vectors[3]] * 9 + [[2 * x for x in vectors[3]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    ids = list(map(int, rng.permutation(len(vectors))))
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, uid int, weight int").repartition(5)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == brute(ids, vectors, 0.95)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in E.near_duplicates(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]
    rows = E.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.01]), (None, [1.0, 0.0]), (9, [-1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in rows) == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
