"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are merged first and count by their number. Centroids are fitted to a bounded sample; every vector
goes to its nearest cell (home) and, as a guest, to each cell in which a vector at most the link angle away can live:

* what lives in a cell is nearer to its centroid than to any other, so it is beyond the bisecting plane of the two centroids,
  and the angle to that half-space must not exceed the link angle;
* it is no further from its centroid than the cell's radius.

Both are bounds, not estimates: no link is lost, whatever the vectors are like. Cells are put together to blocks, and crowded ones dealt to some. Each pair of blocks is a task's group, met once for both sides, and
has only those vectors that can have a link in the other block; they travel packed, in the precision that they came in. A vector is copied at most once for each block, whatever the number of cells. A group returns how often each
vector is linked and the links as stars, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components, forest

THRESHOLD = 0.95
#: Vectors the centroids are fitted to, at most, and numbers in these; vectors a cell is meant to hold; cells at most; rounds of fitting.
SAMPLE, SAMPLE_VALUES, CELL_VECTORS, MOST_CELLS, ROUNDS = 16_384, 1 << 20, 4_096, 1_024, 12
#: Vectors of a block, at most, and numbers in these; vectors of the other block that are multiplied at a time; blocks that many vectors are dealt to at least.
HOME_BLOCK, HOME_VALUES, PRESENT_BLOCK, LEAST_BLOCKS = 65_536, 1 << 22, 8_192, 4


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors x: assignment to the largest cosine, centroids as normalised means; empty cells keep theirs."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def _unit(embeddings: pd.Series | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(e, np.float64) for e in embeddings])
    x /= np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(centroids: np.ndarray):
    """(uid, cell, angle to its centroid) of each vector."""

    def run(frames):
        for rows in frames:
            if len(rows):
                cos = _unit(rows["embedding"]) @ centroids.T
                cell = cos.argmax(1)
                yield pd.DataFrame({"uid": rows["uid"], "cell": cell.astype(np.int32), "angle": np.arccos(cos[np.arange(len(cell)), cell].clip(-1, 1))})

    return run


def _present(x: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, radius: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and in which cells it is present."""
    reach, slack = float(np.arccos(threshold)), 1e-9
    cos = x @ centroids.T
    cell = cos.argmax(1)
    best = cos[np.arange(len(cell)), cell]
    # the sine of the angle to the half-space of each other cell, and the angle to its vectors
    beyond = (best[:, None] - cos) / gaps[cell]
    there = (beyond <= np.sin(reach) + slack) & (np.arccos(cos.clip(-1, 1)) <= radius[None, :] + reach + slack)
    there[np.arange(len(cell)), cell] = True
    return cell, there


def _gaps(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-30))


def _dealt(centroids: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, blocks) of each cell, and how many there are: near cells share a block of up to `most` vectors, a cell of more has its own ones."""
    first, count = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    left, now, n, room = np.ones(len(size), bool), 0, 0, 0
    for _ in range(len(size)):
        left[now] = False
        if size[now] > most:
            first[now], count[now] = n, -(-size[now] // most)
            n, room = n + count[now], 0
        else:
            if size[now] > room or not n:
                n, room = n + 1, most
            first[now] = n - 1
            room -= size[now]
        if left.any():
            now = int(np.where(left, centroids @ centroids[now], -2).argmax())
    return first, count, int(n)


def _copies(centroids: np.ndarray, radius: np.ndarray, first: np.ndarray, count: np.ndarray, n: int, threshold: float, kind: type):
    """The vectors of each pair of blocks (a <= b), packed; side: which of the two they are of."""
    gaps = _gaps(centroids)
    block = np.arange(n)
    holds = ((block >= first[:, None]) & (block < (first + count)[:, None])).astype(np.float32)

    def run(frames):
        for rows in frames:
            if not len(rows):
                continue
            raw = np.stack([np.asarray(e, kind) for e in rows["embedding"]])
            uid, weight = rows["uid"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
            cell, there = _present(_unit(raw), centroids, gaps, radius, threshold)
            spread = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            own = first[cell] + spread % count[cell]
            reach = there.astype(np.float32) @ holds > 0
            for i in np.unique(own):
                mine = np.flatnonzero(own == i)
                for j in np.flatnonzero(reach[mine].any(0)):
                    some = mine[reach[mine, j]]
                    yield pd.DataFrame([{"a": min(i, j), "b": max(i, j), "side": int(i > j), "ids": uid[some].tobytes(), "weights": weight[some].tobytes(), "vectors": raw[some].tobytes()}])

    return run


def _compare(threshold: float, size: int, kind: type):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        def of(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = rows[rows["side"] == side]
            ids, weights = (np.frombuffer(b"".join(own[c]), np.int64) for c in ("ids", "weights"))
            x = np.frombuffer(b"".join(own["vectors"]), kind).astype(np.float64).reshape(-1, size)
            x /= np.abs(x).max(1, keepdims=True, initial=0.0)
            return ids, weights, x / np.linalg.norm(x, axis=1, keepdims=True)

        same = rows["a"].iloc[0] == rows["b"].iloc[0]
        u, of_u, x = of(0)
        v, of_v, y = (u, of_u, x) if same else of(1)
        n, m = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
        a = b = np.empty(0, np.int64)
        for k in range(0, len(u), 256):
            for h in range(0, len(v), PRESENT_BLOCK):
                r, c = np.nonzero(x[k : k + 256] @ y[h : h + PRESENT_BLOCK].T >= threshold)
                r, c = r + k, c + h
                if same:
                    r, c = r[r != c], c[r != c]
                if len(r):
                    np.add.at(n, r, of_v[c])
                    if not same:
                        np.add.at(m, c, of_u[r])
                    a, b = forest(np.concatenate([a, u[r]]), np.concatenate([b, v[c]]))
        linked, times = (u, n) if same else (np.concatenate([u, v]), np.concatenate([n, m]))
        some = np.flatnonzero(times)
        return pd.DataFrame({"u": np.concatenate([linked[some], a]), "v": np.concatenate([np.full(len(some), -1), b]), "n": np.concatenate([times[some], np.zeros(len(a), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    n_links: other rows with a cosine of at least threshold (> 0), in double precision; component_id: the smallest vec_id that links reach;
    kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths not with one another. Repeated rows count as rows; of the rows that share a kept vec_id all
    are kept; a null vec_id is kept as it is and has its group's component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    e = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    good = F.size(e) > 0
    good = good & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.transform(e, lambda x: x + F.lit(0.0).cast("float" if single else "double"))).alias("embedding"))
    none = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where("embedding is not null")
    each = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")).withColumn("uid", F.monotonically_increasing_id())
    each = materialize(each, "vectors")
    numbers, links = [], []
    for size, count in sorted(each.groupBy(F.size("embedding").alias("k")).count().collect()):  # one row a vector length
        of = each.where(F.size("embedding") == size)
        found = materialize(_links(of, count, threshold), "vector-links")
        numbers.append(found.where("v = -1").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("links")))
        links.append(found.where("v <> -1").select("u", "v"))
    if not numbers:
        return none.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    for more in numbers[1:]:
        numbers[0] = numbers[0].unionByName(more)
    for more in links[1:]:
        links[0] = links[0].unionByName(more)
    groups = connected_components(links[0], "vectors")
    named = each.join(numbers[0], "uid", "left").join(groups, each["uid"] == groups["node"], "left")
    named = materialize(named.select("embedding", "vec_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "uid").alias("class")), "vector-classes")
    lowest = named.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    named = materialize(named.join(lowest, "class").select(F.col("embedding").alias("_e"), (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-named")
    out = rows.join(named, rows["embedding"] == named["_e"]).select("vec_id", "n_links", "component_id").unionByName(none)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(of: DataFrame, count: int, threshold: float) -> DataFrame:
    """(u, v, n): numbers of links (v = -1) and links as stars of distinct vectors of one length."""
    cells = int(np.clip(-(-count // CELL_VECTORS), 1, MOST_CELLS))
    most = max(cells, min(SAMPLE, SAMPLE_VALUES // of.select(F.size("embedding")).first()[0]))
    sample = of if count <= most else of.where(F.pmod(F.xxhash64("uid"), F.lit(count)) < most)
    fitted = [r["embedding"] for r in sample.orderBy(F.xxhash64("uid")).limit(most).select("embedding").collect()]
    centroids = spherical_kmeans(_unit(pd.Series(fitted)), cells)
    homes = of.select("uid", "embedding").mapInPandas(_homes(centroids), "uid long, cell int, angle double")
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in homes.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # one row a cell
        radius[r["cell"]], size[r["cell"]] = r["a"], r["n"]
    length = len(fitted[0])
    most = min(HOME_BLOCK, max(1, HOME_VALUES // length), max(CELL_VECTORS, -(-count // LEAST_BLOCKS)))
    first, times, n = _dealt(centroids, size, most)
    kind = np.float32 if of.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    copies = of.select("uid", "weight", "embedding").mapInPandas(_copies(centroids, radius, first, times, n, threshold, kind), "a int, b int, side int, ids binary, weights binary, vectors binary")
    compare = _compare(threshold, length, kind)
    return copies.groupBy("a", "b").applyInPandas(lambda rows: compare(rows), "u long, v long, n long")
