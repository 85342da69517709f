"""Connected components over an edge table, without collecting edges or components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for each node of the edges (a, b) but the smallest ones.

    Vectorised hooking and pointer jumping on dense indices.
    """
    nodes, dense = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = dense[: len(a)], dense[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's edges as stars; at most one row a node is held at a time besides the batch."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["u", "v"])


def connected_components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the edges (u, v: long) the smallest node reachable from it.

    Each partition first contracts its edges to stars. Then large-star and small-star alternate until
    nothing changes; minima are partial aggregates, and the two sides of each join are written tables, so
    that adaptive execution can split a hub. The tables of a round go when the next one is written. Self loops and repeated edges are allowed.
    """
    stars = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_contract, "u long, v long")
    now = materialize(stars.distinct(), f"{label}-edges")
    before = None
    for _ in range(most_rounds):
        # large-star: every larger neighbour of a node is tied to the smallest in its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{label}-min")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{label}-large")
        discard(least, now)
        # small-star: a node and its smaller neighbours are tied to the smallest of these
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-min")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-edges")
        discard(least, large)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state["n"] == 0 or (before is not None and (state["n"], state["x"]) == before):
            break
        before = (state["n"], state["x"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
