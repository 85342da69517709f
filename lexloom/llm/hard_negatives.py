"""Hard-negative mining with bit-sliced integer inner products.

Components become integers, and these bit-planes. The product of the anchors with a plane of a block of rows is one matrix product; planes are taken most
significant first. After each, a pair's score lies in an interval: what has been summed, plus what the lower planes can still take away or add, by the sums of the
anchor's negative and positive components. A pair is dropped once its interval lies outside all of the anchor's windows, or below the worst of the best scores that the
anchor has in them already. While many pairs are open the planes are multiplied as matrices, then pair by pair. Intervals are bounds, so that the results are exact.

Anchors are dealt to blocks and rows to parts; a pair of them is a task's group, of bounded size, and returns an anchor's best rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors of a block and rows of a part, on average; anchors and rows multiplied at a time; share of open pairs below which they are taken one by one.
BLOCK, PART, TILE, SPARSE = 2_048, 16_384, 1_024, 1 / 16
#: Components beyond this can't be scored within a long.
MOST = float(1 << 31)


def _number(bound: float):
    """The type in which sums up to bound are exact."""
    if bound >= 2.0**62:
        raise OverflowError("the scores don't fit a long")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def sliced_scores(q: np.ndarray, x: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs of rows of q and x (integers) that fits lets through to the end.

    fits(i, j, low, high) says for pairs (index arrays that broadcast) whether a score in [low, high] may be wanted.
    """
    q, x = (a if a.shape[1] else np.zeros((len(a), 1), np.int64) for a in (q, x))
    least = x.min(0)
    u = x - least  # not negative, so that all planes count upwards
    bits = int(u.max()).bit_length()
    size = np.abs(q).sum(1).astype(float).max()
    kind = _number(size * (float(u.max()) + float(np.abs(least).max()) + 1))
    qs = q.astype(kind)
    more, less = np.maximum(q, 0).sum(1).astype(kind), np.minimum(q, 0).sum(1).astype(kind)
    i, j = np.arange(len(q)), np.arange(len(x))
    score = np.repeat((q @ least).astype(kind)[:, None], len(x), 1)
    bit = bits
    open_ = fits(i[:, None], j[None, :], score + less[:, None] * kind((1 << bit) - 1), score + more[:, None] * kind((1 << bit) - 1))
    while bit and open_.mean() > SPARSE:
        r, c = open_.any(1), open_.any(0)
        if not r.all() or not c.all():
            i, j, score = i[r], j[c], score[np.ix_(r, c)]
        bit -= 1
        score = score + qs[i] @ ((u[j] >> bit) & 1).T.astype(kind) * kind(1 << bit)
        rest = kind((1 << bit) - 1)
        open_ = fits(i[:, None], j[None, :], score + less[i, None] * rest, score + more[i, None] * rest)
    r, c = np.nonzero(open_)
    out = []
    for k in range(0, len(r), 1 << 16):
        a, b, s = i[r[k : k + (1 << 16)]], j[c[k : k + (1 << 16)]], score[r[k : k + (1 << 16)], c[k : k + (1 << 16)]]
        for at in range(bit - 1, -1, -1):
            s = s + np.einsum("ij,ij->i", qs[a], ((u[b] >> at) & 1).astype(kind)) * kind(1 << at)
            rest = kind((1 << at) - 1)
            left = fits(a, b, s + less[a] * rest, s + more[a] * rest)
            a, b, s = a[left], b[left], s[left]
        out.append((a, b, s.astype(np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Best:
    """The k best rows of each anchor in each of its windows so far; ties go to the row of smaller number."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.worst = low.astype(float)  # a score must reach it: the window's end, later the k-th best score
        self.rows = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in range(low.shape[1])]
        self._bounds()

    def _bounds(self) -> None:
        some = self.low <= self.high
        self.least = np.where(some, self.worst, np.inf).min(1)
        self.most = np.where(some, self.high, -np.inf).max(1)

    def may_enter(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a score in [low, high] may be one of anchor i's best: dense over the hull of its windows, for single pairs by each window."""
        fits = (high >= self.least[i]) & (low <= self.most[i])
        if i.ndim == 1:
            fits &= ((high[:, None] >= self.worst[i]) & (low[:, None] <= self.high[i]) & (self.low[i] <= self.high[i])).any(1)
        return fits

    def add(self, i: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            own = (score >= self.worst[i, w]) & (score <= self.high[i, w])
            if not own.any():
                continue
            a, r, s = (np.concatenate([old, new[own]]) for old, new in zip(self.rows[w], (i, row, score)))
            order = np.lexsort((r, -s, a))
            a, r, s = a[order], r[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            kept = place < self.k
            a, r, s, place = a[kept], r[kept], s[kept], place[kept]
            self.rows[w] = a, r, s
            full = place == self.k - 1
            self.worst[a[full], w] = s[full]
        self._bounds()


def _search(k: int, same: bool, low_percent: int | None, high_percent: int | None):
    """The k best rows of each anchor of a group by window: rows of its label (same), one window without ends, or rows of other labels, a window for each positive score."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": np.empty(0, np.int64), "place": np.empty(0, np.int32), "uid": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "no_id": np.empty(0, bool), "score": np.empty(0, np.int64)})
        if not len(anchors) or not len(rows):
            return none
        rows = rows.sort_values(["no_id", "vec_id", "uid"])  # a smaller number wins ties
        x, x_uid, x_label = np.stack(rows["x"]).astype(np.int64), rows["uid"].to_numpy(), rows["label"].to_numpy()
        x_id, no_id = rows["vec_id"].to_numpy(), rows["no_id"].to_numpy()
        out = [none]
        for k0 in range(0, len(anchors), TILE):
            some = anchors.iloc[k0 : k0 + TILE]
            q, q_uid, q_label = np.stack(some["x"]).astype(np.int64), some["uid"].to_numpy(), some["label"].to_numpy()
            if same:
                low, high = np.full((len(q), 1), -(1 << 62)), np.full((len(q), 1), 1 << 62)
            else:
                width = max(map(len, some["scores"]))
                low, high = np.ones((len(q), width), np.int64), np.zeros((len(q), width), np.int64)  # low > high: no window
                for a, scores in enumerate(some["scores"]):
                    s = np.asarray(scores, np.int64)
                    low[a, : len(s)], high[a, : len(s)] = -(-low_percent * s // 100), high_percent * s // 100
            best = Best(low, high, k)
            at, step = 0, TILE // 4
            while at < len(x):
                uid, label = x_uid[at : at + step], x_label[at : at + step]

                def fits(i, j, lower, upper):
                    return best.may_enter(i, lower, upper) & ((q_label[i] == label[j]) == same) & (q_uid[i] != uid[j])

                i, j, score = sliced_scores(q, x[at : at + step], fits)
                best.add(i, at + j, score)
                at, step = at + step, TILE
            for place, (i, j, score) in enumerate(best.rows):
                out.append(pd.DataFrame({"anchor": q_uid[i], "place": np.full(len(i), place, np.int32), "uid": x_uid[j], "vec_id": x_id[j], "no_id": no_id[j], "score": score}))
        return pd.concat(out, ignore_index=True)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "no_id", "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id"))).drop("no_id")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that anchor holds for, and each of its first positives other rows of the same label, the first
    negatives rows of other labels whose score is between low_percent and high_percent of the positive's.

    Scores are inner products of floor(scale * component) with the anchor, exact; higher ones come first, ties by smaller id (null last), equal ids in the order they are read.
    Rows with a null label, a null vector, or a null or non-finite component take no part; rows of different length aren't compared, empty vectors score 0. Repeated rows count as
    rows, also as an anchor's own copies; an anchor is never its own positive. An empty table gives no rows; other columns are ignored. Scaled components of 2^31 and more, or scores beyond a long, are an error.
    """
    e = F.col(vec_col).cast("array<double>")
    good = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(e, lambda c: F.when(F.abs(c * scale) < MOST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to be scored"))).cast("int"))
    rows = vectors.where(F.col(label_col).isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), whole.alias("x"))
    rows = materialize(rows.withColumn("size", F.size("x")), "vectors")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    parts, blocks = -(-max(count["n"], 1) // PART), -(-max(count["a"], 1) // BLOCK)
    again = rows.sparkSession.read.schema(rows.schema).parquet(rows._written)  # of its own, as both sides of a cogroup come from the table
    dealt = again.select("size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), "uid", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "label", "x")
    anchors = rows.where("is_anchor").select("size", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "uid", "label", "x")
    key, kind = ("size", "block", "part"), "anchor long, place int, uid long, vec_id long, no_id boolean, score long"

    def best(of: DataFrame, k: int, same: bool) -> DataFrame:
        run = _search(k, same, low_percent, high_percent)
        return _ranked(of.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(lambda a, b: run(a, b), kind), k)

    near = materialize(best(anchors, positives, True).select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    hard = best(anchors.join(windows.withColumnRenamed("anchor", "uid"), "uid"), negatives, False).drop("uid")
    names = rows.where("is_anchor").select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(near, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
