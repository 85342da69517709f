"""Embedding whitening by a randomised range finder.

The leading eigenvectors of the covariance V are sought in the range of V times a random matrix of a few more columns than components are wanted. Each pass over all rows
multiplies V with an orthonormal basis: the rows are centred, and the sum of row times (row times basis) over all of them is the product, so that V itself is never
formed. A pass is a power step and gives the Rayleigh-Ritz problem of its basis as well, whose residuals show how far the pairs are from eigenpairs. Where they don't fall under
the tolerance within a few passes, the basis is doubled, up to the full dimension, where Rayleigh-Ritz is exact.

Only d x basis matrices reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, materialize

#: Columns beyond the wanted ones, passes at one width, and the residual (in largest eigenvalues) from which a pair counts as an eigenpair.
OVERSAMPLING, PASSES, TOLERANCE = 8, 4, 1e-13
#: An eigenvalue below this share of the trace, times the dimension, is rounding.
NOTHING = 2.0**-50


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of d integers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus the mean, from exact integers n * x - sums."""
    return _apart(x, n, sums).astype(np.float64) / n


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if float(np.abs(x).max(initial=0)) * n >= 2.0**62:
        raise OverflowError("n * x doesn't fit a long")
    return n * x - sums


def _entries(*matrices: np.ndarray) -> pa.RecordBatch:
    """(part, i, j, v) of the entries of matrices."""
    part, i, j, v = [], [], [], []
    for k, m in enumerate(matrices):
        r, c = np.indices(m.shape).reshape(2, -1)
        part.append(np.full(m.size, k, np.int32))
        i.append(r.astype(np.int32))
        j.append(c.astype(np.int32))
        v.append(m.ravel().astype(np.float64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (part, i, j, v)], ["part", "i", "j", "v"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, SLICE_ROWS) for batch in batches for k in range(0, batch.num_rows, SLICE_ROWS))


def _summed(rows: DataFrame, shapes: list[tuple[int, int]], of) -> list[np.ndarray]:
    """The sums over all rows of the matrices that of gives for a block of them: a row an entry and task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in shapes]
        for batch in _slices(batches):
            for t, m in zip(total, of(batch)):
                t += m
        yield _entries(*total)

    out = [np.zeros(s) for s in shapes]
    for r in rows.mapInArrow(run, "part int, i int, j int, v double").groupBy("part", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["part"]][r["i"], r["j"]] = r["v"]
    return out


class Fit:
    """Components of the rows of x (array<bigint> of length d): sums, eigenvectors by falling eigenvalue, eigenvalues, trace, number of passes."""

    def __init__(self, rows: DataFrame, n: int, d: int, components: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 13):
        self.n, self.d, self.k = n, d, min(components, d)
        x = rows.select("x")
        self.sums = np.zeros(d, np.int64)
        for r in x.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect():  # one row a dimension
            self.sums[r["i"]] = r["s"]
        rng = np.random.default_rng(seed)
        width = min(d, self.k + oversampling)
        basis = np.linalg.qr(rng.standard_normal((d, width)))[0]
        self.passes = 0
        while True:
            left = passes
            while True:
                image = self._pass(x, basis)
                ritz = basis.T @ image
                values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
                values, turn = values[::-1], turn[:, ::-1]
                vectors, image = basis @ turn, image @ turn
                residual = np.linalg.norm(image - vectors * values, axis=0)[: self.k].max()
                left -= 1
                if width == d or residual <= tolerance * values[0]:
                    self._keep(vectors, values)
                    return
                if not left or residual * (max(values[-1], 0) / values[self.k - 1]) ** left > tolerance * values[0]:
                    break  # at this rate the passes won't do
                basis = np.linalg.qr(image)[0]
            width = min(d, 2 * width)
            basis = np.linalg.qr(np.hstack([image, rng.standard_normal((d, width - image.shape[1])) * values[0]]))[0]

    def _pass(self, x: DataFrame, basis: np.ndarray) -> np.ndarray:
        """V times basis; sets the trace and the mean that rounding leaves in centred rows."""
        n, d, sums = self.n, self.d, self.sums

        def of(batch: pa.RecordBatch):
            c = _centred(_matrix(batch.column(0), d), n, sums)
            return c.T @ (c @ basis), (c * c).sum(0)[None], c.sum(0)[None]

        image, squares, rest = _summed(x, [basis.shape, (1, d), (1, d)], of)
        self.trace, self.rest = squares.sum() / n, rest[0] / n
        self.passes += 1
        return image / n

    def _keep(self, vectors: np.ndarray, values: np.ndarray) -> None:
        vectors, values = vectors[:, : self.k], values[: self.k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(self.k)] < 0, -1, 1)
        self.vectors, self.values = vectors, np.maximum(values, 0)
        self.some = values > NOTHING * self.d * self.trace
        self.whitener = np.where(self.some, vectors / np.sqrt(np.where(self.some, values, 1)), 0.0)
        self.explained = np.where(self.some, self.values / self.trace, 0.0) if self.trace > 0 else np.zeros(self.k)

    def identity_error(self, rows: DataFrame) -> float:
        """The largest absolute entry of the covariance of all whitened rows minus the identity, over components with variance."""
        n, d, sums, whitener = self.n, self.d, self.sums, self.whitener
        mean = self.rest @ whitener

        def of(batch: pa.RecordBatch):
            z = _centred(_matrix(batch.column(0), d), n, sums) @ whitener - mean
            return (z.T @ z,)

        covariance = _summed(rows.select("x"), [(self.k, self.k)], of)[0] / n
        off = np.abs(covariance - np.eye(self.k))[np.ix_(self.some, self.some)]
        return float(off.max(initial=0.0))


def _lengths(rows: DataFrame) -> dict[int, int]:
    return {r["size"]: r["n"] for r in rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, numbered from 1 by falling eigenvalue.

    Vectors become integers floor(scale * c) + offset; all are fitted, repeated ones as often as they occur. n: their number; deviation: the sum over dimensions of (n * x - sum)^2, exact;
    whitened: the centred vector projected on the component, over the root of its eigenvalue; explained: the eigenvalue's share of the trace; identity_error: see Fit. Rows whose vector is null or holds null or non-finite entries
    are dropped, a null id is kept. Vectors of different length are lists of their own, each whitened by itself; one of d dimensions has d components at most, an empty vector none. Components without variance (a single row, equal rows)
    give 0 as whitened and explained. Equal eigenvalues leave their components free within their space. An empty table gives no rows; other columns are ignored, whatever their names. A component
    whose scaled value or whose deviation doesn't fit a long is an error.
    """
    e = F.col(vec_col).cast("array<double>")
    good = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(e, lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale) + F.lit(offset).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("vec_id"), whole.alias("x"))
    rows = materialize(rows, "vectors")
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = [_whitened(rows.where(F.size("x") == d), n, d, components, kind) for d, n in sorted(_lengths(rows).items()) if d]
    if not out:
        return vectors.sparkSession.createDataFrame([], kind)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _whitened(rows: DataFrame, n: int, d: int, components: int, kind: str) -> DataFrame:
    fit = Fit(rows, n, d, components)
    sums, whitener, explained, k, error = fit.sums, fit.whitener, fit.explained, fit.k, fit.identity_error(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch.column(1), d)
            apart, m = _apart(x, n, sums), batch.num_rows
            if m and (np.square(apart.astype(float)).sum(1) >= 2.0**63).any():
                raise OverflowError("a deviation doesn't fit a long")
            of = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(np.square(apart).sum(1), k)),
                    pa.array((apart.astype(np.float64) / n @ whitener).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, kind)
