"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers, ``floor(scale * entry) + offset``, so that sums and
deviations are exact. The fit list holds each distinct vector once, written to
the shared folder; every pass reads it there.

Let A be the fit list's centred rows (n x d). A pass takes Gram matrices of
A R^-1 inside tasks, where R is the triangular factor found so far and the rows
go through one triangular solve a factor, and adds them up over tasks. The
Cholesky factor of their sum joins R. The first pass shifts the diagonal, so
that the factor exists whatever the condition of A; each further pass makes the
rows more nearly orthogonal, until their Gram matrix is the identity to
``TOLERANCE`` or, where A lacks rank, ``PASSES`` are done. Then A = Q R with
orthogonal Q, and the singular values and right singular vectors of R, a d x d
matrix, are those of A: squared and over n, the eigenvalues of the covariance,
to more digits than its own eigenvectors would have. Only d x d matrices reach
the driver, ``HEAPS`` of them at most.

Defined results. Vectors that are null, or hold null or non-finite entries, take
no part; nor do empty ones, those of another width than the most frequent (of
equals the larger), and those with an entry whose whole number is beyond
``LARGEST``, where sums would not be exact. Repeated rows are returned each, and
count once in the fit. A null id stays null. Components of no variance (not
above rounding) cannot be whitened and are left out, so that one distinct vector
or an empty table gives an empty result. ``deviation`` is null where it exceeds a
long. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import drop_kept, keep, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: The largest whole number that takes part.
LARGEST = 1 << 40
#: Largest entry of a Gram matrix less the identity at which passes end; most passes; partial sums that reach the driver; rows of one product.
TOLERANCE, PASSES, HEAPS, SLICE = 1e-13, 6, 8, 4096


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x, the whole numbers of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda c: c.cast("double")).alias("c")).where("size(c) > 0")
    scaled = F.transform("c", lambda c: F.floor(c * SCALE))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < (LARGEST - OFFSET) / SCALE))
    return rows.where(F.coalesce(fine, F.lit(False))).select("id", F.transform(scaled, lambda c: c + OFFSET).alias("x"))


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Slices of a column of lists of one width, as matrices."""
    for at in range(0, len(column), SLICE):
        part = column.slice(at, SLICE)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _summed(df: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum of ``add(rows)`` over a table of vectors x: in each task, then over HEAPS heaps, then here."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for x in _rows(batch.column(0)):
                total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for s in batch.column(0):
                total += np.frombuffer(s.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = df.select("x").mapInArrow(own, "s binary").repartition(HEAPS).mapInArrow(joined, "s binary").collect()
    return sum((np.frombuffer(r["s"], kind).reshape(shape) for r in parts), np.zeros(shape, kind))


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: n times the deviation from the mean, exact (whole numbers up to LARGEST and n up to 2**22 fit; beyond, Python's)."""
    if n < 1 << 22:
        return n * x - sums
    low = sums // n  # the whole part of the mean leaves small numbers to multiply
    d = x - low
    if int(np.abs(d).max(initial=0)) < (1 << 62) // n:
        return n * d - (sums - n * low)
    return (n * d.astype(object)) - (sums - n * low)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: size and sums of the fit list, components in rows, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _spread(x, self.n, self.sums).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact."""
        d = _spread(x, self.n, self.sums)
        most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if most * most * max(d.shape[1], 1) >= 1 << 63:
            d = d.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(axis=1))]


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R^-1, one triangular solve a factor."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def fit(listed: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list of distinct vectors x of one width."""
    counted = _summed(listed, (width + 1,), lambda x: np.append(x.sum(axis=0), len(x)), np.int64)
    n, sums = int(counted[-1]), counted[:-1]
    if n == 0:
        return Whitening(0, sums, np.zeros((0, width)), np.zeros(0), 0.0, 0)
    empty = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0, 0)
    factors: list[np.ndarray] = []
    for _ in range(PASSES):

        def gram(x: np.ndarray) -> np.ndarray:
            q = _solved(empty.centred(x), factors)
            return q.T @ q

        g = _summed(listed, (width, width), gram, np.float64)
        norm = np.linalg.norm(g, 2)
        if norm == 0:
            return empty
        if factors and np.abs(g - np.eye(width)).max() <= TOLERANCE:
            break
        shift = 11 * (n * width + width * (width + 1)) * np.finfo(float).eps / 2 * norm
        try:
            factor = np.linalg.cholesky(g if factors else g + min(shift, 1e-3 * norm) * np.eye(width)).T
        except np.linalg.LinAlgError:  # no full rank, or not yet
            factor = np.linalg.cholesky(g + min(shift, 1e-3 * norm) * np.eye(width)).T
        factors.append(factor)
    r = factors[0]
    for factor in factors[1:]:
        r = factor @ r
    _, s, v = np.linalg.svd(r)
    varied = s > s[0] * max(n, width) * np.finfo(float).eps
    e = s * s / n
    some = np.flatnonzero(varied)[:components]
    return Whitening(n, sums, v[some], e[some], float(e.sum()), len(factors))


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def gram(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(listed, (k + 1, k), gram, np.float64) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row for each row (id, x) and component."""
    kind = rows.schema["id"].dataType.simpleString()
    k = len(model.eigenvalues)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.eigenvalues / model.trace
        for batch in batches:
            at = 0
            for x in _rows(batch.column(1)):
                m = len(x)
                each = np.repeat(np.arange(m), k)
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation,
                        pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names,
                )
                at += m

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows if k else rows.limit(0)).mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of every vector that takes part."""
    rows = whole_numbers(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 1
    rows = rows.where(F.size("x") == width)
    listed = keep(rows.select("x").distinct(), "fit")
    model = fit(listed, width, components)
    error = identity_error(listed, model)
    drop_kept(listed)
    return whitened(rows, model, error).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
