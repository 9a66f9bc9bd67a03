"""Embedding whitening: principal components by a randomised range finder, each vector projected on them at unit variance.

Components become whole numbers x = floor(scale * c) + shift, so sums and deviations are exact.  The covariance V of all
rows is never formed at first:

1. Range finder.  A random basis of the wanted components and ``oversample`` more is multiplied with V in passes over all rows: a task
   centres its rows, takes X'(X Q) and hands on one small matrix, which Spark sums up.  Between passes the basis is made orthonormal.
2. Rayleigh-Ritz.  Q'VQ is solved on the driver, and the residuals V u - e u come out of the same pass.  If any is too large against the gap
   to the next eigenvalue (a flat spectrum, where power passes help little), the basis grows to the full dimension, where Rayleigh-Ritz
   is exact to double precision.
3. One more pass takes the covariance of the whitened rows, which shows what the result is worth.

Everything on the driver has the size of a basis, dimension x dimension at most.

Defined cases: vectors that are null, hold null or non-finite components, or components for which scale * c leaves +-2**53, take no part;
neither do empty ones; vectors of each length are whitened among themselves, one length after the other; components without variance
(below 1e-12 of the largest) are left out, so equal vectors alone give no rows; repeated rows count each; rows with a null vec_id count and come
back; an empty table gives no rows; columns other than vec_id and embedding are not read.  vec_id must be a number or its text.
A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable

LARGEST = 2.0**53


def whole_vectors(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    v = F.col("embedding")
    scaled = lambda c: F.floor(c.cast("double") * scale)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < LARGEST))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: scaled(c) + shift).alias("x"))


def _rows(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and whole sums of each dimension; a task adds the upper and lower halves of the numbers apart, so nothing overflows."""

    def add(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _rows(batch.column(0), width)
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(add, "i long, n long, high long, low long")
    total = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # one row for each dimension
    return (int(total[0]["n"]) if total else 0), [(int(t["high"]) << 26) + int(t["low"]) for t in total]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as whole numbers (Python's own where a long could overflow)."""
    most = max(int(np.abs(x).max()) if x.size else 0, 1)
    if n * most < 2**62 and max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def summed_matrix(rows: DataFrame, width: int, shape: tuple[int, int], of) -> np.ndarray:
    """Sum over all rows of the matrices that ``of`` makes of each batch's x; tasks hand on one row for each line of theirs."""

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            x = _rows(batch.column(0), width)
            for a in range(0, len(x), 4096):
                total += of(x[a : a + 4096])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, shape[1]), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), lists], names=["i", "line"])

    parts = rows.select("x").mapInArrow(add, "i long, line array<double>")
    cells = parts.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    lines = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v")))["v"].alias("line")).orderBy("i").collect()
    return np.array([r["line"] for r in lines])


@dataclass
class Components:
    """n, sums: rows and whole sums of each dimension; values, vectors: eigenvalues and unit eigenvectors (columns), falling;
    trace of the covariance; passes over the rows; full: whether the basis had to grow to the full dimension."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    full: bool


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and the lengths of their residuals; image: the covariance times the basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    return values, basis @ turn, np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)


def converged(values: np.ndarray, residuals: np.ndarray, wanted: int, tolerance: float) -> bool:
    """Whether the residuals of the wanted values are small against the gaps to their neighbours, so that the vectors are right too."""
    if len(values) <= wanted:
        return False
    gaps = -np.diff(values[: wanted + 1])
    near = np.minimum(gaps[:wanted], np.concatenate([[np.inf], gaps[: wanted - 1]]))
    return bool((residuals[:wanted] <= tolerance * np.maximum(near, 0)).all())


def principal_components(rows: DataFrame, width: int, wanted: int = 32, oversample: int = 8, power_passes: int = 3, tolerance: float = 1e-10, seed: int = 11) -> Components:
    """The first eigenvectors of the covariance of (vec_id, x), all x of one width; rows should be durable, as they are read in each pass."""
    n, sums = exact_sums(rows, width)
    if not n:
        return Components(0, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 1, False)

    def times(basis: np.ndarray) -> np.ndarray:
        """The covariance times a basis, and the trace in one more column."""

        def of(x):
            centred = deviations(x, n, sums).astype(np.float64) / n
            return np.concatenate([centred.T @ (centred @ basis), (centred * centred).sum(0)[:, None]], axis=1)

        return summed_matrix(rows, width, (width, basis.shape[1] + 1), of) / n

    first = min(wanted, width)
    size = min(width, first + oversample)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))
    image = times(basis)
    passes, full = 2, size == width
    values, vectors, residuals = ritz(basis, image[:, :-1])
    while not full and passes < 2 + power_passes and not converged(values, residuals, first, tolerance):
        basis, _ = np.linalg.qr(image[:, :-1])
        image = times(basis)
        passes += 1
        values, vectors, residuals = ritz(basis, image[:, :-1])
    if not full and not converged(values, residuals, first, tolerance):
        extra = np.random.default_rng(seed + 1).normal(size=(width, width - size))
        basis, _ = np.linalg.qr(np.concatenate([basis, extra], axis=1))  # the basis found, completed
        image = times(basis)
        passes, full = passes + 1, True
        values, vectors, residuals = ritz(basis, image[:, :-1])
    keep = np.flatnonzero(values[:first] > 1e-12 * max(values[0], 0.0)) if len(values) else []
    keep = [k for k in keep if values[k] > 0]
    return Components(n, sums, values[keep], vectors[:, keep], float(image[:, -1].sum()), passes, full)


def whitened_error(rows: DataFrame, width: int, c: Components) -> float:
    """Largest entry of the whitened rows' covariance less the identity, by a pass over all rows."""
    k = len(c.values)
    turn = c.vectors / np.sqrt(c.values)

    def of(x):
        w = (deviations(x, c.n, c.sums).astype(np.float64) / c.n) @ turn
        return np.concatenate([w.T @ w, w.sum(0)[None]])

    sums = summed_matrix(rows, width, (k + 1, k), of) / c.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, wanted: int = 32, scale: int = 64, shift: int = 1_000_000, **how) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component from 1."""
    rows = durable(whole_vectors(vectors, scale, shift).withColumn("width", F.size("x")), "whole")
    out = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):  # one row for each length of vectors
        own = rows.where(F.col("width") == width).select("vec_id", "x")
        c = principal_components(own, width, wanted, **how)
        if len(c.values):
            out = out.unionByName(projected(own, width, c, whitened_error(own, width, c)))
    return out


def projected(rows: DataFrame, width: int, c: Components, error: float) -> DataFrame:
    """The rows of ``whiten`` for vectors of one length."""
    k = len(c.values)
    turn, explained = c.vectors / np.sqrt(c.values), c.values / c.trace

    def project(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                away = deviations(_rows(part.column(1), width), c.n, c.sums)
                white = (away.astype(np.float64) / c.n) @ turn
                most = float(np.abs(away.astype(np.float64)).max())
                if width * most * most < 2.0**62:
                    size = pa.array((away * away).sum(1).astype(np.int64))
                else:
                    size = pa.array([s if s < 2**63 else None for s in (away.astype(object) ** 2).sum(1).tolist()], pa.int64())
                each = pa.array(np.repeat(np.arange(part.num_rows), k))
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, c.n)),
                        size.take(each),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
