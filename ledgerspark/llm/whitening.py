"""Embedding whitening with a covariance by polarisation.

Entries become integers (256ths), and the fit list holds each distinct vector once. With
n vectors of sums S, y = n x - S is a centred vector without rounding. One pass adds up
the exact squares of every dimension, Q_i = sum y_i^2, and of every sum of two,
Q_ij = sum (y_i + y_j)^2; half of Q_ij - Q_i - Q_j is the cross term, an integer too, and
divided by n^3 it is the covariance, rounded once. The matrix is as large as the number of
dimensions squared, whatever the rows; ``eigh`` takes it on the driver.

Tasks compute in 64-bit integers: squares that could overflow are taken from three limbs
of 21 bits, and vectors beyond 2^61 from Python's integers. Sums travel as limbs of 40 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE = 256                     # fixed by the contract
COMPONENTS = 4
ROWS = 1024                     # vectors that a task computes with at a time
LIMB, LIMBS = 40, 6             # bits; together more than the square of any sum


def integer_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, x), dimensions). Rows whose vector is null, empty or holds null or
    non-finite entries are dropped, and those that are not of the commonest length (of
    equally common ones, the longest)."""
    c = F.col("embedding")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long"))
    rows = embeddings.filter(c.isNotNull() & (F.size(c) > 0) & ~bad).select("vec_id", x.alias("x"))
    d = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    d = d["d"] if d else 0
    return rows.filter(F.size("x") == d), d


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow batch, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact: 64-bit integers, or Python's where these could overflow."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(z: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of the columns, as Python integers."""
    if z.dtype == object:
        return (z * z).sum(axis=0)
    most = max(int(z.max()), -int(z.min()))
    if most * most * len(z) < 1 << 63:
        return np.einsum("ij,ij->j", z, z).astype(object)
    limbs = [z >> 42, (z >> 21) & 0x1FFFFF, z & 0x1FFFFF]
    out = 0
    for i in range(3):
        for j in range(i, 3):
            part = np.einsum("ij,ij->j", limbs[i], limbs[j]).astype(object)
            out = out + part * ((1 + (i != j)) << 21 * (4 - i - j))
    return out


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Q_0 ... Q_d-1, then Q_01, Q_02, ... of the centred rows."""
    d = y.shape[1]
    return np.concatenate([square_sums(y)] + [square_sums(y[:, i + 1:] + y[:, i:i + 1]) for i in range(d - 1)])


def exact_totals(fit: DataFrame, fn) -> list[int]:
    """Sums over all rows of ``fn`` (matrix of some vectors -> row of Python integers)."""
    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                part = fn(x[at:at + ROWS])
                total = part if total is None else total + part
        if total is not None:
            low, top = (1 << LIMB) - 1, LIMBS - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)))]
                + [pa.array([int(v) >> LIMB * k & low if k < top else int(v) >> LIMB * k for v in total], pa.int64())
                   for k in range(LIMBS)], names=["at", *limbs])

    limbs = [f"l{k}" for k in range(LIMBS)]
    rows = fit.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in ["at", *limbs])).groupBy("at").agg(*map(F.sum, limbs))
    return [sum(v << LIMB * k for k, v in enumerate(r[1:])) for r in sorted(map(tuple, rows.collect()))]


def covariance(squares: list[int], n: int, d: int) -> np.ndarray:
    """The covariance matrix from the sums of :func:`pair_squares`, each entry rounded once."""
    v = np.zeros((d, d))
    at = d
    for i in range(d):
        v[i, i] = squares[i] / n ** 3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (squares[at] - squares[i] - squares[j]) // 2 / n ** 3
            at += 1
    return v


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the components of positive
    variance, ``components`` at most. Of each vector the largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:components] > 8 * len(v) * np.finfo(float).eps * max(e[0], 0.0)).sum())
    e, u = e[:k], u[:, :k]
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])


def _projected(y: np.ndarray, n: int, e: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (y / n).astype(float) @ (u / np.sqrt(e))


def _identity_error(fit: DataFrame, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity. The rows are
    centred, so is what is left of their mean by rounding."""
    k = len(e)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((k + 1, k))
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                w = _projected(centred(x[at:at + ROWS], n, sums), n, e, u)
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    total = np.zeros((k + 1) * k)
    for at, value in fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        total[at] = value
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: vec_id, component (from 1), n (size of the fit
    list), deviation (exact sum over the dimensions of (n x - S)^2; null beyond the range
    of long), whitened, explained (share of the variance), identity_error (one value).

    Dropped vectors: see :func:`integer_vectors`. Entries beyond the range of long are its
    ends. Copies count once in the fit list and get rows of their own; a null vec_id is
    kept. Components without variance are left out, so equal vectors alone, a single one
    or an empty table give no rows. Further columns are ignored."""
    rows, d = integer_vectors(embeddings)
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(
        embeddings.schema["vec_id"].dataType.simpleString())
    if not d:
        return embeddings.sparkSession.createDataFrame([], out)
    fit = staged(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = exact_totals(fit, lambda x: x.astype(object).sum(axis=0))
    squares = exact_totals(fit, lambda x: pair_squares(centred(x, n, sums)))
    v = covariance(squares, n, d)
    e, u = principal(v, components)
    if not len(e):
        return embeddings.sparkSession.createDataFrame([], out)
    trace = sum(squares[:d]) / n ** 3
    error = _identity_error(fit, n, sums, e, u)
    k = len(e)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = centred(_matrix(part.column(1)), n, sums)
                m = len(y)
                deviation = [int(s) if s < 1 << 63 else None for s in square_sums(y.T)]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(each),
                     pa.array(_projected(y, n, e, u).ravel()), pa.array(np.tile(e / trace, m)),
                     pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select("vec_id", "x").mapInArrow(run, out)
