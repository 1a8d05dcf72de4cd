"""Embedding whitening: leading principal components by Jacobi-Davidson over distributed products.

The covariance is never formed. A product centres each distinct vector inside its task, multiplies there, and only sums
of the size of the asked block leave the tasks. The driver holds matrices of dimension x a few times the number of components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import StageArea
from .common import column

# Fixed values of the integer coordinates.
STEPS, SHIFT = 64, 1_000_000
#: a residual of this share of the largest eigenvalue counts as double precision
RESIDUAL = 1e-13
#: eigenvalues below this share of the largest one are rounding: the data has no such direction
RANK = 1e-12
#: MINRES steps for one correction at most, and the share of the residual where they end
INNER_STEPS, INNER_SHARE = 8, 0.05
#: rounds of corrections at most
ROUNDS = 500

Product = Callable[[np.ndarray], np.ndarray]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=0))


def minres(apply: Product, b: np.ndarray, steps: int = INNER_STEPS, share: float = INNER_SHARE) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column of ``b``; all go in step, so ``apply`` gets them at once."""
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    beta = _norms(b)
    first = beta.copy()
    v = b / np.where(beta > 0, beta, 1)
    eta, cos, cos_old = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sin, sin_old = np.zeros_like(beta), np.zeros_like(beta)
    going = beta > 0
    for _ in range(steps):
        if not going.any():
            break
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_next = _norms(p)
        delta = cos * alpha - cos_old * sin * beta
        above, higher = sin * alpha + cos_old * cos * beta, sin_old * beta
        pivot = np.hypot(delta, beta_next)
        going &= pivot > 0
        pivot = np.where(going, pivot, 1)
        w_next = (v - higher * w_old - above * w) / pivot
        cos_old, sin_old = cos, sin
        cos, sin = delta / pivot, beta_next / pivot
        x += np.where(going, cos * eta * w_next, 0)
        eta = -sin * eta
        going &= (np.abs(eta) > share * first) & (beta_next > 1e-14 * first)
        v_old, v = v, p / np.where(beta_next > 0, beta_next, 1)
        w_old, w, beta = w, w_next, beta_next
    return x


def _basis(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """``new`` made orthonormal to ``held`` and in itself; columns that are nothing new are dropped."""
    out = np.zeros((len(new), 0))
    for c in range(new.shape[1]):
        t = new[:, c]
        size = np.sqrt(t @ t)
        if size == 0:
            continue
        t = t / size
        for _ in range(3):
            for q in (*held, out):
                t = t - q @ (q.T @ t)
            left = np.sqrt(t @ t)
            if left < 1e-10:
                break
            t = t / left
        if left >= 1e-10:
            out = np.column_stack((out, t))
    return out


def leading(product: Product, d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors of a symmetric matrix that is known by its product.

    Rayleigh-Ritz on a growing subspace. Ritz pairs at double precision are locked; for the others MINRES solves the
    correction equations, projected off the locked vectors and off the own Ritz vector. Full subspaces restart from
    their best Ritz vectors.
    """
    k = min(k, d)
    most = min(d, 4 * k)
    draws = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    v = _basis(draws.standard_normal((d, k)))
    w = product(v)
    scale = 0.0
    for _ in range(ROUNDS):
        theta, s = np.linalg.eigh((h := v.T @ w) / 2 + h.T / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, w = v @ s, w @ s
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        r = w - v * theta
        r -= locked @ (locked.T @ r)
        whole = v.shape[1] + locked.shape[1] == d  # the subspace is the space: nothing is left to correct
        good = (_norms(r) <= RESIDUAL * scale) | whole
        n = int(np.argmin(np.append(good, False)))  # leading pairs that are done
        # a pair is locked only while it is among the k best
        locked, values = np.column_stack((locked, v[:, :n])), np.append(values, theta[:n])
        v, w, r, theta = v[:, n:], w[:, n:], r[:, n:], theta[n:]
        if whole or (len(values) >= k and (not len(theta) or theta[0] <= np.sort(values)[-k])):
            order = np.argsort(-values, kind="stable")[:k]
            return values[order], locked[:, order]
        want = min(max(k - len(values), 1), v.shape[1])
        if v.shape[1] + want > most and v.shape[1] > 2 * want:
            v, w = v[:, : 2 * want], w[:, : 2 * want]
        u, value = v[:, :want], theta[:want]

        def off(y: np.ndarray, u: np.ndarray = u) -> np.ndarray:
            y = y - locked @ (locked.T @ y)
            return y - u * (u * y).sum(axis=0)

        def apply(y: np.ndarray, value: np.ndarray = value) -> np.ndarray:
            y = off(y)
            return off(product(y) - y * value)

        new = _basis(minres(apply, off(-r[:, :want])), locked, v)
        if not new.shape[1]:
            new = _basis(draws.standard_normal((d, 1)), locked, v)
        v, w = np.column_stack((v, new)), np.column_stack((w, product(new)))
    raise RuntimeError("no double precision within the rounds")


@dataclass(frozen=True)
class Centre:
    """Number and per-dimension sums of the fit list, exact, as the whole and the rest of the means."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers first, so that nothing is lost."""
        return _minus(x, self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, None beyond 64 bits."""
        apart = _minus(x, self.whole)
        reach = (float(np.abs(apart.astype(np.float64)).max(initial=0)) + 1) * self.n
        if reach * reach * max(1, x.shape[1]) < 2.0**62:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, self.rest.tolist())) for row in apart]
        return [e if e < 1 << 63 else None for e in exact]


def _minus(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x - whole, as Python integers where 64 bits may not do."""
    if np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61 and np.abs(whole.astype(np.float64)).max(initial=0) < 2.0**61:
        return x - whole
    return x.astype(object) - whole.astype(object)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _summed(d: int, work: Callable[[np.ndarray], np.ndarray]):
    """Per task the sum of ``work`` over its vectors, one row (cell, value) per number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = work(_matrix(batch.column(0), d)).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    return run


def _total(fit: DataFrame, d: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``work`` over the fit list; ``size`` numbers reach the driver."""
    parts = fit.mapInArrow(_summed(d, work), "cell int, value double")
    out = np.zeros(size)
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


def _sums(d: int):
    """Per task the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            safe = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62
            total = [a + int(b) for a, b in zip(total, (x if safe else x.astype(object)).sum(axis=0))]
        values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), values], names=["cell", "value"])

    return run


def coordinates(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry as long, held within 64 bits; null where an entry is null or not finite."""
    c = vector.cast("array<double>")
    ok = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False)))
    top = (1 << 63) - 1 - SHIFT
    return F.when(ok, F.transform(c, lambda e: F.least(F.floor(e * STEPS), F.lit(top)) + F.lit(SHIFT)))


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained, identity_error and residual (largest norm of V u - e u over e of the first component).

    Vectors that are null or hold a null or non-finite entry are left out, and so are those whose length differs from
    the most common one (the longest of equally common ones; empty vectors never count). The fit list holds each
    distinct vector of coordinates once, so repeated rows weigh nothing but keep their output rows; null ids stay.
    There are at most as many components as dimensions, and none for a direction without variance: without two
    different vectors no row is returned. A deviation beyond 64 bits is null. Each vector points the way that makes
    its largest entry positive. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_field = StructField(id_col, vectors.schema[id_col].dataType)
    schema = StructType([id_field, *StructType.fromDDL(OUT).fields])
    rows = vectors.select(column(id_col).alias("vec"), coordinates(column(vector_col)).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = int(common.d)
    rows = rows.filter(F.size("x") == d)
    fit, seen = StageArea(spark, "whitening").save_observed(rows.select("x").distinct(), "fit", n=F.count("*"))
    sums = fit.mapInArrow(_sums(d), "cell int, value decimal(38, 0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    by_cell = {r.cell: int(r.value) for r in sums}
    centre = Centre(int(seen["n"]), tuple(by_cell[i] for i in range(d)))
    trace = float(_total(fit, d, lambda x: (centre.off(x) ** 2).sum(axis=0), d).sum()) / centre.n
    if not trace > 0:
        return spark.createDataFrame([], schema)

    def product(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centre.off(x)
            return c.T @ (c @ block)

        return _total(fit, d, work, block.size).reshape(block.shape) / centre.n

    values, axes = leading(product, d, components)
    kept = values > RANK * values[0]
    values, axes = values[kept], axes[:, kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    residual = float(_norms(product(axes) - axes * values).max() / values[0])
    white = axes / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centre.off(x) @ white
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    total = _total(fit, d, moments, k + k * k) / centre.n
    cov = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    error = float(np.abs(cov - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            y = centre.off(x) @ white
            at = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            out = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, centre.n, np.int64)),
                pa.array(centre.deviation(x), pa.int64()).take(at),
                pa.array(y.ravel()),
                pa.array(np.tile(values / trace, len(x))),
                pa.array(np.full(size, error)),
                pa.array(np.full(size, residual)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(project, schema)
