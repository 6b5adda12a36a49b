"""Embedding whitening: principal components of unit variance, from a covariance that keeps twice a double's digits.

1. The fit list is each distinct vector once, written to the shared folder.
2. Sums, then outer products of centred vectors, are accumulated in double-double: every product and sum is split into its rounded value and its
   exact error (``two_prod``, ``two_sum``). A task emits one high and one low part; parts are merged in two rounds of groups, so that no group
   grows with the tasks faster than their root, and what reaches the driver has the size of the covariance, whatever the rows.
3. The eigen-solve is LAPACK's ``syevd`` (Householder reduction to a tridiagonal matrix, then divide and conquer), after which one step of Newton's
   kind in extended precision (``_refined``) takes the eigenvectors to double precision where eigenvalues are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_array, materialize

CELLS = 1 << 16  # doubles of one array at work in a task
SLOTS = 32
LARGEST = 2.0**400  # squares of larger entries wouldn't be finite
REFINED_DIMS = 1024
PARTS = "block int, slot int, n long, hi binary, lo binary"


# ----------------------------------------------------------------- double-double
def two_sum(a, b):
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """``a`` as a sum of two numbers of 26 bits."""
    c = 134217729.0 * a
    hi = c - (c - a)
    return hi, a - hi


def two_prod(a, b, a_halves=None, b_halves=None):
    """The rounded product and its exact error."""
    p = a * b
    (ah, al), (bh, bl) = a_halves or halves(a), b_halves or halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(ah, al, bh, bl):
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    return s + e, e - ((s + e) - s)


def dd_total(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the first axis, by halves."""
    while len(hi) > 1:
        n = len(hi) // 2
        a, b = dd_add(hi[:n], lo[:n], hi[n : 2 * n], lo[n : 2 * n])
        hi, lo = (a, b) if len(hi) % 2 == 0 else (np.concatenate([a, hi[2 * n :]]), np.concatenate([b, lo[2 * n :]]))
    return hi[0], lo[0]


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x minus a double-double mean (two rows)."""
    s, e = two_sum(x, -mean[0])
    e = e - mean[1]
    return s + e, e - ((s + e) - s)


# ----------------------------------------------------------------- sums over the fit list
def _rows(batch: pa.RecordBatch, dims: int):
    """Slices of a batch of vectors, as matrices."""
    flat = as_array(batch.column(0)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(16, CELLS // dims)
    for i in range(0, len(flat), step):
        yield flat[i : i + step]


def _emitted(n: int, hi: np.ndarray, lo: np.ndarray):
    """One row for each block of a matrix's rows."""
    slot, step = TaskContext.get().partitionId() % SLOTS, max(1, CELLS // hi.shape[1])
    for block, i in enumerate(range(0, len(hi), step)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([slot], pa.int32()), pa.array([n]), pa.array([hi[i : i + step].tobytes()], pa.binary()), pa.array([lo[i : i + step].tobytes()], pa.binary())], ["block", "slot", "n", "hi", "lo"])


def _sums(dims: int):
    def run(batches):
        n, hi, lo = 0, np.zeros((1, dims)), np.zeros((1, dims))
        for batch in batches:
            for x in _rows(batch, dims):
                a, b = dd_total(x, np.zeros_like(x))
                hi[0], lo[0] = dd_add(hi[0], lo[0], a, b)
                n += len(x)
        if n:
            yield from _emitted(n, hi, lo)

    return run


def _products(dims: int, mean: np.ndarray, onto: np.ndarray | None = None):
    """Sums of outer products (upper triangle) of centred vectors, or of their projections on the rows of ``onto``."""

    def run(batches):
        size = dims if onto is None else len(onto)
        n, hi, lo = 0, np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            for x in _rows(batch, dims):
                c, d = centred(x, mean)
                if onto is not None:
                    c = c @ onto.T
                    d = np.zeros_like(c)
                top, low = halves(c)
                for i in range(size):
                    one = slice(i, i + 1)
                    p, e = two_prod(c[:, one], c[:, i:], (top[:, one], low[:, one]), (top[:, i:], low[:, i:]))
                    e += c[:, one] * d[:, i:] + d[:, one] * c[:, i:]
                    hi[i, i:], lo[i, i:] = dd_add(hi[i, i:], lo[i, i:], *dd_total(p, e))
                n += len(x)
        if n:
            yield from _emitted(n, hi, lo)

    return run


def _merged(parts: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows counted, and the high and low parts of all tasks' sums."""

    def fold(t: pa.Table) -> pa.Table:
        hi, lo = (np.stack([np.frombuffer(x, np.float64) for x in t.column(c).to_pylist()]) for c in ("hi", "lo"))
        hi, lo = dd_total(hi, lo)
        return pa.table([t.column("block")[:1], t.column("slot")[:1], pa.array([sum(t.column("n").to_pylist())]), pa.array([hi.tobytes()], pa.binary()), pa.array([lo.tobytes()], pa.binary())], ["block", "slot", "n", "hi", "lo"])

    rows = parts.groupBy("block", "slot").applyInArrow(fold, PARTS).groupBy("block").applyInArrow(fold, PARTS).collect()
    rows.sort(key=lambda r: r.block)
    hi, lo = (np.concatenate([np.frombuffer(bytes(r[c]), np.float64) for r in rows] or [np.zeros(0)]).reshape(-1, width) for c in ("hi", "lo"))
    return (rows[0].n if rows else 0), hi, lo


# ----------------------------------------------------------------- the model
@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: np.ndarray  # double-double: two rows
    mean: np.ndarray  # double-double: two rows
    components: np.ndarray  # unit eigenvectors, one a row
    values: np.ndarray  # their eigenvalues, falling
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return self.mean.shape[1]

    def total(self) -> list[int]:
        """The sums of vectors of integers, exactly."""
        return [int(h) + int(t) for h, t in self.sums.T]

    def axes(self) -> np.ndarray:
        """Components over the root of their eigenvalues; null components are left out."""
        some = self.varies()
        return self.components[some] / np.sqrt(self.values[some])[:, None]

    def varies(self) -> np.ndarray:
        """Which components vary at all: eigenvalues above what rounding makes of zero."""
        return self.values > (self.values.max(initial=0.0) * self.dims * 2.0**-52)


def _refined(v: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step for all eigenvectors at once, in extended precision; those of eigenvalues that can't be told apart are only made orthonormal."""
    x = x.astype(np.longdouble)
    r = np.eye(len(v), dtype=np.longdouble) - x.T @ x
    s = x.T @ v @ x
    w = np.diag(s) / (1 - np.diag(r))
    apart = w[None, :] - w[:, None]
    least = 2 * (np.linalg.norm((s - np.diag(w)).astype(float)) + np.linalg.norm(values) * np.linalg.norm(r.astype(float)))
    told = np.abs(apart) > least
    e = np.where(told, (s + w[None, :] * r) / np.where(told, apart, 1), r / 2)
    return w, x + x @ e


def eigen(hi: np.ndarray, lo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors (rows, the largest entry positive) and trace of a double-double matrix over n."""
    v = (hi.astype(np.longdouble) + lo) / n
    v = np.triu(v) + np.triu(v, 1).T
    values, x = np.linalg.eigh(v.astype(np.float64))
    if len(v) <= REFINED_DIMS and values.max(initial=0.0) > 0:
        values, x = _refined(v, values, x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order].astype(np.float64), x.T[order].astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.sign(x[np.arange(len(x)), np.abs(x).argmax(axis=1)])[:, None]
    return np.maximum(values, 0.0), x, float(np.trace(v))


def usable(vec: Column) -> Column:
    """Not null, without null entries, and all of a size whose square is finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST)))


def common_length(df: DataFrame, vec_col: str) -> int:
    """The commonest length of usable vectors (ties: the smaller; 0 without any)."""
    found = df.filter(usable(F.col(f"`{vec_col}`"))).groupBy(F.size(f"`{vec_col}`").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.d if found else 0


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of the distinct usable vectors; none if there are none, or only empty ones. The d x d covariance is the only thing that the driver holds."""
    d = common_length(df, vec_col)
    if not d:
        return None
    vec = F.col(f"`{vec_col}`")
    each = materialize(df.filter(usable(vec) & (F.size(vec) == d)).select(vec.cast("array<double>").alias("v")).distinct(), "vectors")
    n, hi, lo = _merged(each.mapInArrow(_sums(d), PARTS), d)
    sums = np.stack([hi[0], lo[0]])
    high = sums.astype(np.longdouble).sum(axis=0) / n
    mean = np.stack([high.astype(np.float64), (high - high.astype(np.float64)).astype(np.float64)])
    # one Newton step: what n times the mean leaves of the sums, exactly
    p, e = two_prod(np.float64(n), mean[0])
    left, f = two_sum(sums[0], -p)
    mean[1] = (left + (f - e + sums[1])) / n
    _, hi, lo = _merged(each.mapInArrow(_products(d, mean), PARTS), d)
    values, x, trace = eigen(hi, lo, n)
    out = Whitening(n, sums, mean, x[:components], values[:components], trace)
    axes = out.axes()
    if len(axes):
        _, hi, _ = _merged(each.mapInArrow(_products(d, mean, axes), PARTS), len(axes))
        out.identity_error = float(np.abs(np.triu(hi / n - np.eye(len(axes)))).max())
    return out


def whiten(df: DataFrame, model: Whitening | None, vec_col: str = "embedding") -> DataFrame:
    """``df`` with ``whitened`` (array<double>, an entry for each component), ``explained`` (array<double>) and ``identity_error``.

    Rows whose vector is null, holds null, non-finite or immense (2**400) entries, or isn't of the model's length take no part and aren't returned.
    Equal vectors count once in the fit and are all returned. Components that don't vary (fewer distinct vectors than dimensions) have null entries;
    if none does, ``explained`` and ``identity_error`` are null too. Without a model (empty table, or no usable vector) no row is returned.
    Columns of these three names are replaced, all others pass through.
    """
    names = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("whitened", "explained", "identity_error")]
    vec = F.col(f"`{vec_col}`")
    if model is None:
        nothing = F.lit(None).cast("array<double>")
        return df.filter(F.lit(False)).select(*names, nothing.alias("whitened"), nothing.alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    d, mean, some = model.dims, model.mean, model.varies()
    axes = np.zeros((len(some), d))
    axes[some] = model.axes()

    @F.arrow_udf("array<double>")
    def project(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        step, out = max(16, CELLS // d), np.empty((len(flat), len(axes)))
        for i in range(0, len(flat), step):
            out[i : i + step] = np.einsum("nd,kd->nk", centred(flat[i : i + step], mean)[0], axes)  # not by blocks of rows: equal vectors, equal results
        gone = None if some.all() else np.tile(~some, len(flat))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(axes), dtype=np.int32)), pa.array(out.reshape(-1), mask=gone))

    share = F.lit([float(x / model.trace) for x in model.values]) if model.trace > 0 else F.lit(None)
    good = df.filter(usable(vec) & (F.size(vec) == d))
    return good.select(*names, project(vec.cast("array<double>")).alias("whitened"), share.cast("array<double>").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
